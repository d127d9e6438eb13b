"""Technical indicators for all series at once.

Bounded windows and running totals are window columns over one partitioning and one sort.  Recurrences (exponential and
Wilder averages) are scans over the sorted rows, many series at once, on the same partitioning, after the windows.  Every candle
keeps its row; an indicator's value is null until enough candles are there (INSUFFICIENT_DATA) or where its denominator
isn't positive (INVALID).  No value looks ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.candles import INSUFFICIENT, INVALID, KEY, NUMBERS, SERIES, VALID, series
from barloom.operators.quality import contract
from barloom.operators.scans import INPUTS, SCANS, Scans, streamed

#: A benchmark of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
VERSION = "1.0.0"


@dataclass(frozen=True)
class Indicator:
    """A registered indicator.

    ``kind`` is window (``build(params)`` gives component columns and, under ``invalid``, a condition), series
    (``build(bars, params)`` gives component arrays for one series in time order) or benchmark.
    ``first`` is the first row with a value, ``reach`` how many rows back the source window starts (None: the first row).
    """

    name: str
    kind: str
    build: Callable
    first: Callable[[dict], int]
    reach: Callable[[dict], int | None]
    lookback: Callable[[dict], int]
    defaults: dict = field(default_factory=dict)
    components: tuple[str, ...] = ()
    fields: tuple[str, ...] = ("close",)
    least: dict = field(default_factory=dict)
    check: Callable[[dict], bool] = lambda p: True

    def params(self, given: dict) -> dict:
        unknown = set(given) - set(self.defaults)
        if unknown:
            raise ValueError(f"{self.name} has no parameters {sorted(unknown)}")
        p = {**self.defaults, **given}
        if any(p[k] < v for k, v in self.least.items()) or not self.check(p):
            raise ValueError(f"parameters of {self.name} out of bounds: {p}")
        return p


@dataclass(frozen=True)
class Spec:
    """An indicator with parameters, and the prefix of its output columns."""

    indicator: Indicator
    params: tuple[tuple[str, object], ...]

    @property
    def name(self) -> str:
        return self.indicator.name

    @property
    def p(self) -> dict:
        return dict(self.params)

    def columns(self) -> list[str]:
        return [f"{self.name}_{c}" for c in self.indicator.components] or [self.name]


def over(first: int, last: int = 0):
    return series().rowsBetween(first, last)


_shared: ContextVar[dict[str, Column] | None] = ContextVar("windows that indicators share", default=None)


def shared(name: str, window: Column) -> Column:
    """The column of a window that several indicators may ask for; inside ``windowed`` each is made once, and all in one pass."""
    found = _shared.get()
    if found is None:
        return window
    found[f"_w_{name}"] = window
    return F.col(f"_w_{name}")


def mean(column: str, p: int, lag: int = 0) -> Column:
    return shared(f"mean_{column}_{p}_{lag}", F.avg(column).over(over(-(p - 1) - lag, -lag)))


def past_of(column: str, lag: int) -> Column:
    return shared(f"past_{column}_{lag}", F.lag(column, lag).over(series()))


def deviation(p: int) -> Column:
    return shared(f"deviation_{p}", F.stddev_samp("close").over(over(-(p - 1))))


def top(p: int, lag: int = 0) -> Column:
    return shared(f"top_{p}_{lag}", F.max("high").over(over(-(p - 1) - lag, -lag)))


def bottom(p: int, lag: int = 0) -> Column:
    return shared(f"bottom_{p}_{lag}", F.min("low").over(over(-(p - 1) - lag, -lag)))


def _true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_prev")), F.abs(F.col("low") - F.col("_prev")))


def _price_vs_sma(p: dict) -> dict:
    sma = mean("close", p["period"])
    return {"": (F.col("close") - sma) / sma, "invalid": sma <= 0}


def _sma_slope(p: dict) -> dict:
    return {"": (mean("close", p["period"]) - mean("close", p["period"], p["lag"])) / p["lag"]}


def _roc(p: dict) -> dict:
    past = past_of("close", p["period"])
    return {"": (F.col("close") - past) / past * 100, "invalid": past <= 0}


def _rvol(p: dict) -> dict:
    sma = mean("volume", p["period"])
    return {"": F.col("volume") / sma, "invalid": sma == 0}


def _volume_change(p: dict) -> dict:
    past = past_of("volume", p["lag"])
    return {"": (F.col("volume") - past) / past * 100, "invalid": past == 0}


def _obv(p: dict) -> dict:
    signed = F.coalesce(F.signum(F.col("close") - F.col("_prev")) * F.col("volume"), F.lit(0.0))
    return {"": shared("obv", F.sum(signed).over(series().rowsBetween(-(2**63), 0)))}


def _bollinger(p: dict) -> dict:
    middle, sigma, m = mean("close", p["period"]), deviation(p["period"]), p["std_multiplier"]
    flat, upper, lower = sigma == 0, middle + sigma * m, middle - sigma * m
    return {
        "middle": middle,
        "upper": F.when(flat, middle).otherwise(upper),
        "lower": F.when(flat, middle).otherwise(lower),
        "bandwidth": F.when(flat, 0.0).otherwise((upper - lower) / middle),
        "percent_b": F.when(flat | (upper == lower), 0.5).otherwise((F.col("close") - lower) / (upper - lower)),
        "invalid": middle <= 0,
    }


def _breakout(p: dict) -> dict:
    high, low, c = top(p["period"], 1), bottom(p["period"], 1), F.col("close")
    return {
        "dist_high": (c - high) / high * 100,
        "dist_low": (c - low) / low * 100,
        "breakout_high": (c > high).cast("double"),
        "breakdown_low": (c < low).cast("double"),
        "invalid": (high <= 0) | (low <= 0),
    }


def smoothed(values: np.ndarray, seed_at: int, seed: float, alpha: float) -> np.ndarray:
    """NaN before ``seed_at``, the seed there, then alpha * value + (1 - alpha) * previous."""
    out = np.full(len(values), np.nan)
    if seed_at < len(values):
        run = np.concatenate(([seed], values[seed_at + 1 :]))
        out[seed_at:] = pd.Series(run).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    return out


def seeded_mean(values: np.ndarray, period: int, begin: int, alpha: float) -> np.ndarray:
    """An average seeded by the mean of the ``period`` values from ``begin``."""
    at = begin + period - 1
    return smoothed(values, at, float(np.mean(values[begin : at + 1])) if at < len(values) else 0.0, alpha)


def ema(close: np.ndarray, period: int) -> np.ndarray:
    return seeded_mean(close, period, 0, 2 / (period + 1))


def _ema(bars: pd.DataFrame, p: dict) -> dict:
    return {"": ema(bars["close"].to_numpy(), p["period"])}


def _ema_slope(bars: pd.DataFrame, p: dict) -> dict:
    e = pd.Series(ema(bars["close"].to_numpy(), p["period"]))
    return {"": ((e - e.shift(p["lag"])) / p["lag"]).to_numpy()}


def _rsi(bars: pd.DataFrame, p: dict) -> dict:
    steps = np.diff(bars["close"].to_numpy(), prepend=bars["close"].iloc[0])
    n, alpha = p["period"], 1 / p["period"]
    gain, loss = (seeded_mean(np.maximum(sign * steps, 0.0), n, 1, alpha) for sign in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + gain / loss)
    return {"": np.where(loss == 0, np.where(gain > 0, 100.0, 50.0), out)}


def _macd(bars: pd.DataFrame, p: dict) -> dict:
    close = bars["close"].to_numpy()
    line = ema(close, p["fast_period"]) - ema(close, p["slow_period"])
    signal = seeded_mean(line, p["signal_period"], p["slow_period"] - 1, 2 / (p["signal_period"] + 1))
    line = np.where(np.isnan(signal), np.nan, line)
    return {"macd": line, "signal": signal, "histogram": line - signal}


def _atr(bars: pd.DataFrame, p: dict) -> dict:
    return {"": seeded_mean(bars["_tr"].to_numpy(), p["period"], 0, 1 / p["period"])}


def _natr(bars: pd.DataFrame, p: dict) -> dict:
    close = bars["close"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        return {"": _atr(bars, p)[""] / close * 100, "invalid": close <= 0}


def _relative_strength(asset: Column, past: Column, mark: Column, mark_past: Column) -> dict:
    return {
        "excess_return": ((asset - past) / past - (mark - mark_past) / mark_past) * 100,
        "outperformance_ratio": (asset / past) / (mark / mark_past) - 1,
        "invalid": (past <= 0) | (mark <= 0) | (mark_past <= 0),
    }


_period = lambda p: p["period"]
_warm = lambda p: p["period"] - 1
_lagged = lambda p: p["period"] + p["lag"] - 1
_P20, _P14, _LAG = {"period": 20}, {"period": 14}, {"period": 20, "lag": 1}


def _windowed(name: str, build: Callable, **more) -> Indicator:
    return Indicator(name, "window", build, **{"first": _warm, "reach": _warm, "lookback": _period, "defaults": _P20, "least": {"period": 1}, **more})


def _rolling(name: str, build: Callable, **more) -> Indicator:
    return Indicator(name, "series", build, **{"first": _warm, "reach": _warm, "lookback": _period, "defaults": _P20, "least": {"period": 1}, **more})


_after = {"first": _period, "reach": _period}
_BUILT_IN = [
    _windowed("sma", lambda p: {"": mean("close", p["period"])}),
    _windowed("price_vs_sma", _price_vs_sma),
    _windowed("sma_slope", _sma_slope, first=_lagged, reach=_lagged, lookback=lambda p: p["period"] + p["lag"], defaults=_LAG, least={"period": 1, "lag": 1}),
    _windowed("roc", _roc, defaults=_P14, **_after),
    _windowed("volume_sma", lambda p: {"": mean("volume", p["period"])}, fields=("volume",)),
    _windowed("rvol", _rvol, fields=("volume",)),
    _windowed("volume_change", _volume_change, first=lambda p: p["lag"], reach=lambda p: p["lag"], lookback=lambda p: p["lag"] + 1, defaults={"lag": 1}, least={"lag": 1}, fields=("volume",)),
    _windowed("obv", _obv, first=lambda p: 0, reach=lambda p: None, lookback=lambda p: 1, defaults={}, least={}, fields=("close", "volume")),
    _windowed("true_range", lambda p: {"": _true_range()}, first=lambda p: 0, reach=lambda p: 1, lookback=lambda p: 2, defaults={}, least={}, fields=("high", "low", "close")),
    _windowed("rolling_std", lambda p: {"": deviation(p["period"])}, least={"period": 2}),
    _windowed("bollinger_bands", _bollinger, defaults={"period": 20, "std_multiplier": 2.0}, least={"period": 2, "std_multiplier": 0}, components=("middle", "upper", "lower", "bandwidth", "percent_b")),
    _windowed("rolling_high", lambda p: {"": top(p["period"])}, fields=("high",)),
    _windowed("rolling_low", lambda p: {"": bottom(p["period"])}, fields=("low",)),
    _windowed("structure_breakout_distance", _breakout, lookback=lambda p: p["period"] + 1, components=("dist_high", "dist_low", "breakout_high", "breakdown_low"), fields=("high", "low", "close"), **_after),
    _rolling("ema", _ema),
    _rolling("ema_slope", _ema_slope, first=_lagged, reach=_lagged, lookback=lambda p: p["period"] + p["lag"], defaults=_LAG, least={"period": 1, "lag": 1}),
    _rolling("rsi", _rsi, defaults=_P14, **_after),
    _rolling(
        "macd",
        _macd,
        first=lambda p: p["slow_period"] + p["signal_period"] - 2,
        reach=lambda p: p["slow_period"] + p["signal_period"] - 2,
        lookback=lambda p: p["slow_period"] + p["signal_period"] - 1,
        defaults={"fast_period": 12, "slow_period": 26, "signal_period": 9},
        least={"fast_period": 1, "signal_period": 1},
        check=lambda p: p["slow_period"] > p["fast_period"],
        components=("macd", "signal", "histogram"),
    ),
    _rolling("atr", _atr, defaults=_P14, fields=("high", "low", "close")),
    _rolling("natr", _natr, defaults=_P14, fields=("high", "low", "close")),
    Indicator("relative_strength", "benchmark", _relative_strength, defaults=_P20, least={"period": 1}, lookback=lambda p: p["period"] + 1, components=("excess_return", "outperformance_ratio"), **_after),
]
_registry: dict[str, Indicator] = {i.name: i for i in _BUILT_IN}


def register(indicator: Indicator) -> None:
    """Adds a user's indicator; its name must be new."""
    name = indicator.name.strip().lower()
    if name in _registry:
        raise ValueError(f"indicator {name} is registered already")
    _registry[name] = indicator


def unregister(name: str) -> None:
    _registry.pop(name.strip().lower())


def ind(name: str, **params) -> Spec:
    """An indicator by name, with parameters; KeyError if unknown."""
    found = _registry[name.strip().lower()]
    return Spec(found, tuple(sorted(found.params(params).items())))


def catalog() -> list[dict]:
    """All registered indicators, by name."""
    return [{"name": i.name, "kind": i.kind, "version": VERSION, "required_fields": list(i.fields), "minimum_observations": i.first(i.defaults) + 1, "parameters": {k: str(v) for k, v in i.defaults.items()}} for _, i in sorted(_registry.items())]


def _status(first: int, invalid: Column, value: Column) -> Column:
    return F.when(F.col("_i") < first, INSUFFICIENT).when(F.coalesce(invalid, F.lit(False)), INVALID).when(value.isNull(), INSUFFICIENT).otherwise(VALID)


def _finished(df: DataFrame, spec: Spec, made: dict[str, Column]) -> DataFrame:
    """Adds the spec's value columns, null unless VALID, and its status."""
    invalid = made.get("invalid", F.lit(False))
    values = {(f"{spec.name}_{c}" if c else spec.name): v for c, v in made.items() if c != "invalid"}
    status = f"{spec.name}_status"
    df = df.withColumn(status, _status(spec.indicator.first(spec.p), invalid, next(iter(values.values()))))
    return df.withColumns({c: F.when(F.col(status) == VALID, v) for c, v in values.items()})


def _helped(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """Runs the series indicators of every series in one pass; NaN and invalid values become null."""
    names = [c for s in specs for c in s.columns()] + [f"{s.name}_bad" for s in specs]
    kinds = [T.StructField(c, T.BooleanType() if c.endswith("_bad") else T.DoubleType()) for c in names]
    schema = T.StructType([*df.schema.fields, *kinds])

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("timestamp", kind="stable")
        more = {}
        for s in specs:
            made = s.indicator.build(bars, s.p)
            more[f"{s.name}_bad"] = np.broadcast_to(made.pop("invalid", False), len(bars))
            for c, v in made.items():
                more[f"{s.name}_{c}" if c else s.name] = v
        return bars.assign(**more)[[f.name for f in schema.fields]]

    return _numbers(df.groupBy(*SERIES).applyInPandas(run, schema), specs)


def _numbers(out: DataFrame, specs: list[Spec]) -> DataFrame:
    """Finishes the columns of series indicators, in which NaN stands for no value and ``<name>_bad`` for an invalid one."""
    for s in specs:
        made = {c: F.when(~F.isnan(F.col(f"{s.name}_{c}" if c else s.name)), F.col(f"{s.name}_{c}" if c else s.name)) for c in (s.indicator.components or ("",))}
        out = _finished(out, s, {**made, "invalid": F.col(f"{s.name}_bad")}).drop(f"{s.name}_bad")
    return out


def valued(df: DataFrame, specs: list[Spec], state: str | None = None) -> DataFrame:
    """Adds the values of ``specs`` to series that lie one after the other in time order in each partition, with ``_i``, ``_prev`` and ``_tr``.

    Only the numbers that the scans read go to Python, and no series is held.  ``state`` names a column with the states
    at the begin of a block, which is null in its other rows.
    """
    scans = Scans(specs)
    kinds = T.StructType([T.StructField(c, T.BooleanType() if c.endswith("_bad") else T.DoubleType()) for c in scans.names])

    @F.pandas_udf(kinds)
    def scan(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        return streamed(scans, batches)

    # What it gives for a row depends on the rows before it, so no filter that comes later may go below it.
    out = df.withColumn("_scan", scan.asNondeterministic()("_i", *INPUTS, *([state] if state else [])))
    return _numbers(out.withColumns({c: F.col("_scan")[c] for c in scans.names}).drop("_scan"), specs)


def streams(spec: Spec) -> bool:
    """Whether a series indicator is one of those that are scans (a user's own may have the name of one)."""
    return spec.name in SCANS and any(spec.indicator is i for i in _BUILT_IN)


def _helped_or_streamed(out: DataFrame, specs: list[Spec], strict: bool) -> DataFrame:
    """Scans need what a strict run makes sure of: finite numbers, and one row for each stamp."""
    return valued(out, specs) if strict and all(streams(s) for s in specs) else _helped(out, specs)


def _against(df: DataFrame, specs: list[Spec], benchmark: DataFrame) -> DataFrame:
    """Joins the benchmark's closes at exactly a candle's stamp and the stamp ``period`` candles before."""
    mark = benchmark.select(F.col("timeframe").alias("_tf"), F.col("timestamp").alias("_ts"), F.col("close").alias("_mark"))
    n = mark.count()
    if n != mark.select("_tf", "_ts").distinct().count():
        raise ValueError("a benchmark has one candle per timeframe and stamp")
    mark = F.broadcast(mark) if n <= BROADCAST_ROWS else mark
    now = df.join(mark, (F.col("timeframe") == F.col("_tf")) & (F.col("timestamp") == F.col("_ts")), "left").drop("_tf", "_ts")
    for s in specs:
        then = mark.withColumnRenamed("_mark", "_mark_past")
        period = s.p["period"]
        now = now.join(then, (F.col("timeframe") == F.col("_tf")) & (F.col(f"_ts{period}") == F.col("_ts")), "left").drop("_tf", "_ts")
        made = _relative_strength(F.col("close"), F.col(f"_close{period}"), F.col("_mark"), F.col("_mark_past"))
        missing = F.col("_mark").isNull() | F.col("_mark_past").isNull()
        now = _finished(now, s, {**made, "invalid": F.when(missing, False).otherwise(made["invalid"])}).drop("_mark_past", f"_ts{period}", f"_close{period}")
    return now.drop("_mark")


def checked(out: DataFrame) -> DataFrame:
    """``out``, which fails when it runs on a candle that breaks the series contract.  The rows are sorted by then, so this adds no exchange."""
    broken = contract(F.col("_earlier"))
    told = F.concat_ws(" ", F.lit("a candle breaks the series contract:"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in KEY], F.concat_ws("; ", broken))
    return out.where(F.when(F.size(broken) > 0, F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))


def windowed(df: DataFrame, windows: list[Spec], marked: list[Spec], strict: bool, true_range: bool) -> DataFrame:
    """Candles with ``_i``, their place in the series, and what windows over neighbouring candles make of them; ``marked`` are compared with a benchmark later."""
    w = series()
    out = df if "_i" in df.columns else df.withColumn("_i", F.row_number().over(w) - 1)
    out = out.withColumns({"_prev": F.lag("close").over(w), "_earlier": F.lag("timestamp").over(w)})
    out = checked(out).drop("_earlier") if strict else out.drop("_earlier")
    out = out.withColumns({c: v for s in marked for c, v in ((f"_ts{s.p['period']}", F.lag("timestamp", s.p["period"]).over(w)), (f"_close{s.p['period']}", F.lag("close", s.p["period"]).over(w)))})
    if true_range:
        out = out.withColumn("_tr", _true_range())
    token = _shared.set({})
    try:
        made, common = [(s, s.indicator.build(s.p)) for s in windows], _shared.get()
    finally:
        _shared.reset(token)
    out = out.withColumns(common)
    for s, m in made:
        out = _finished(out, s, m)
    return out.drop(*common)


def compute(df: DataFrame, indicators: list[str | Spec], benchmark: DataFrame | None = None, keep_index: bool = False, strict: bool = True, block_rows: int | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """The candles of all series with columns of each indicator: its value (or ``<name>_<component>``) and ``<name>_status``.

    A name given twice counts once, with the last parameters.  Repeated stamps, numbers that aren't finite and bars that
    contradict themselves fail the job that runs the result, unless ``strict`` is off; rows have no order of their own,
    so none is checked.  An empty table gives an empty result.

    One task holds a series.  With ``block_rows`` it holds so many candles of one and no more (``operators.blocks``),
    which costs two shuffles and two written tables but lets a single long series use the whole cluster.

    ``more`` names further windows over ``series()`` (not in blocks), which may use the columns of window indicators; they
    are made before the recurrences, where the series are sorted anyway.
    """
    specs = list({s.name: s for s in (ind(x) if isinstance(x, str) else x for x in indicators)}.values())
    by = {k: [s for s in specs if s.indicator.kind == k] for k in ("window", "series", "benchmark")}
    if by["benchmark"] and benchmark is None:
        raise ValueError("relative strength needs a benchmark")
    if block_rows is not None:
        from barloom.operators import blocks

        return blocks.compute(df, specs, benchmark, keep_index, strict, block_rows)
    out = windowed(df.select(*KEY, *NUMBERS), by["window"], by["benchmark"], strict, bool(by["series"]))
    if more:
        out = out.withColumns(more)
    if by["series"]:
        out = _helped_or_streamed(out, by["series"], strict)
    if by["benchmark"]:
        out = _against(out, by["benchmark"], benchmark)
    return out.drop("_prev", "_tr", *([] if keep_index else ["_i"]))


def to_long(df: DataFrame, indicators: list[str | Spec], benchmark: DataFrame | None = None) -> DataFrame:
    """One row per candle and indicator: value or components, status and provenance."""
    specs = [ind(x) if isinstance(x, str) else x for x in indicators]
    reaches = sorted({r for s in specs if (r := s.indicator.reach(s.p)) is not None})
    w = series()
    first = F.first("timestamp").over(w.rowsBetween(-(2**63), 0))
    wide = compute(df, specs, benchmark, keep_index=True, more={"_start": first, **{f"_start{r}": F.coalesce(F.lag("timestamp", r).over(w), first) if r else F.col("timestamp") for r in reaches}})

    def chosen(of: Callable[[int, Spec], Column]) -> Column:
        """What ``of`` gives for the indicator of the row."""
        out = F
        for k, s in enumerate(specs):
            out = out.when(F.col("_k") == k, of(k, s))
        return out

    def value(k: int, s: Spec) -> Column:
        return F.lit(None).cast("double") if s.indicator.components else F.col(s.name)

    def components(k: int, s: Spec) -> Column:
        parts = s.indicator.components
        values = F.create_map(*[x for c in parts for x in (F.lit(c), F.col(f"{s.name}_{c}"))]) if parts else F.lit(None).cast("map<string,double>")
        return F.when(F.col(f"{s.name}_status") == VALID, values)

    def parameters(k: int, s: Spec) -> Column:
        return F.create_map(*[F.lit(x) for name, v in s.params for x in (name, str(v))]).cast("map<string,string>")

    def lookback(k: int, s: Spec) -> Column:
        return (F.when(F.col("_i") == 0, 1).otherwise(2) if s.name == "true_range" else F.lit(s.indicator.lookback(s.p))).cast("int")

    def start(k: int, s: Spec) -> Column:
        reach = s.indicator.reach(s.p)
        return F.col("_start" if reach is None else f"_start{reach}")

    provenance = F.struct(
        chosen(lambda k, s: F.lit(s.name)).alias("name"),
        F.lit(VERSION).alias("version"),
        chosen(parameters).alias("parameters"),
        chosen(lookback).alias("lookback_period"),
        chosen(start).alias("source_window_start"),
        F.col("timestamp").alias("source_window_end"),
        (F.col("_i") + 1).cast("long").alias("candles_analyzed"),
    )
    # The rows are expanded by number alone, so what isn't read of them is never made.
    each = wide.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(len(specs))])))
    return each.select(*KEY, chosen(lambda k, s: F.lit(s.name)).alias("indicator_name"), chosen(value).alias("value"), chosen(components).alias("components"), chosen(lambda k, s: F.col(f"{s.name}_status")).alias("status"), provenance.alias("provenance"))


def latest_point(df: DataFrame, indicators: list[str | Spec], benchmark: DataFrame | None = None) -> DataFrame:
    """The indicators of each series at its last candle."""
    wide = compute(df, indicators, benchmark)
    last = wide.groupBy(*SERIES).agg(F.max_by(F.struct(*[c for c in wide.columns if c not in SERIES]), "timestamp").alias("_last"))
    return last.select(*SERIES, "_last.*")


def compute_from_store(spark, store: str, indicators: list[str | Spec], symbols=None, exchange=None, timeframe=None, start=None, end=None, benchmark: DataFrame | None = None) -> DataFrame:
    """Indicators of stored candles; they see only the window that is read.  Nothing found raises."""
    from barloom.sources.store import read_candles

    found = read_candles(spark, store, symbols, exchange, timeframe, start, end)
    if found.isEmpty():
        raise ValueError("no candles in the store for this request")
    return compute(found, indicators, benchmark)
