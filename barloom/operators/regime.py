"""Market regimes: five dimensions and a composite state, as CASE chains over indicator columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.candles import INSUFFICIENT, KEY, NUMBERS, SERIES, VALID, series
from barloom.operators.indicators import compute, ind

REQUIRED = ["price_vs_sma", "sma_slope", "ema_slope", "sma", "rsi", "roc", "macd", "bollinger_bands", "rvol", "obv", "structure_breakout_distance"]
DIMENSIONS = ["trend", "momentum", "volatility", "volume", "structure"]
STATES = ["trend", "momentum", "volatility", "volume_regime", "structure", "composite_regime"]
#: The indicators that the dimensions read, and the dimensions that the composite state reads.
READ = {
    "trend": ["price_vs_sma", "sma_slope", "ema_slope"],
    "momentum": ["rsi", "roc", "macd"],
    "volatility": ["bollinger_bands"],
    "volume_regime": ["rvol", "obv"],
    "structure": ["structure_breakout_distance", "bollinger_bands", "sma", "sma_slope", "ema_slope"],
}
COMPOSITE_READS = ["trend", "momentum", "volatility", "structure"]


@dataclass(frozen=True)
class Bounds:
    """Thresholds of all dimensions."""

    slope: float = 0.0
    distance: float = 0.005
    bullish_rsi: float = 55.0
    bearish_rsi: float = 45.0
    low_bandwidth: float = 0.030
    high_bandwidth: float = 0.080
    high_rvol: float = 1.20
    low_rvol: float = 0.80
    channel: float = 0.020
    consolidation: float = 0.030

    def __post_init__(self):
        ok = self.slope >= 0 and self.distance > 0 and 50 < self.bullish_rsi <= 100 and 0 <= self.bearish_rsi < 50 and 0 < self.low_bandwidth < self.high_bandwidth and self.high_rvol > 1 and 0 < self.low_rvol < 1 and self.channel > 0 and self.consolidation > 0
        if not ok:
            raise ValueError(f"thresholds out of bounds: {self}")


def _ready(*names: str) -> Column:
    ready = F.lit(True)
    for n in names:
        ready = ready & (F.coalesce(F.col(f"{n}_status"), F.lit("")) == VALID)
    return ready


def _chain(ready: Column, rules: list[tuple[str, Column]], other: str) -> Column:
    out = F.when(~ready, INSUFFICIENT)
    for state, cond in rules:
        out = out.when(cond, state)
    return out.otherwise(other)


def trend(b: Bounds = Bounds()) -> Column:
    p, s, e = F.col("price_vs_sma"), F.col("sma_slope"), F.col("ema_slope")
    return _chain(_ready("price_vs_sma", "sma_slope", "ema_slope"), [("BULLISH", (p > b.distance) & (s > b.slope) & (e > b.slope)), ("BEARISH", (p < -b.distance) & (s < -b.slope) & (e < -b.slope))], "SIDEWAYS")


def momentum(b: Bounds = Bounds()) -> Column:
    r, c, h = F.col("rsi"), F.col("roc"), F.col("macd_histogram")
    return _chain(_ready("rsi", "roc", "macd"), [("POSITIVE", (r >= b.bullish_rsi) & (c > 0) & (h > 0)), ("NEGATIVE", (r <= b.bearish_rsi) & (c < 0) & (h < 0))], "NEUTRAL")


def volatility(b: Bounds = Bounds()) -> Column:
    w = F.col("bollinger_bands_bandwidth")
    return _chain(_ready("bollinger_bands"), [("LOW", w < b.low_bandwidth), ("HIGH", w > b.high_bandwidth)], "NORMAL")


def volume(b: Bounds = Bounds()) -> Column:
    """Needs ``_obv_before``, the volume balance one candle earlier."""
    r, step = F.col("rvol"), F.col("obv") - F.col("_obv_before")
    high = r >= b.high_rvol
    rules = [("ACCUMULATION", high & (F.col("close") > F.col("open")) & (step > 0)), ("DISTRIBUTION", high & (F.col("close") < F.col("open")) & (step < 0)), ("HIGH_VOLUME", high), ("LOW_VOLUME", r < b.low_rvol)]
    return _chain(_ready("rvol", "obv") & F.col("_obv_before").isNotNull(), rules, "NORMAL_VOLUME")


def structure(b: Bounds = Bounds()) -> Column:
    up, down = F.col("structure_breakout_distance_dist_high"), F.col("structure_breakout_distance_dist_low")
    s, e, c, sma, near = F.col("sma_slope"), F.col("ema_slope"), F.col("close"), F.col("sma"), b.channel * 100
    rules = [
        ("BREAKOUT", F.col("structure_breakout_distance_breakout_high") == 1),
        ("BREAKDOWN", F.col("structure_breakout_distance_breakdown_low") == 1),
        ("CONSOLIDATION", F.col("bollinger_bands_bandwidth") <= b.consolidation),
        ("TRENDING", ((up >= -near) & (c > sma) & (s > 0) & (e > 0)) | ((down <= near) & (c < sma) & (s < 0) & (e < 0))),
    ]
    return _chain(_ready("structure_breakout_distance", "bollinger_bands", "sma", "sma_slope", "ema_slope"), rules, "RANGING")


def composite() -> Column:
    t, m, v, s = (F.col(c) for c in ("trend", "momentum", "volatility", "structure"))
    rules = [
        ("DIVERGENT", ((t == "BULLISH") & (m == "NEGATIVE")) | ((t == "BEARISH") & (m == "POSITIVE"))),
        ("VOLATILE_UNSTRUCTURED", (v == "HIGH") & (s == "RANGING")),
        ("BULLISH_TRENDING_EXPANSION", (t == "BULLISH") & (m == "POSITIVE") & s.isin("BREAKOUT", "TRENDING")),
        ("BEARISH_TRENDING_EXPANSION", (t == "BEARISH") & (m == "NEGATIVE") & s.isin("BREAKDOWN", "TRENDING")),
        ("BULLISH_CONSOLIDATION", (t == "BULLISH") & (s == "CONSOLIDATION")),
        ("BEARISH_CONSOLIDATION", (t == "BEARISH") & (s == "CONSOLIDATION")),
        ("COMPRESSION", (v == "LOW") & (s == "CONSOLIDATION")),
        ("SIDEWAYS_RANGE", (t == "SIDEWAYS") & s.isin("RANGING", "CONSOLIDATION")),
    ]
    ready = (t != INSUFFICIENT) & (m != INSUFFICIENT) & (v != INSUFFICIENT) & (s != INSUFFICIENT)
    return _chain(ready, rules, "UNKNOWN")


def classified(wide: DataFrame, bounds: Bounds = Bounds(), states: list[str] = STATES) -> DataFrame:
    """Adds ``states`` (and the dimensions that ``composite_regime`` reads) to candles with the indicators that they need."""
    dimensions = [s for s in READ if s in states or "composite_regime" in states and s in COMPOSITE_READS]
    out = wide if "_obv_before" in wide.columns or "volume_regime" not in dimensions else wide.withColumn("_obv_before", F.lag("obv").over(series()))
    makers = {"trend": trend, "momentum": momentum, "volatility": volatility, "volume_regime": volume, "structure": structure}
    out = out.withColumns({c: makers[c](bounds) for c in dimensions})
    return (out.withColumn("composite_regime", composite()) if "composite_regime" in states else out).drop("_obv_before")


def needed(states: list[str]) -> list[str]:
    """The indicators that ``states`` read, in the order of ``REQUIRED``."""
    dimensions = {d for s in states for d in (COMPOSITE_READS if s == "composite_regime" else [s])}
    return [n for n in REQUIRED if any(n in READ[d] for d in dimensions)]


def inputs_check(candles: DataFrame, points: DataFrame, mode: str = "report") -> DataFrame:
    """For indicators that come from outside as ``KEY, indicator_name``: per required indicator, the candles without a point and the points without a candle.

    ``mode="raise"`` returns ``points``, or raises if there are no candles or any indicator lacks or adds a point.
    """
    # One row a candle: the set of its points is a number with a bit for each indicator, so nothing is expanded before the shuffle.
    bit = F.create_map(*[x for k, n in enumerate(REQUIRED) for x in (F.lit(n), F.lit(1 << k))])
    have = points.where(F.col("indicator_name").isin(REQUIRED)).select(*KEY, F.lit(0).cast("long").alias("_c"), bit[F.col("indicator_name")].alias("_p"))
    want = candles.select(*KEY, F.lit(1).cast("long").alias("_c"), F.lit(0).alias("_p"))
    met = want.unionByName(have).groupBy(*KEY).agg(F.sum("_c").alias("_c"), F.bit_or("_p").alias("_p"))
    apart = F.lit(False)
    for c in KEY:  # a null matches nothing
        apart = apart | F.col(c).isNull()
    no_point, no_candle = lambda k: apart | (F.col("_p").bitwiseAND(1 << k) == 0), apart | (F.col("_c") == 0)
    counts = [
        F.struct(
            F.lit(n).alias("indicator_name"),
            F.sum(F.when(no_point(k), F.col("_c")).otherwise(0)).alias("missing_points"),
            F.count_if(no_candle & (F.col("_p").bitwiseAND(1 << k) != 0)).alias("extra_points"),
            F.max((F.col("_c") > 0) | (F.col("_p").bitwiseAND(1 << k) != 0)).alias("met"),
        )
        for k, n in enumerate(REQUIRED)
    ]
    found = met.agg(F.array(*counts).alias("all")).select(F.inline("all")).where("met").drop("met")
    if mode == "report":
        return found
    rows = found.collect()  # one row per required indicator
    bad = [f"{r['indicator_name']}: {r['missing_points']} missing, {r['extra_points']} too many" for r in rows if r["missing_points"] or r["extra_points"]]
    if bad or len(rows) < len(REQUIRED) or candles.isEmpty():
        raise ValueError("indicators don't match the candles: " + ("; ".join(sorted(bad)) or "no candles"))
    return points


def regimes_of_points(candles: DataFrame, points: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The six states of every candle from indicators that come from outside, in the form of ``to_long``; raises if they don't match the candles."""
    inputs_check(candles, points, "raise")
    made = []
    for name in REQUIRED:
        mine = F.col("indicator_name") == name
        made.append(F.first(F.when(mine, F.col("status")), True).alias(f"{name}_status"))
        parts = ind(name).indicator.components
        made += [F.first(F.when(mine, F.col("components")[c]), True).alias(f"{name}_{c}") for c in parts] or [F.first(F.when(mine, F.col("value")), True).alias(name)]
    wide = points.where(F.col("indicator_name").isin(REQUIRED)).groupBy(*KEY).agg(*made)
    states = ["trend", "momentum", "volatility", "volume_regime", "structure", "composite_regime"]
    return classified(candles.select(*KEY, *NUMBERS).join(wide, KEY), bounds).select(*KEY, *NUMBERS, *states)


def _evidence(name: str, state: str, metrics: list[str]) -> Column:
    shown = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("string"))])
    text = F.concat(F.lit(f"{name} is "), F.col(state), F.lit(": "), F.concat_ws(", ", *[F.concat(F.lit(f"{m}="), F.coalesce(F.format_string("%.4f", F.col(m)), F.lit("none"))) for m in metrics]))
    return F.struct(F.lit(name).alias("dimension"), F.col(state).alias("state"), shown.alias("contributing_metrics"), text.alias("rationale"))


METRICS = {
    "trend": ["price_vs_sma", "sma_slope", "ema_slope"],
    "momentum": ["rsi", "roc", "macd_histogram"],
    "volatility": ["bollinger_bands_bandwidth"],
    "volume": ["rvol", "obv"],
    "structure": ["structure_breakout_distance_dist_high", "structure_breakout_distance_dist_low", "bollinger_bands_bandwidth", "sma", "sma_slope", "ema_slope"],
}


def regime_context(candles: DataFrame, bounds: Bounds = Bounds(), with_evidence: bool = False, states: list[str] = STATES) -> DataFrame:
    """The six states of every candle, or those asked for alone; on request with the metrics and a text per dimension, and with provenance (then all six)."""
    states = STATES if with_evidence else states
    names = needed(states)
    more = {"_obv_before": F.lag("obv").over(series())} if "obv" in names else {}
    if with_evidence:
        more["_start"] = F.first("timestamp").over(series().rowsBetween(-(2**63), 0))
    wide = compute(candles, names, keep_index=True, more=more)
    out = classified(wide, bounds, states)
    if not with_evidence:
        return out.select(*KEY, *NUMBERS, *states)
    entries = [x for d in DIMENSIONS for x in (F.lit(d), _evidence(d, "volume_regime" if d == "volume" else d, METRICS[d]))]
    combined = F.struct(F.lit("composite").alias("dimension"), F.col("composite_regime").alias("state"), F.create_map(*[x for c in ("trend", "momentum", "volatility", "structure") for x in (F.lit(c), F.col(c))]).alias("contributing_metrics"), F.concat(F.lit("composite is "), F.col("composite_regime")).alias("rationale"))
    provenance = F.struct(
        F.array(*[F.lit(n) for n in REQUIRED]).alias("indicators_used"),
        F.col("_start").alias("window_start"),
        F.col("timestamp").alias("window_end"),
        (F.col("_i") + 1).cast("long").alias("candles_evaluated"),
    )
    return out.select(*KEY, *states, F.create_map(*entries, F.lit("composite"), combined).alias("evidence"), provenance.alias("provenance"))


def regime_summary(contexts: DataFrame) -> DataFrame:
    """Candles by series and composite state."""
    return contexts.groupBy(*SERIES, "composite_regime").count()
