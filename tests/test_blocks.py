"""Indicators in blocks of a series equal those of the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.candles import KEY, NUMBERS, SCHEMA
from barloom.operators import blocks
from barloom.operators import indicators as I
from tests.conftest import DAY0, bar, timedelta

ALL = [c["name"] for c in I.catalog() if c["name"] != "relative_strength"]


def walk(spark, lengths, seed=5):
    rng, rows = np.random.default_rng(seed), []
    for symbol, n in lengths.items():
        close = 50.0
        for i in range(n):
            opened, close = close, max(1.0, close + float(rng.normal()) * (0 if 40 < i < 75 else 1))  # a flat stretch
            rows.append(bar(DAY0 + timedelta(minutes=i), close, opened, max(opened, close) + float(rng.random()), min(opened, close) * 0.99, float(rng.integers(0, 5)) * 100, symbol, timeframe="1m"))
    return spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], SCHEMA)


@pytest.fixture(scope="module")
def bars(spark):
    return walk(spark, {"LONG": 700, "MID": 121, "EVEN": 80, "ONE": 1, "TWO": 2, "FEW": 25}).cache()


def table(df):
    return {tuple(r[c] for c in KEY): r for r in df.collect()}


def agree(got, want):
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c, v in r.asDict().items():
            g = got[k][c]
            assert g == v or v is not None and g is not None and not isinstance(v, str) and abs(g - v) <= 1e-9 * max(1.0, abs(v)), (k, c, g, v)


@pytest.mark.parametrize("rows", [30, 40, 333, 5000])
def test_blocks_equal_whole_series(spark, bars, rows):
    agree(table(I.compute(bars, ALL, keep_index=True, block_rows=rows)), table(I.compute(bars, ALL, keep_index=True)))


def test_other_parameters(spark, bars):
    """Seeds longer than a block, lags of several candles, periods of one."""
    specs = [I.ind("ema", period=150), I.ind("ema_slope", period=7, lag=9), I.ind("rsi", period=1), I.ind("macd", fast_period=30, slow_period=90, signal_period=50), I.ind("atr", period=99), I.ind("natr", period=1), I.ind("sma", period=11), I.ind("obv")]
    agree(table(I.compute(bars, specs, block_rows=20)), table(I.compute(bars, specs)))


def test_relative_strength_in_blocks(spark, bars):
    mark = bars.where("symbol = 'LONG'").select("timeframe", "timestamp", (F.col("close") + 3).alias("close"))
    agree(table(I.compute(bars, ["relative_strength"], mark, block_rows=25)), table(I.compute(bars, ["relative_strength"], mark)))


def test_no_task_holds_more_than_a_block(spark, bars):
    made = blocks.cut(blocks.indexed(bars.select(*KEY, *NUMBERS)), 50, 20)
    sizes = {(r["symbol"], r["_block"]): r["count"] for r in made.groupBy("symbol", "_block").count().collect()}
    assert max(sizes.values()) == 70 and sizes["LONG", 0] == 50 and sizes["LONG", 13] == 70 and sizes["MID", 2] == 41 and sizes["EVEN", 1] == 50 and ("EVEN", 2) not in sizes
    places = made.where(F.col("_i") >= F.col("_block") * 50).groupBy("symbol").agg(F.countDistinct("_i").alias("n"), F.max("_i").alias("last"))
    assert {r["symbol"]: (r["n"], r["last"]) for r in places.collect()} == {s: (n, n - 1) for s, n in {"LONG": 700, "MID": 121, "EVEN": 80, "ONE": 1, "TWO": 2, "FEW": 25}.items()}


def test_scans_combine_like_one_run():
    """Affine maps of blocks, combined, end in the state of one run, for every scan and cut."""
    rng = np.random.default_rng(2)
    bars = {"close": rng.random(200) + 1, "step": rng.normal(size=200), "tr": rng.random(200), "volume": rng.random(200)}
    piece = lambda a, b: {k: v[a:b] for k, v in bars.items()}
    for name, scan in blocks.SCANS.items():
        parts, run = scan(I.ind(name).p)
        n = sum(p.size for p in parts)
        state = np.zeros(n)
        for a, b in ((0, 3), (3, 3), (3, 40), (40, 41), (41, 200)):
            none = {k: np.zeros(b - a) for k in bars}
            scale = np.array([run(none, a, unit)[1] for unit in np.eye(n)])
            state = state @ scale + run(piece(a, b), a, np.zeros(n))[1]
        assert np.allclose(state, run(bars, 0, np.zeros(n))[1], rtol=1e-12), name


def test_empty_and_broken_tables(spark, bars):
    none = bars.where("false")
    assert I.compute(none, ["ema", "sma"], block_rows=10).count() == 0
    twice = bars.unionByName(bars.where("symbol = 'LONG' and minute(timestamp) = 59"))
    with pytest.raises(Exception, match="ascend"):
        I.compute(twice, ["ema"], block_rows=60).collect()
    own = I.Indicator("whole", "series", lambda bars, p: {"": bars["close"].to_numpy()}, first=lambda p: 0, reach=lambda p: None, lookback=lambda p: 1)
    with pytest.raises(ValueError, match="whole"):
        I.compute(bars, [I.Spec(own, ())], block_rows=10)


def test_scans_run_over_many_series_at_once():
    """Streams of series cut into batches anywhere give what each series alone gives, lags over a cut included; rows out of order raise."""
    from barloom.operators.scans import Scans, streamed

    rng = np.random.default_rng(4)
    specs = [I.ind("ema", period=5), I.ind("ema_slope", period=4, lag=7), I.ind("rsi", period=3), I.ind("macd"), I.ind("atr", period=1), I.ind("natr"), I.ind("obv")]
    frames = []
    for n in (1, 90, 3, 200, 41, 60):
        close = np.maximum(1.0, 50 + rng.normal(size=n).cumsum())
        frames.append(pd.DataFrame({"_i": np.arange(n), "close": close, "_prev": np.append(np.nan, close[:-1]), "_tr": rng.random(n), "volume": rng.integers(0, 9, n) * 1.0}))
    rows = pd.concat(frames, ignore_index=True)
    run = lambda cuts: pd.concat(list(streamed(Scans(specs), (tuple(rows.iloc[a:b][c].reset_index(drop=True) for c in rows) for a, b in zip((0, *cuts), (*cuts, len(rows)))))), ignore_index=True)
    whole = run(())
    for cuts in ((1, 2, 3, 50, 91, 94, 95, 96), tuple(range(1, len(rows))), (0, 150, 150, 333)):
        assert np.allclose(run(cuts).to_numpy(float), whole.to_numpy(float), rtol=1e-11, equal_nan=True)
    at = 0
    for f in frames:  # the plain recurrences
        for s in specs[:6]:
            made = s.indicator.build(f.assign(_tr=f["_tr"]), s.p)
            for c, v in made.items():
                got = whole.iloc[at : at + len(f)][f"{s.name}_bad" if c == "invalid" else f"{s.name}_{c}" if c else s.name].to_numpy()
                assert np.allclose(np.asarray(v, dtype=float), got.astype(float), rtol=1e-9, equal_nan=True), (s.name, c)
        at += len(f)
    rows = rows.iloc[[0, 1, 3, 2]]
    with pytest.raises(RuntimeError, match="order"):
        run(())


def test_numbers_that_are_not_finite_stay_in_their_run():
    from barloom.operators.scans import Average, Runs

    x = np.array([1.0, 2.0, np.nan, 4.0, 1.0, 2.0, 3.0, 4.0, np.inf, 1.0])
    runs, part = Runs(np.array([0, 1, 2, 3, 0, 1, 2, 3, 4, 5]), np.array([0, 4])), Average(0, 2, 0.5)
    out, _ = part.run(x, runs, np.zeros((2, 2)))
    assert out[4:8].tolist()[1:] == [1.5, 2.25, 3.125] and np.isnan(out[0]) and out[1] == 1.5


def test_blocks_need_no_python_per_block(spark, bars):
    """Tasks go through their blocks in batches; a pass of one call for each block took most of the time."""
    plan = I.compute(bars, ["ema", "macd", "rsi"], block_rows=40)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas [symbol" not in plan and "FlatMap" not in plan


def test_series_without_a_name_in_blocks(spark):
    """Null keys are a series too."""
    df = walk(spark, {"AAA": 95, "BBB": 50}, 9).withColumn("symbol", F.when(F.col("symbol") == "AAA", F.col("symbol")))
    agree(table(I.compute(df, ["ema", "obv", "ema_slope"], block_rows=30)), table(I.compute(df, ["ema", "obv", "ema_slope"])))
