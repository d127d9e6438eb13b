import math

import numpy as np
import pytest
from tests.conftest import trend_bars
from pyspark.sql import functions as F

from barloom.functions.candles import KEY
from barloom.operators import indicators as I


def values(df, spec, column=None, benchmark=None):
    spec = I.ind(spec) if isinstance(spec, str) else spec
    rows = I.compute(df, [spec], benchmark).orderBy("timestamp").collect()
    return [r[column or spec.columns()[0]] for r in rows], [r[f"{spec.name}_status"] for r in rows]


def test_true_range_and_atr(candles):
    df = candles([100, 118, 88], [105, 120, 90], [95, 115, 85])
    assert values(df, "true_range")[0] == [10, 20, 33]
    df = candles([100, 110, 140], [105, 120, 140], [95, 100, 110])
    assert values(df, I.ind("atr", period=3))[0] == [None, None, 20]
    natr, status = values(df, I.ind("natr", period=3))
    assert natr[2] == pytest.approx(20 / 140 * 100) and status == ["INSUFFICIENT_DATA"] * 2 + ["VALID"]


def test_std_and_bollinger(candles):
    got, _ = values(candles([2, 4, 4, 4, 5, 5, 7, 9]), I.ind("rolling_std", period=8))
    assert got[:7] == [None] * 7 and got[7] == pytest.approx(math.sqrt(32 / 7))
    b = I.ind("bollinger_bands", period=3, std_multiplier=2.0)
    assert values(candles([0, 0, 0]), b)[1][2] == "INVALID"
    flat = I.compute(candles([100, 100, 100]), [b]).orderBy("timestamp").collect()[2]
    assert (flat["bollinger_bands_upper"], flat["bollinger_bands_lower"], flat["bollinger_bands_bandwidth"], flat["bollinger_bands_percent_b"]) == (100, 100, 0, 0.5)
    r = I.compute(candles([10, 12, 14]), [b]).orderBy("timestamp").collect()[2]
    assert [r[f"bollinger_bands_{c}"] for c in ("middle", "upper", "lower")] == [12, 16, 8]
    assert r["bollinger_bands_bandwidth"] == pytest.approx(2 / 3) and r["bollinger_bands_percent_b"] == pytest.approx(0.75)


def test_momentum(candles):
    assert values(candles([100, 105, 110, 120]), I.ind("roc", period=3))[0][3] == pytest.approx(20)
    got, _ = values(candles([44.34, 44.09, 44.15, 43.61, 44.33]), I.ind("rsi", period=3))
    assert got[3:] == [pytest.approx(7.058823529), pytest.approx(59.067357513)]
    assert values(candles([10, 11, 12, 13, 14]), I.ind("rsi", period=3))[0][-1] == 100
    assert values(candles([10] * 5), I.ind("rsi", period=3))[0][-1] == 50
    m = I.ind("macd", fast_period=2, slow_period=4, signal_period=2)
    rows = I.compute(candles([10, 12, 14, 16, 18, 20]), [m]).orderBy("timestamp").collect()
    assert all(r["macd_histogram"] is None for r in rows[:4])
    assert all(r["macd_histogram"] == pytest.approx(r["macd_macd"] - r["macd_signal"]) for r in rows[4:])


def test_volume(candles):
    assert values(candles([1, 2, 3], volumes=[0, 0, 0]), I.ind("rvol", period=3))[1][2] == "INVALID"
    assert values(candles([1, 2, 3], volumes=[100, 200, 300]), I.ind("rvol", period=3))[0][2] == 1.5
    got, status = values(candles([1, 2, 3], volumes=[0, 100, 150]), "volume_change")
    assert status == ["INSUFFICIENT_DATA", "INVALID", "VALID"] and got[2] == 50
    assert values(candles([100, 102, 102, 101], volumes=[1000, 500, 300, 400]), "obv")[0] == [0, 500, 500, 100]


def test_relative_strength(candles):
    s = I.ind("relative_strength", period=2)
    mark = candles([200, 210, 220], symbol="MKT")
    rows = I.compute(candles([100, 110, 120]), [s], mark).orderBy("timestamp").collect()
    assert rows[2]["relative_strength_excess_return"] == pytest.approx(10) and rows[2]["relative_strength_outperformance_ratio"] == pytest.approx(1 / 11)
    got, status = values(candles([100, 110, 120]), s, benchmark=mark.where("close < 215"))
    assert got[2] is None and status[2] == "INSUFFICIENT_DATA"
    with pytest.raises(ValueError):
        I.compute(candles([1, 2]), [s])
    with pytest.raises(ValueError):
        I.compute(candles([1, 2]), [s], mark.unionByName(mark))


@pytest.mark.parametrize("name", [c["name"] for c in I.catalog()])
def test_bounds(name):
    spec = I.ind(name)
    for p, least in spec.indicator.least.items():
        with pytest.raises(ValueError):
            I.ind(name, **{p: least - 1})
    with pytest.raises(ValueError):
        I.ind(name, nonsense=1)


def test_registry():
    assert len(I.catalog()) == 21 and [c["name"] for c in I.catalog()] == sorted(c["name"] for c in I.catalog())
    with pytest.raises(KeyError):
        I.ind("nonsense")
    with pytest.raises(ValueError):
        I.register(I.ind("SMA").indicator)
    with pytest.raises(ValueError):
        I.ind("macd", fast_period=30)


def test_no_look_ahead(spark):
    """All indicators on a prefix, and on data with a later spike, equal those on the whole."""
    names = [c["name"] for c in I.catalog()]
    mark = trend_bars(spark, 100, 200.0, symbol="MKT")
    run = lambda df: [tuple(r) for r in I.compute(df, names, mark).where(F.col("timestamp") < "2026-02-20").orderBy("timestamp").collect()]
    whole = run(trend_bars(spark, 100))
    assert len(whole) == 50
    assert run(trend_bars(spark, 50)) == whole
    assert run(trend_bars(spark, 100, spike=50)) == whole


def test_many_series_and_partition_counts(spark):
    """Series don't touch each other, and the number of shuffle partitions changes nothing."""
    both = trend_bars(spark, 40).unionByName(trend_bars(spark, 40, 500.0, symbol="BBB"))
    names = ["sma", "ema", "rsi", "macd", "atr", "obv"]
    run = lambda df: sorted(map(tuple, I.compute(df, names).collect()))
    alone = sorted(run(trend_bars(spark, 40)) + run(trend_bars(spark, 40, 500.0, symbol="BBB")))
    assert run(both) == alone
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert run(both) == alone
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recurrences_against_a_loop(candles):
    rng = np.random.default_rng(3)
    close = np.round(100 + np.cumsum(rng.normal(0, 1, 80)), 3).tolist()
    got, _ = values(candles(close), I.ind("ema", period=5))
    e = None
    for i, c in enumerate(close):
        e = sum(close[:5]) / 5 if i == 4 else e if e is None else c * 2 / 6 + e * 4 / 6
        assert got[i] is None if i < 4 else got[i] == pytest.approx(e)
    got, _ = values(candles(close), I.ind("rsi", period=5))
    gains, losses = ([max(s * (b - a), 0) for a, b in zip(close, close[1:])] for s in (1, -1))
    g, l = sum(gains[:5]) / 5, sum(losses[:5]) / 5
    for i in range(5, 80):
        if i > 5:
            g, l = (g * 4 + gains[i - 1]) / 5, (l * 4 + losses[i - 1]) / 5
        assert got[i] == pytest.approx(100 - 100 / (1 + g / l))


def test_one_exchange_and_sort(spark):
    """Windows and the recursive helper share one shuffle."""
    plan = I.compute(trend_bars(spark, 10).repartition(3), ["sma", "rolling_std", "obv", "rsi", "ema"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_long_form_and_latest(spark):
    df = trend_bars(spark, 30)
    points = I.to_long(df, ["sma", "macd", "true_range"]).orderBy("indicator_name", "timestamp").collect()
    assert len(points) == 90
    sma = [p for p in points if p["indicator_name"] == "sma"]
    assert sma[25]["provenance"]["candles_analyzed"] == 26 and (sma[25]["timestamp"] - sma[25]["provenance"]["source_window_start"]).days == 19
    assert sma[3]["provenance"]["source_window_start"] == sma[0]["timestamp"] and sma[25]["provenance"]["parameters"] == {"period": "20"}
    assert [p["provenance"]["lookback_period"] for p in points if p["indicator_name"] == "true_range"][:2] == [1, 2]
    assert all(p["components"] is None and p["value"] is None for p in points if p["indicator_name"] == "macd")
    last = I.latest_point(df, ["sma"]).collect()
    assert len(last) == 1 and last[0]["sma"] == pytest.approx(109.75)


def test_empty_table(spark, candles):
    none = candles([1.0]).where("false")
    assert I.compute(none, ["sma", "ema"]).count() == 0 and set(KEY) < set(I.compute(none, ["sma", "ema"]).columns)


def test_broken_series_fail_closed(spark):
    """Repeated stamps, numbers that aren't finite and bars that contradict themselves give no numbers."""
    good = trend_bars(spark, 30)
    assert I.compute(good, ["sma"]).count() == 30
    for bad in (good.unionByName(good.limit(1)), good.withColumn("close", F.lit(float("nan"))), good.withColumn("high", F.lit(0.0)), good.withColumn("volume", F.lit(-1.0))):
        with pytest.raises(Exception, match="breaks the series contract"):
            I.compute(bad, ["sma"]).collect()
        assert I.compute(bad, ["sma"], strict=False).count() >= 30


def test_filters_after_recurrences_stay_after_them(spark):
    """A filter on rows or columns of the result doesn't take candles from the averages."""
    df = trend_bars(spark, 80).unionByName(trend_bars(spark, 50, symbol="BBB"))
    names = ["ema", "ema_slope", "macd", "rsi"]
    whole = I.compute(df, names).collect()
    late = I.compute(df, names).where("day(timestamp) % 3 = 0 and close > 110")
    assert sorted(map(repr, late.collect())) == sorted(repr(r) for r in whole if r["timestamp"].day % 3 == 0 and r["close"] > 110)
    blocks = I.compute(df, names, block_rows=30).where("day(timestamp) % 3 = 0 and close > 110").collect()
    assert len(blocks) == late.count() > 10
