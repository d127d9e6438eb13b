import pytest
from tests.conftest import trend_bars
from pyspark.sql import functions as F

from barloom.operators import indicators, regime
from barloom.operators.regime import Bounds


def state(spark, column, **values):
    """The state that ``column`` gives for one row of values; all indicators are VALID."""
    status = {f"{n}_status": "VALID" for n in regime.REQUIRED}
    row = {**status, **values}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(column.alias("s")).first()["s"]


@pytest.mark.parametrize("p,s,e,want", [(0.006, 0.1, 0.1, "BULLISH"), (0.005, 0.1, 0.1, "SIDEWAYS"), (-0.006, -0.1, -0.1, "BEARISH"), (-0.005, -0.1, -0.1, "SIDEWAYS"), (0.006, 0.0, 0.1, "SIDEWAYS")])
def test_trend(spark, p, s, e, want):
    assert state(spark, regime.trend(), price_vs_sma=p, sma_slope=s, ema_slope=e) == want


@pytest.mark.parametrize("r,c,h,want", [(55.0, 0.1, 0.1, "POSITIVE"), (54.9, 0.1, 0.1, "NEUTRAL"), (45.0, -0.1, -0.1, "NEGATIVE"), (45.1, -0.1, -0.1, "NEUTRAL"), (60.0, 0.0, 0.1, "NEUTRAL")])
def test_momentum(spark, r, c, h, want):
    assert state(spark, regime.momentum(), rsi=r, roc=c, macd_histogram=h) == want


@pytest.mark.parametrize("b,want", [(0.029, "LOW"), (0.030, "NORMAL"), (0.080, "NORMAL"), (0.081, "HIGH")])
def test_volatility(spark, b, want):
    assert state(spark, regime.volatility(), bollinger_bands_bandwidth=b) == want


@pytest.mark.parametrize("r,c,step,want", [(1.2, 2.0, 1.0, "ACCUMULATION"), (1.2, 0.0, -1.0, "DISTRIBUTION"), (1.2, 2.0, -1.0, "HIGH_VOLUME"), (0.79, 2.0, 1.0, "LOW_VOLUME"), (0.8, 2.0, 1.0, "NORMAL_VOLUME")])
def test_volume(spark, r, c, step, want):
    assert state(spark, regime.volume(), rvol=r, close=c, open=1.0, obv=step, _obv_before=0.0) == want


@pytest.mark.parametrize(
    "hi,lo,bw,dh,dl,c,slope,want",
    [(1.0, 0.0, 0.01, 0.0, 5.0, 10.0, 1.0, "BREAKOUT"), (0.0, 1.0, 0.01, 0.0, 5.0, 10.0, 1.0, "BREAKDOWN"), (0.0, 0.0, 0.030, -1.0, 5.0, 10.0, 1.0, "CONSOLIDATION"), (0.0, 0.0, 0.05, -2.0, 5.0, 10.0, 1.0, "TRENDING"), (0.0, 0.0, 0.05, -2.1, 5.0, 10.0, 1.0, "RANGING"), (0.0, 0.0, 0.05, -9.0, 2.0, 8.0, -1.0, "TRENDING")],
)
def test_structure(spark, hi, lo, bw, dh, dl, c, slope, want):
    got = state(spark, regime.structure(), structure_breakout_distance_breakout_high=hi, structure_breakout_distance_breakdown_low=lo, bollinger_bands_bandwidth=bw, structure_breakout_distance_dist_high=dh, structure_breakout_distance_dist_low=dl, close=c, sma=9.0, sma_slope=slope, ema_slope=slope)
    assert got == want


@pytest.mark.parametrize(
    "t,m,v,s,want",
    [
        ("INSUFFICIENT_DATA", "POSITIVE", "LOW", "BREAKOUT", "INSUFFICIENT_DATA"),
        ("BULLISH", "NEGATIVE", "HIGH", "RANGING", "DIVERGENT"),
        ("BEARISH", "POSITIVE", "LOW", "CONSOLIDATION", "DIVERGENT"),
        ("SIDEWAYS", "NEUTRAL", "HIGH", "RANGING", "VOLATILE_UNSTRUCTURED"),
        ("BULLISH", "POSITIVE", "HIGH", "BREAKOUT", "BULLISH_TRENDING_EXPANSION"),
        ("BEARISH", "NEGATIVE", "NORMAL", "TRENDING", "BEARISH_TRENDING_EXPANSION"),
        ("BULLISH", "POSITIVE", "LOW", "CONSOLIDATION", "BULLISH_CONSOLIDATION"),
        ("BEARISH", "NEUTRAL", "LOW", "CONSOLIDATION", "BEARISH_CONSOLIDATION"),
        ("SIDEWAYS", "NEUTRAL", "LOW", "CONSOLIDATION", "COMPRESSION"),
        ("SIDEWAYS", "NEUTRAL", "NORMAL", "RANGING", "SIDEWAYS_RANGE"),
        ("BULLISH", "NEUTRAL", "NORMAL", "RANGING", "UNKNOWN"),
    ],
)
def test_composite(spark, t, m, v, s, want):
    assert state(spark, regime.composite(), trend=t, momentum=m, volatility=v, structure=s) == want


def test_not_ready(spark):
    assert state(spark, regime.volatility(), bollinger_bands_bandwidth=0.01, bollinger_bands_status="INVALID") == "INSUFFICIENT_DATA"


@pytest.mark.parametrize("bad", [{"slope": -1}, {"distance": 0}, {"bullish_rsi": 50}, {"bearish_rsi": 50}, {"low_bandwidth": 0.1}, {"high_rvol": 1}, {"low_rvol": 1}, {"channel": 0}, {"consolidation": 0}])
def test_bounds(bad):
    with pytest.raises(ValueError):
        Bounds(**bad)


def test_pipeline(spark):
    rows = regime.regime_context(trend_bars(spark, 60, 3000.0, 50000.0), with_evidence=True).orderBy("timestamp").collect()
    assert rows[0]["composite_regime"] == "INSUFFICIENT_DATA" and rows[-1]["composite_regime"] not in (None, "INSUFFICIENT_DATA")
    assert rows[-1]["provenance"]["candles_evaluated"] == 60 and len(rows[-1]["evidence"]) == 6
    first = next(i for i, r in enumerate(rows) if r["composite_regime"] != "INSUFFICIENT_DATA")
    assert first == 33


def test_inputs_check(spark):
    df = trend_bars(spark, 40)
    points = indicators.to_long(df, regime.REQUIRED)
    clean = regime.inputs_check(df, points).collect()
    assert len(clean) == 11 and all(r["missing_points"] == r["extra_points"] == 0 for r in clean)
    missing = regime.inputs_check(df, points.where("indicator_name <> 'rsi'")).where("indicator_name = 'rsi'").first()
    assert missing["missing_points"] == 40


def test_inputs_that_do_not_match_raise(spark):
    df = trend_bars(spark, 40)
    points = indicators.to_long(df, regime.REQUIRED).persist()
    want = sorted(map(tuple, regime.regime_context(df).collect()))
    assert sorted(map(tuple, regime.regimes_of_points(df, points).collect())) == want
    for bad in (points.where("indicator_name <> 'rsi'"), points.where("provenance.candles_analyzed <> 7"), points.where("false")):
        with pytest.raises(ValueError, match="match"):
            regime.regimes_of_points(df, bad)
    with pytest.raises(ValueError, match="match"):
        regime.inputs_check(df.limit(30), points, "raise")


def test_a_state_reads_its_own_indicators_alone(spark):
    """A query of one dimension neither makes the other indicators nor runs Python per series; its states are those of the whole."""
    df = trend_bars(spark, 60, 3000.0, 50000.0).unionByName(trend_bars(spark, 45, 50.0, 10.0, symbol="BBB"))
    whole = {(r["symbol"], r["timestamp"]): r for r in regime.regime_context(df).collect()}
    for state in regime.STATES:
        out = regime.regime_context(df, states=[state])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 1, plan
        assert ("macd" in plan) == (state in ("momentum", "composite_regime")) and ("ArrowEvalPython" in plan) == (state not in ("volatility", "volume_regime"))
        got = out.collect()
        assert len(got) == 105 and all(r[state] == whole[r["symbol"], r["timestamp"]][state] for r in got)


def test_all_states_share_one_exchange(spark):
    plan = regime.regime_context(trend_bars(spark, 40), with_evidence=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1


def test_inputs_check_counts_one_row_a_candle(spark):
    """No row for each indicator goes through a shuffle; nulls, repeats and foreign points count as in a join per indicator."""
    from pyspark.sql import functions as F

    df = trend_bars(spark, 40)
    points = indicators.to_long(df, regime.REQUIRED)
    plan = regime.inputs_check(df, points)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "ArrowEvalPython" not in plan  # values of points that nobody reads aren't made
    k = [*("symbol", "exchange", "timeframe", "timestamp"), "indicator_name"]
    odd = points.select(*k).where("not (indicator_name = 'roc' and day(timestamp) <= 3)")
    more = odd.where("indicator_name = 'rsi'").limit(1)
    odd = odd.unionByName(more).unionByName(more.withColumn("symbol", F.lit("ZZZ"))).unionByName(more.withColumn("symbol", F.lit(None).cast("string"))).unionByName(more.withColumn("indicator_name", F.lit("own")))
    candles = df.unionByName(df.limit(2)).unionByName(df.limit(1).withColumn("symbol", F.lit(None).cast("string")))
    want = candles.select(*k[:4]).withColumn("indicator_name", F.explode(F.array(*[F.lit(n) for n in regime.REQUIRED]))).withColumn("_c", F.lit(1))
    have = odd.where(F.col("indicator_name").isin(regime.REQUIRED)).distinct().withColumn("_p", F.lit(1))
    plain = want.join(have, k, "full_outer").groupBy("indicator_name").agg(F.count_if(F.col("_p").isNull()).alias("missing_points"), F.count_if(F.col("_c").isNull()).alias("extra_points"))
    assert sorted(map(tuple, regime.inputs_check(candles, odd).collect())) == sorted(map(tuple, plain.collect()))
    assert [tuple(r) for r in regime.inputs_check(df.limit(0), odd.where("indicator_name = 'rsi' and symbol = 'ZZZ'")).collect()] == [("rsi", 0, 1)]
    assert regime.inputs_check(df.limit(0), odd.limit(0)).count() == 0
