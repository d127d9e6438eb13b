"""SQL of the market-data queries, for engines that hold the same tables."""

from __future__ import annotations

from barloom.jobs.adapters import EVENT, MARKET, RAW, RAW_ERRORS, SEQ, WALK

KEY = 'symbol, exchange, timeframe, "timestamp"'
BARS = 'symbol, exchange, timeframe, "timestamp", open, high, low, close, volume'
BY = 'PARTITION BY symbol, exchange, timeframe ORDER BY "timestamp"'


def frame(f: str, first: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last} PRECEDING"
    return f"({f} OVER ({BY} ROWS BETWEEN {-first} PRECEDING AND {end}))"


INDEXED = f"""x AS MATERIALIZED (
  SELECT *, row_number() OVER ({BY}) - 1 AS i, lag(close) OVER ({BY}) AS pc FROM bars)"""
SMA, VSMA, STD = frame("avg(close)", -19), frame("avg(volume)", -19), frame("stddev_samp(close)", -19)
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"

#: name -> (inner columns over x, first valid row, invalid condition, outputs)
WINDOWED = {
    "sma": (f"{SMA} AS m", 19, "false", {"sma": "m"}),
    "price_vs_sma": (f"{SMA} AS m", 19, "m <= 0", {"price_vs_sma": "(close - m) / m"}),
    "sma_slope": (f"{SMA} AS m, {frame('avg(close)', -20, -1)} AS n", 20, "false", {"sma_slope": "m - n"}),
    "roc": (f"lag(close, 14) OVER ({BY}) AS c0", 14, "c0 <= 0", {"roc": "(close - c0) / c0 * 100"}),
    "volume_sma": (f"{VSMA} AS m", 19, "false", {"volume_sma": "m"}),
    "rvol": (f"{VSMA} AS m", 19, "m = 0", {"rvol": "volume / m"}),
    "volume_change": (f"lag(volume, 1) OVER ({BY}) AS v0", 1, "v0 = 0", {"volume_change": "(volume - v0) / v0 * 100"}),
    "obv": (f"sum(coalesce(sign(close - pc) * volume, 0)) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS m", 0, "false", {"obv": "m"}),
    "true_range": ("1 AS one", 0, "false", {"true_range": TR}),
    "rolling_std": (f"{STD} AS m", 19, "false", {"rolling_std": "m"}),
    "bollinger_bands": (
        f"{SMA} AS m, {STD} AS s",
        19,
        "m <= 0",
        {
            "bollinger_bands_middle": "m",
            "bollinger_bands_upper": "m + s * 2.0::DOUBLE",
            "bollinger_bands_lower": "m - s * 2.0::DOUBLE",
            "bollinger_bands_bandwidth": "CASE WHEN s = 0 THEN 0 ELSE ((m + s * 2.0::DOUBLE) - (m - s * 2.0::DOUBLE)) / m END",
            "bollinger_bands_percent_b": "CASE WHEN s = 0 THEN 0.5 ELSE (close - (m - s * 2.0::DOUBLE)) / ((m + s * 2.0::DOUBLE) - (m - s * 2.0::DOUBLE)) END",
        },
    ),
    "rolling_high": (f"{frame('max(high)', -19)} AS m", 19, "false", {"rolling_high": "m"}),
    "rolling_low": (f"{frame('min(low)', -19)} AS m", 19, "false", {"rolling_low": "m"}),
    "structure_breakout_distance": (
        f"{frame('max(high)', -20, -1)} AS t, {frame('min(low)', -20, -1)} AS u",
        20,
        "t <= 0 OR u <= 0",
        {
            "structure_breakout_distance_dist_high": "(close - t) / t * 100",
            "structure_breakout_distance_dist_low": "(close - u) / u * 100",
            "structure_breakout_distance_breakout_high": "(close > t)::INT::DOUBLE",
            "structure_breakout_distance_breakdown_low": "(close < u)::INT::DOUBLE",
        },
    ),
}


def shown(name: str, first: int, invalid: str, outputs: dict[str, str], source: str, digits: int | None = 6) -> str:
    status = f"CASE WHEN i < {first} THEN 'INSUFFICIENT_DATA' WHEN {invalid} THEN 'INVALID' ELSE 'VALID' END"
    rounded = (lambda e: f"round({e}, {digits}) + 0.0::DOUBLE") if digits is not None else (lambda e: e)
    cols = ", ".join(f"CASE WHEN i >= {first} AND NOT ({invalid}) THEN {rounded(e)} END AS {c}" for c, e in outputs.items())
    return f"SELECT {KEY}, {cols}, {status} AS {name}_status FROM {source}"


def windowed(name: str) -> str:
    inner, first, invalid, outputs = WINDOWED[name]
    return f"WITH {WALK}, {INDEXED}, y AS (SELECT *, {inner} FROM x) {shown(name, first, invalid, outputs, 'y')}"


def smoothed(name: str, source: str, value: str, n: int, begin: int, alpha: str) -> str:
    """A recursive table ``name (symbol, i, v)``: the mean of the first ``n`` values from ``begin``, then the recurrence."""
    return f"""{name} AS (
  SELECT symbol, {begin + n - 1}::BIGINT AS i, avg({value}) AS v FROM {source} WHERE i BETWEEN {begin} AND {begin + n - 1} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL
  SELECT s.symbol, s.i, {alpha} * s.{value} + (1 - {alpha}) * r.v FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1)"""


E20 = smoothed("e20", "x", "close", 20, 0, "(2.0::DOUBLE / 21)")
GAINS = f"g AS MATERIALIZED (SELECT *, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss, {TR} AS tr FROM x)"
RSI_PARTS = f"{GAINS}, up AS (SELECT * FROM (WITH RECURSIVE {smoothed('u', 'g', 'gain', 14, 1, '(1.0::DOUBLE / 14)')} SELECT * FROM u)), down AS (SELECT * FROM (WITH RECURSIVE {smoothed('d', 'g', 'loss', 14, 1, '(1.0::DOUBLE / 14)')} SELECT * FROM d))"
RSI = "CASE WHEN down.v = 0 THEN CASE WHEN up.v > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + up.v / down.v) END"
MACD_PARTS = f"""{smoothed("e12", "x", "close", 12, 0, "(2.0::DOUBLE / 13)")}, {smoothed("e26", "x", "close", 26, 0, "(2.0::DOUBLE / 27)")},
line AS MATERIALIZED (SELECT e26.symbol, e26.i, e12.v - e26.v AS macd FROM e26 JOIN e12 ON e12.symbol = e26.symbol AND e12.i = e26.i), {smoothed("sig", "line", "macd", 9, 25, "(2.0::DOUBLE / 10)")}"""
JOIN = "LEFT JOIN {0} ON {0}.symbol = x.symbol AND {0}.i = x.i"


def recursive(name: str) -> str:
    head = f"WITH RECURSIVE {WALK}, {INDEXED}"
    if name == "ema":
        return f"{head}, {E20}, y AS (SELECT x.*, e20.v FROM x {JOIN.format('e20')}) {shown(name, 19, 'false', {'ema': 'v'}, 'y')}"
    if name == "ema_slope":
        return f"{head}, {E20}, y AS (SELECT x.*, e20.v - lag(e20.v) OVER (PARTITION BY x.symbol ORDER BY x.i) AS v FROM x {JOIN.format('e20')}) {shown(name, 20, 'false', {'ema_slope': 'v'}, 'y')}"
    if name == "rsi":
        return f"{head}, {RSI_PARTS}, y AS (SELECT x.*, {RSI} AS v FROM x {JOIN.format('up')} {JOIN.format('down')}) {shown(name, 14, 'false', {'rsi': 'v'}, 'y')}"
    if name == "macd":
        return f"{head}, {MACD_PARTS}, y AS (SELECT x.*, macd AS l, sig.v AS s FROM x {JOIN.format('line')} {JOIN.format('sig')}) {shown(name, 33, 'false', {'macd_macd': 'l', 'macd_signal': 's', 'macd_histogram': 'l - s'}, 'y')}"
    atr = smoothed("a", "g", "tr", 14, 0, "(1.0::DOUBLE / 14)")
    outputs = {"atr": "v"} if name == "atr" else {"natr": "v / close * 100"}
    return f"{head}, {GAINS}, {atr}, y AS (SELECT x.*, a.v FROM x {JOIN.format('a')}) {shown(name, 13, 'false' if name == 'atr' else 'close <= 0', outputs, 'y')}"


STRENGTH = f"""
WITH {WALK}, {MARKET}, {INDEXED},
p AS (SELECT *, lag(close, 20) OVER ({BY}) AS c0, lag("timestamp", 20) OVER ({BY}) AS t0 FROM x),
y AS (SELECT p.*, m.close AS b, n.close AS b0 FROM p LEFT JOIN market m ON m.timeframe = p.timeframe AND m."timestamp" = p."timestamp" LEFT JOIN market n ON n.timeframe = p.timeframe AND n."timestamp" = p.t0)
{shown("relative_strength", 20, "c0 <= 0 OR b <= 0 OR b0 <= 0", {"relative_strength_excess_return": "((close - c0) / c0 - (b - b0) / b0) * 100", "relative_strength_outperformance_ratio": "(close / c0) / (b / b0) - 1"}, "y")}"""

REGIMES = f"""
WITH RECURSIVE {WALK}, {INDEXED}, {E20}, {RSI_PARTS}, {MACD_PARTS},
wide AS (
  SELECT x.*, {SMA} AS sma, {frame("avg(close)", -20, -1)} AS sma0, {STD} AS sd, {VSMA} AS vsma, lag(close, 14) OVER ({BY}) AS c14,
         sum(coalesce(sign(close - pc) * volume, 0)) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS obv, {frame("max(high)", -20, -1)} AS t, {frame("min(low)", -20, -1)} AS u
  FROM x),
m AS (
  SELECT x.*, (x.close - sma) / sma AS pvs, sma - sma0 AS ss, e20.v - lag(e20.v) OVER (PARTITION BY x.symbol ORDER BY x.i) AS es, {RSI} AS rsi,
         (x.close - c14) / c14 * 100 AS roc, macd - sig.v AS hist, CASE WHEN sd = 0 THEN 0 ELSE ((sma + sd * 2.0::DOUBLE) - (sma - sd * 2.0::DOUBLE)) / sma END AS bw,
         CASE WHEN vsma <> 0 THEN volume / vsma END AS rvol, obv - lag(obv) OVER (PARTITION BY x.symbol ORDER BY x.i) AS step, (x.close - t) / t * 100 AS dh, (x.close - u) / u * 100 AS dl
  FROM wide x {JOIN.format("e20")} {JOIN.format("up")} {JOIN.format("down")} {JOIN.format("line")} {JOIN.format("sig")}),
r AS (
  SELECT *,
    CASE WHEN i < 20 THEN 'INSUFFICIENT_DATA' WHEN pvs > 0.005::DOUBLE AND ss > 0 AND es > 0 THEN 'BULLISH' WHEN pvs < -0.005::DOUBLE AND ss < 0 AND es < 0 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS trend,
    CASE WHEN i < 33 THEN 'INSUFFICIENT_DATA' WHEN rsi >= 55 AND roc > 0 AND hist > 0 THEN 'POSITIVE' WHEN rsi <= 45 AND roc < 0 AND hist < 0 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS momentum,
    CASE WHEN i < 19 THEN 'INSUFFICIENT_DATA' WHEN bw < 0.03::DOUBLE THEN 'LOW' WHEN bw > 0.08::DOUBLE THEN 'HIGH' ELSE 'NORMAL' END AS volatility,
    CASE WHEN i < 19 OR rvol IS NULL THEN 'INSUFFICIENT_DATA' WHEN rvol >= 1.2::DOUBLE AND close > open AND step > 0 THEN 'ACCUMULATION' WHEN rvol >= 1.2::DOUBLE AND close < open AND step < 0 THEN 'DISTRIBUTION'
         WHEN rvol >= 1.2::DOUBLE THEN 'HIGH_VOLUME' WHEN rvol < 0.8::DOUBLE THEN 'LOW_VOLUME' ELSE 'NORMAL_VOLUME' END AS volume_regime,
    CASE WHEN i < 20 THEN 'INSUFFICIENT_DATA' WHEN close > t THEN 'BREAKOUT' WHEN close < u THEN 'BREAKDOWN' WHEN bw <= 0.03::DOUBLE THEN 'CONSOLIDATION'
         WHEN (dh >= -2 AND close > sma AND ss > 0 AND es > 0) OR (dl <= 2 AND close < sma AND ss < 0 AND es < 0) THEN 'TRENDING' ELSE 'RANGING' END AS structure
  FROM m),
regimes AS (
  SELECT *, CASE WHEN 'INSUFFICIENT_DATA' IN (trend, momentum, volatility, structure) THEN 'INSUFFICIENT_DATA'
    WHEN (trend = 'BULLISH' AND momentum = 'NEGATIVE') OR (trend = 'BEARISH' AND momentum = 'POSITIVE') THEN 'DIVERGENT'
    WHEN volatility = 'HIGH' AND structure = 'RANGING' THEN 'VOLATILE_UNSTRUCTURED'
    WHEN trend = 'BULLISH' AND momentum = 'POSITIVE' AND structure IN ('BREAKOUT', 'TRENDING') THEN 'BULLISH_TRENDING_EXPANSION'
    WHEN trend = 'BEARISH' AND momentum = 'NEGATIVE' AND structure IN ('BREAKDOWN', 'TRENDING') THEN 'BEARISH_TRENDING_EXPANSION'
    WHEN trend = 'BULLISH' AND structure = 'CONSOLIDATION' THEN 'BULLISH_CONSOLIDATION' WHEN trend = 'BEARISH' AND structure = 'CONSOLIDATION' THEN 'BEARISH_CONSOLIDATION'
    WHEN volatility = 'LOW' AND structure = 'CONSOLIDATION' THEN 'COMPRESSION' WHEN trend = 'SIDEWAYS' AND structure IN ('RANGING', 'CONSOLIDATION') THEN 'SIDEWAYS_RANGE' ELSE 'UNKNOWN' END AS composite_regime
  FROM r)
"""


def regime(*columns: str) -> str:
    return f"{REGIMES} SELECT {KEY}, {', '.join(columns)} FROM regimes"


EVIDENCE = (
    "concat('trend=', trend, ';momentum=', momentum, ';volatility=', volatility, ';volume=', volume_regime, ';structure=', structure, ';composite=', composite_regime) AS evidence_states",
    "'bollinger_bands_bandwidth,ema_slope,sma,sma_slope,structure_breakout_distance_dist_high,structure_breakout_distance_dist_low' AS structure_metrics",
    "'price_vs_sma,sma_slope,ema_slope,sma,rsi,roc,macd,bollinger_bands,rvol,obv,structure_breakout_distance' AS indicators_used",
    f'first_value("timestamp") OVER ({BY}) AS window_start',
    '"timestamp" AS window_end',
    "i + 1 AS candles_evaluated",
)
#: The texts of a raw row's errors.
RAW_TEXTS = """list_filter([
  CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'All OHLC prices must be strictly positive' END, CASE WHEN volume < 0 THEN 'Volume cannot be negative' END,
  CASE WHEN high < open OR high < close OR high < low THEN 'High price must be >= Open, Close, and Low' END, CASE WHEN low > open OR low > close OR low > high THEN 'Low price must be <= Open, Close, and High' END], lambda x: x IS NOT NULL)"""
KINDS = "array_to_string(list_sort(list_distinct(flatten(list(texts))))[1:5], '; ')"
CHECKED = f"WITH {RAW}, e AS (SELECT *, {RAW_ERRORS} AS n_errors, {RAW_TEXTS} AS texts FROM raw)"
LABELLED = f"""
WITH {RAW}, f AS (SELECT *, row_number() OVER k AS rn, first_value((open, high, low, close, volume)) OVER k AS f FROM raw WINDOW k AS (PARTITION BY {KEY} ORDER BY {SEQ})),
l AS (SELECT *, CASE WHEN rn = 1 THEN 'FIRST' WHEN (open, high, low, close, volume) = f THEN 'DUPLICATE' ELSE 'CONFLICT' END AS label FROM f)
"""
CUT0, CUT1 = "TIMESTAMP '1998-01-01'", "TIMESTAMP '1999-01-01'"

ORACLE: dict[str, str] = {
    **{name: windowed(name) for name in WINDOWED},
    **{name: recursive(name) for name in ("ema", "ema_slope", "rsi", "macd", "atr", "natr")},
    "relative_strength": STRENGTH,
    **{f"regime_{d}": regime(c) for d, c in (("trend", "trend"), ("momentum", "momentum"), ("volatility", "volatility"), ("volume", "volume_regime"), ("structure", "structure"), ("composite", "composite_regime"))},
    "regime_context": regime("trend", "momentum", "volatility", "volume_regime", "structure", "composite_regime", *EVIDENCE),
    "regime_inputs_check": f"WITH {WALK}, {INDEXED} SELECT n AS indicator_name, count(*) FILTER (i % 10 = 0) AS missing_points, 0::BIGINT AS extra_points FROM x, (SELECT unnest(['price_vs_sma', 'sma_slope', 'ema_slope', 'sma', 'rsi', 'roc', 'macd', 'bollinger_bands', 'rvol', 'obv', 'structure_breakout_distance']) AS n) GROUP BY n",
    "src_csv": f"WITH {WALK} SELECT {BARS}, 0::BIGINT AS n_errors FROM bars",
    "src_parquet": f"WITH {WALK} SELECT {BARS}, 0::BIGINT AS n_errors FROM bars",
    "sink_candles": f"WITH {WALK} SELECT {BARS} FROM bars",
    "sink_atomic": f"WITH {WALK} SELECT {BARS} FROM bars WHERE \"timestamp\" < {CUT0}",
    "sink_replay": f"WITH {WALK} SELECT {BARS} FROM bars UNION ALL SELECT 'X' || symbol AS symbol, exchange, timeframe, \"timestamp\", open, high, low, close, volume FROM bars WHERE \"timestamp\" < {CUT0}",
    "read_candles": f"WITH {WALK} SELECT {BARS} FROM bars WHERE symbol IN ('S1', 'S7', 'S42') AND \"timestamp\" BETWEEN {CUT0} AND {CUT1}",
    "has_data": f"WITH {WALK} SELECT 'S' || s_suppkey AS symbol, 'WALK' AS exchange, '1d' AS timeframe, EXISTS (SELECT 1 FROM bars b WHERE b.symbol = 'S' || s_suppkey AND b.\"timestamp\" < TIMESTAMP '1995-01-05') AS has_data FROM supplier",
    "has_data_window": f"""WITH {WALK},
a AS (
  SELECT o_orderkey, 'S' || o_custkey AS symbol, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::TIMESTAMP END AS a,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::TIMESTAMP + to_days((o_orderkey % 23)::INT) END AS b
  FROM orders),
f AS (SELECT DISTINCT o_orderkey FROM a JOIN bars USING (symbol) WHERE (a IS NULL OR "timestamp" >= a) AND (b IS NULL OR "timestamp" <= b))
SELECT o_orderkey, symbol, f.o_orderkey IS NOT NULL AS has_data FROM a LEFT JOIN f USING (o_orderkey)""",
    "dataset_catalog": f"WITH {WALK} SELECT symbol, exchange, timeframe, min(\"timestamp\") AS earliest, max(\"timestamp\") AS latest, count(*) AS record_count, CASE WHEN bool_or(\"timestamp\" - p > INTERVAL 1 DAY) THEN 'WARNING' ELSE 'VALID' END AS validation_status, true AS ingested FROM (SELECT *, lag(\"timestamp\") OVER ({BY}) AS p FROM bars) GROUP BY symbol, exchange, timeframe",
    "list_datasets": f"WITH {WALK} SELECT DISTINCT symbol, exchange, timeframe FROM bars",
    "drop_series": f"WITH {WALK} SELECT symbol, exchange, timeframe, count(*) AS record_count FROM bars WHERE symbol NOT LIKE '%3' GROUP BY ALL",
    "norm_keys": "SELECT event_id, upper(trim(event_type)) AS symbol, 'EVT' AS exchange, '1h' AS timeframe, true AS known FROM events",
    "norm_timestamp": "SELECT event_id, ts AS aware, ts - INTERVAL 330 MINUTE AS localized, CAST(NULL AS TIMESTAMP) AS naive FROM events",
    "norm_number": "SELECT event_id, value AS parsed, CAST(NULL AS DOUBLE) AS not_finite, CAST(NULL AS DOUBLE) AS not_numeric FROM events",
    "row_errors": f"{CHECKED} SELECT symbol, exchange, timeframe, count(*) AS records_read, count(*) FILTER (n_errors > 0) AS bad_rows, sum(n_errors)::BIGINT AS error_texts, {KINDS} AS kinds FROM e GROUP BY symbol, exchange, timeframe",
    "row_error_texts": f"""
WITH r AS (SELECT *, l_suppkey % 4 AS p, row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY {SEQ}) AS "row" FROM lineitem)
SELECT p, "row", 'Row ' || "row" || ' validation failure: ' || concat_ws('; ', CASE WHEN l_linenumber = 5 THEN 'bad timestamp: soon' END, CASE WHEN l_linenumber = 3 THEN 'bad open: n/a' END, CASE WHEN l_quantity > 45 THEN 'bad volume: NaN' END) AS text
FROM r WHERE l_linenumber IN (3, 5) OR l_quantity > 45""",
    "filter_range": f"WITH {RAW} SELECT symbol, exchange, timeframe, count(*) AS n FROM raw WHERE \"timestamp\" BETWEEN {CUT0} AND {CUT1} GROUP BY ALL",
    "validate_candle": f"{CHECKED} SELECT {KEY}, l_orderkey, l_linenumber, l_partkey, n_errors::BIGINT AS n_errors, n_errors = 0 AS is_valid FROM e",
    "validate_series_strict": f"WITH {RAW}, v AS (SELECT *, ((coalesce(lag(\"timestamp\") OVER (PARTITION BY symbol ORDER BY {SEQ}) >= \"timestamp\", false))::INT + (high < low)::INT + (high < open OR high < close)::INT + (low > open OR low > close)::INT + (volume < 0)::INT) AS n FROM raw) SELECT {KEY}, l_orderkey, l_linenumber, l_partkey, n::BIGINT AS n_violations FROM v WHERE n > 0",
    "validate_quote": "SELECT 'S' || l_suppkey AS symbol, count(*) AS quotes, count(*) FILTER (l_extendedprice * (1 + l_tax) > l_extendedprice * (1 + l_discount)) AS crossed, count(*) FILTER (NOT (l_extendedprice * (1 + l_tax) > l_extendedprice * (1 + l_discount))) AS valid FROM lineitem GROUP BY ALL",
    "validate_tick": "SELECT 'U' || user_id AS symbol, count(*) AS ticks, count(*) FILTER (value > 0) AS valid FROM events GROUP BY ALL",
    "validate_instrument": "SELECT p_partkey, p_size > 0 AND p_retailprice > 1000 AS is_valid, ((p_size <= 0)::INT + (p_retailprice - 1000 <= 0)::INT)::BIGINT AS n_errors FROM part",
    "detect_duplicates": f"WITH {RAW}, n AS (SELECT *, row_number() OVER k AS rn, first_value(l_orderkey) OVER k AS first_order, first_value(l_linenumber) OVER k AS first_line FROM raw WINDOW k AS (PARTITION BY {KEY} ORDER BY {SEQ})) SELECT {KEY}, first_order, first_line, l_orderkey AS duplicate_order, l_linenumber AS duplicate_line FROM n WHERE rn > 1",
    "detect_gaps": f"WITH {EVENT}, g AS (SELECT symbol, exchange, timeframe, \"timestamp\" AS gap_start, lead(\"timestamp\") OVER ({BY}) AS gap_end FROM bars) SELECT * FROM g WHERE gap_end - gap_start > INTERVAL 1 HOUR",
    "check_ordering": f"WITH {RAW}, o AS (SELECT symbol, exchange, timeframe, l_orderkey, l_linenumber, l_partkey, lag(\"timestamp\") OVER (PARTITION BY symbol ORDER BY {SEQ}) AS previous, \"timestamp\" FROM raw) SELECT * FROM o WHERE previous > \"timestamp\"",
    "check_staleness": f"WITH {EVENT} SELECT symbol, exchange, timeframe, max(\"timestamp\") AS latest, epoch(TIMESTAMP '2024-02-01' - max(\"timestamp\"))::DOUBLE AS age_seconds, CASE WHEN max(\"timestamp\") > TIMESTAMP '2024-02-01' THEN 'FUTURE' WHEN TIMESTAMP '2024-02-01' - max(\"timestamp\") > INTERVAL 1 DAY THEN 'STALE' ELSE 'FRESH' END AS status FROM bars GROUP BY ALL",
    "quality_report": f"""{CHECKED},
n AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {SEQ}) > 1 AS again, lag("timestamp") OVER (PARTITION BY symbol ORDER BY {SEQ}) AS previous FROM e)
SELECT symbol, exchange, timeframe, count(*) AS record_count, sum(n_errors)::BIGINT AS candle_errors, count(*) FILTER (previous > "timestamp") AS ordering_errors, count(*) FILTER (again) AS duplicates, 0::BIGINT AS gaps,
       CASE WHEN sum(n_errors) > 0 OR count(*) FILTER (previous > "timestamp") > 0 OR count(*) FILTER (again) > 0 THEN 'INVALID' ELSE 'VALID' END AS status,
       {KINDS} AS errors, 'data_sufficiency; candle_integrity; chronological_ordering; duplicate_detection; gap_detection' AS checks_run
FROM n GROUP BY symbol, exchange, timeframe""",
    "coverage_report": f"""WITH {EVENT},
p AS (SELECT *, lag("timestamp") OVER ({BY}) AS before FROM bars),
g AS (SELECT *, coalesce("timestamp" - before > INTERVAL 90 MINUTE, false) AS gap, sum(coalesce("timestamp" - before > INTERVAL 90 MINUTE, false)::INT) OVER ({BY}) AS k,
             strftime(before, '%Y-%m-%d %H:%M:%S') || ' -> ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS told FROM p)
SELECT symbol, exchange, timeframe, count(*) AS record_count, min("timestamp") AS earliest, max("timestamp") AS latest, count(*) FILTER (gap) AS potential_gap_count, count(*) FILTER (gap) > 0 AS has_potential_gaps,
       coalesce(string_agg(told, '; ' ORDER BY told) FILTER (gap AND k <= 20), '') AS gap_details
FROM g GROUP BY symbol, exchange, timeframe""",
    "batch_dedup": f"{LABELLED} SELECT {KEY}, l_orderkey, l_linenumber, l_partkey, label FROM l",
    "store_dedup": f"WITH {WALK} SELECT {KEY}, CASE WHEN \"timestamp\" >= {CUT1} THEN 'NEW' WHEN volume > 30 THEN 'CONFLICT' ELSE 'DUPLICATE' END AS store_label FROM bars WHERE \"timestamp\" >= {CUT0}",
    "merge_candles": f"WITH {WALK} SELECT {BARS} FROM bars",
    "ingest": f"WITH {WALK} SELECT {BARS} FROM bars",
    "ingest_summary": f"WITH {WALK} SELECT symbol, exchange, timeframe, count(*) AS records_read, count(*) AS records_valid, count(*) FILTER (\"timestamp\" >= {CUT1}) AS records_written, count(*) FILTER (\"timestamp\" < {CUT1}) AS records_skipped, count(*) FILTER (\"timestamp\" < {CUT1}) AS duplicates, 0::BIGINT AS conflicts, 0::BIGINT AS validation_failures, min(\"timestamp\") AS earliest, max(\"timestamp\") AS latest, 'SUCCESS' AS status FROM bars WHERE \"timestamp\" >= {CUT0} GROUP BY ALL",
    "compute_indicators": f"WITH {WALK}, {INDEXED}, y AS (SELECT *, {frame('avg(close)', -9)} AS m, {STD} AS s, lag(close, 5) OVER ({BY}) AS c0 FROM x) SELECT {KEY}, CASE WHEN i >= 9 THEN round(m, 6) END AS sma, CASE WHEN i >= 19 THEN round(s, 6) END AS rolling_std, CASE WHEN i >= 5 THEN round((close - c0) / c0 * 100, 6) + 0.0::DOUBLE END AS roc FROM y",
    "compute_from_store": f"WITH {WALK}, w AS (SELECT * FROM bars WHERE \"timestamp\" BETWEEN {CUT0} AND {CUT1}), y AS (SELECT *, row_number() OVER ({BY}) - 1 AS i, {SMA} AS m FROM w) SELECT {KEY}, CASE WHEN i >= 19 THEN round(m, 6) END AS sma, CASE WHEN i >= 19 THEN 'VALID' ELSE 'INSUFFICIENT_DATA' END AS sma_status FROM y",
    "latest_point": f"WITH {WALK}, {INDEXED}, y AS (SELECT *, {SMA} AS m, row_number() OVER (PARTITION BY symbol ORDER BY \"timestamp\" DESC) AS back FROM x) SELECT {KEY}, CASE WHEN i >= 19 THEN round(m, 6) END AS sma FROM y WHERE back = 1",
    "to_long": f"""WITH {WALK}, {INDEXED}, y AS (SELECT *, {SMA} AS m, {STD} AS sd, lag("timestamp", 19) OVER ({BY}) AS s19, lag("timestamp", 1) OVER ({BY}) AS s1, first_value("timestamp") OVER ({BY}) AS s0 FROM x)
SELECT {KEY}, 'sma' AS indicator_name, CASE WHEN i >= 19 THEN round(m, 6) END AS value, NULL::DOUBLE AS middle, NULL::DOUBLE AS upper, CASE WHEN i >= 19 THEN 'VALID' ELSE 'INSUFFICIENT_DATA' END AS status,
       '1.0.0' AS version, 'period=20' AS parameters, 20 AS lookback_period, coalesce(s19, s0) AS source_window_start, i + 1 AS candles_analyzed FROM y
UNION ALL SELECT {KEY}, 'true_range', round({TR}, 6), NULL, NULL, 'VALID', '1.0.0', '', CASE WHEN i = 0 THEN 1 ELSE 2 END, coalesce(s1, s0), i + 1 FROM y
UNION ALL SELECT {KEY}, 'bollinger_bands', NULL, CASE WHEN i >= 19 AND m > 0 THEN round(m, 6) END, CASE WHEN i >= 19 AND m > 0 THEN round(m + sd * 2.0::DOUBLE, 6) END,
       CASE WHEN i < 19 THEN 'INSUFFICIENT_DATA' WHEN m <= 0 THEN 'INVALID' ELSE 'VALID' END, '1.0.0', 'period=20,std_multiplier=2.0', 20, coalesce(s19, s0), i + 1 FROM y""",
    "register_indicator": f"WITH {WALK}, {INDEXED}, y AS (SELECT *, {frame('max(high)', -4)} - {frame('min(low)', -4)} AS m FROM x) {shown('channel_width', 4, 'false', {'channel_width': 'm'}, 'y')}",
    "position_valuation": f"WITH {WALK}, c AS (SELECT symbol, arg_max(close, \"timestamp\") AS price FROM bars GROUP BY symbol), h AS (SELECT 'S' || s_suppkey AS symbol, floor(s_acctbal / 100) AS quantity, 60.0::DOUBLE AS average_price FROM supplier) SELECT symbol, quantity, average_price, coalesce(price, 0) AS current_price, round(quantity * CASE WHEN price > 0 THEN price ELSE average_price END, 6) AS market_value, round(CASE WHEN price > 0 THEN (price - average_price) * quantity ELSE 0 END, 6) + 0.0::DOUBLE AS unrealized_pnl FROM h LEFT JOIN c USING (symbol) WHERE quantity > 0",
    "position_average_cost": """
WITH RECURSIVE f AS MATERIALIZED (
  SELECT l_suppkey AS account, p_brand AS symbol, row_number() OVER (PARTITION BY l_suppkey, p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_quantity) AS n,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice / l_quantity AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (
  SELECT account, symbol, n, greatest(q, 0)::DOUBLE AS quantity, CASE WHEN q > 0 THEN price ELSE 0 END::DOUBLE AS average_price FROM f WHERE n = 1
  UNION ALL
  SELECT f.account, f.symbol, f.n, greatest(s.quantity + f.q, 0),
         CASE WHEN f.q > 0 THEN (s.average_price * s.quantity + f.price * f.q) / (s.quantity + f.q) WHEN s.quantity + f.q > 0 THEN s.average_price ELSE 0 END
  FROM s JOIN f ON f.account = s.account AND f.symbol = s.symbol AND f.n = s.n + 1)
SELECT account, symbol, arg_max(quantity, n) AS quantity, round(arg_max(average_price, n), 4) AS average_price FROM s GROUP BY account, symbol""",
    "position_open": """
WITH RECURSIVE f AS MATERIALIZED (
  SELECT l_suppkey AS account, p_brand AS symbol, row_number() OVER (PARTITION BY l_suppkey, p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_quantity) AS n,
         CASE WHEN l_linenumber = 5 THEN -100 WHEN l_returnflag = 'R' THEN -1 ELSE 1 END::DECIMAL(10, 2) * CASE WHEN l_linenumber = 5 THEN 1 ELSE l_quantity::DECIMAL(10, 2) / CASE WHEN l_partkey % 2 = 0 THEN 10 ELSE 100 END END::DECIMAL(10, 2) AS q,
         l_extendedprice / l_quantity AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (
  SELECT account, symbol, n, greatest(q, 0)::DECIMAL(18, 4) AS quantity, CASE WHEN q > 0 THEN price ELSE 0 END::DOUBLE AS average_price FROM f WHERE n = 1
  UNION ALL
  SELECT f.account, f.symbol, f.n, greatest(s.quantity + f.q, 0)::DECIMAL(18, 4),
         CASE WHEN f.q > 0 THEN (s.average_price * s.quantity::DOUBLE + f.price * f.q::DOUBLE) / (s.quantity + f.q)::DOUBLE WHEN s.quantity + f.q > 0 THEN s.average_price ELSE 0 END
  FROM s JOIN f ON f.account = s.account AND f.symbol = s.symbol AND f.n = s.n + 1)
SELECT account, symbol, arg_max(quantity, n)::DOUBLE AS quantity, round(arg_max(average_price, n) + 0.0000001::DOUBLE, 4) AS average_price FROM s GROUP BY account, symbol HAVING arg_max(quantity, n) > 0""",
    "redact_text": """SELECT conv_id, turn, replace(text, 'that', '***REDACTED***') AS redacted,
       'Authorization: Bearer ***REDACTED***, x-api-key: ***REDACTED***, ' || text || ' password=''***REDACTED***'' postgresql://app:***REDACTED***@db:5432/x bearer ***REDACTED*** end' AS around FROM conversations""",
    "redact_many": """SELECT conv_id, turn, text || CASE WHEN conv_id % 5000 < 4000 THEN ' ***REDACTED***' ELSE ' key-' || (conv_id % 5000) || '-' END || turn || '/end' AS redacted FROM conversations""",
    "redact_json": r"""SELECT event_id, '{"inner": {"access_token": "***REDACTED***", "kind": "' || event_type || '", "body": "' || replace(props, '"', '\"') || '"}, "note": "password=***REDACTED*** of ' || event_type || '"}' AS redacted FROM events""",
    "redact_map": "SELECT event_id, '***REDACTED***' AS api_key, event_type AS symbol, 'Bearer ***REDACTED*** for ' || props AS note, '***REDACTED***' AS auth_code, props AS body FROM events",
    "indicator_catalog": f"WITH {WALK}, n AS (SELECT symbol, count(*) AS c FROM bars GROUP BY symbol), k AS (SELECT * FROM (VALUES ('atr', 14), ('bollinger_bands', 20), ('ema', 20), ('ema_slope', 21), ('macd', 34), ('natr', 14), ('obv', 1), ('price_vs_sma', 20), ('relative_strength', 21), ('roc', 15), ('rolling_high', 20), ('rolling_low', 20), ('rolling_std', 20), ('rsi', 15), ('rvol', 20), ('sma', 20), ('sma_slope', 21), ('structure_breakout_distance', 21), ('true_range', 1), ('volume_change', 2), ('volume_sma', 20)) t(name, need)) SELECT name, need AS minimum_observations, sum(greatest(c - need + 1, 0))::BIGINT AS candles_with_value FROM k, n GROUP BY ALL",
}


def together(*names: str) -> str:
    """The columns of several indicators side by side."""
    tables = " JOIN ".join(f"({ORACLE[n]}) {'USING (symbol, exchange, timeframe, \"timestamp\")' if i else ''}" for i, n in enumerate(names))
    return f"SELECT * FROM {tables}"


ORACLE["block_recurrences"] = together("ema", "ema_slope", "rsi", "macd", "atr", "natr", "obv")
ORACLE["block_windows"] = together("sma", "rolling_std", "rolling_high", "rolling_low", "bollinger_bands", "structure_breakout_distance", "roc")
