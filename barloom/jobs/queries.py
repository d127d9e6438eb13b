"""The registered market-data queries: each runs one operation over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.candles import KEY, NUMBERS, SERIES
from barloom.functions.scratch import scratch
from barloom.jobs import adapters
from barloom.jobs.oracle import ORACLE as ORACLE
from barloom.operators import indicators, ingest, positions, quality, redact, regime
from barloom.sources import files, store

UTC = timezone.utc
CUT0, CUT1 = datetime(1998, 1, 1, tzinfo=UTC), datetime(1999, 1, 1, tzinfo=UTC)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def shown(df: DataFrame) -> DataFrame:
    """Doubles to six places and stamps without zone, as other engines compare them."""
    made = {}
    for name, kind in df.dtypes:
        if kind == "double" and name not in NUMBERS:
            made[name] = F.round(name, 6) + 0.0
        elif kind == "timestamp":
            made[name] = F.col(name).cast("timestamp_ntz")
    return df.withColumns(made)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return adapters.bars_walk(spark, sf_dir)


def _indicator(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = indicators.ind(name)
        mark = adapters.bars_market(spark, sf_dir) if name == "relative_strength" else None
        return shown(indicators.compute(bars(spark, sf_dir), [spec], mark).select(*KEY, *spec.columns(), f"{name}_status"))

    QUERIES[name] = run


for _name in [c["name"] for c in indicators.catalog()]:
    _indicator(_name)


def _regime(name: str, *columns: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(regime.regime_context(bars(spark, sf_dir), states=list(columns)).select(*KEY, *columns))

    QUERIES[name] = run


for _name, _column in (("trend", "trend"), ("momentum", "momentum"), ("volatility", "volatility"), ("volume", "volume_regime"), ("structure", "structure"), ("composite", "composite_regime")):
    _regime(f"regime_{_name}", _column)


def _regime_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All states with what the evidence says of each dimension, and the provenance."""
    out = regime.regime_context(bars(spark, sf_dir), with_evidence=True)
    told = F.array_join(F.transform(F.array(*[F.lit(d) for d in (*regime.DIMENSIONS, "composite")]), lambda d: F.concat(F.col("evidence")[d]["dimension"], F.lit("="), F.col("evidence")[d]["state"])), ";")
    metrics = F.array_join(F.array_sort(F.map_keys(F.col("evidence")["structure"]["contributing_metrics"])), ",")
    provenance = [F.col(f"provenance.{c}").alias(c) for c in ("window_start", "window_end", "candles_evaluated")]
    states = ("trend", "momentum", "volatility", "volume_regime", "structure", "composite_regime")
    return shown(out.select(*KEY, *states, told.alias("evidence_states"), metrics.alias("structure_metrics"), F.array_join("provenance.indicators_used", ",").alias("indicators_used"), *provenance))


QUERIES["regime_context"] = _regime_context


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All regimes of all candles, with evidence."""
    return shown(regime.regime_context(bars(spark, sf_dir), with_evidence=True).drop("provenance"))


@query
def regime_inputs_check(spark, sf_dir):
    candles = bars(spark, sf_dir)
    points = indicators.to_long(candles, regime.REQUIRED).where((F.col("provenance.candles_analyzed") - 1) % 10 != 0)
    return regime.inputs_check(candles, points)


def _written(spark, sf_dir, kind: str) -> str:
    path = scratch(spark, kind)
    df = bars(spark, sf_dir)
    if kind == "csv":
        text = df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        names = {"timestamp": " DateTime ", "open": "OPEN", "high": " High", "low": "Low ", "volume": "Vol"}
        text.withColumnsRenamed(names).write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    else:
        df.withColumnsRenamed({"timestamp": "Date", "close": "Close"}).write.parquet(path)
    return path


@query
def src_csv(spark, sf_dir):
    read = files.read_csv(spark, _written(spark, sf_dir, "csv"))
    return shown(read.select(*KEY, *NUMBERS, F.size("errors").cast("long").alias("n_errors")))


@query
def src_parquet(spark, sf_dir):
    read = files.read_parquet(spark, _written(spark, sf_dir, "parquet"))
    return shown(read.select(*KEY, *NUMBERS, F.size("errors").cast("long").alias("n_errors")))


def _stored(spark, candles: DataFrame) -> str:
    path = scratch(spark, "store")
    store.write(candles, path)
    return path


@query
def sink_candles(spark, sf_dir):
    candles = bars(spark, sf_dir)
    path = _stored(spark, candles.where(F.col("timestamp") < F.lit(CUT1)))
    store.write(candles.where(F.col("timestamp") >= F.lit(CUT0)), path)
    return shown(store.read_candles(spark, path))


@query
def sink_atomic(spark, sf_dir):
    """A batch with one conflict leaves the store as it was."""
    candles = bars(spark, sf_dir)
    path = _stored(spark, candles.where(F.col("timestamp") < F.lit(CUT0)))
    try:
        store.write(candles.withColumn("close", F.when(F.col("symbol") == "S1", F.col("close") + 1e-10).otherwise(F.col("close"))), path)
    except ValueError:
        return shown(store.read_candles(spark, path))
    raise AssertionError("a conflict was written")


@query
def sink_replay(spark, sf_dir):
    """Batches of one name with other content are all kept; batches that are written again add nothing."""
    candles, path = bars(spark, sf_dir), scratch(spark, "store")
    for part in (F.col("timestamp") < F.lit(CUT0), F.col("timestamp").between(F.lit(CUT0), F.lit(CUT1)), F.col("timestamp") < F.lit(CUT0), F.col("timestamp") > F.lit(CUT1)):
        store.write(candles.where(part), path, "daily")
    last = store.Batch("a stream", 3)
    for _ in range(2):
        store.append(candles.where(F.col("timestamp") < F.lit(CUT0)).withColumn("symbol", F.concat(F.lit("X"), F.col("symbol"))), path, last)
    return shown(store.read_candles(spark, path))


@query
def read_candles(spark, sf_dir):
    return shown(store.read_candles(spark, _stored(spark, bars(spark, sf_dir)), ["s1", " S7", "S42"], "walk", "1D", CUT0, CUT1))


@query
def has_data(spark, sf_dir):
    asked = adapters.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.lit("WALK").alias("exchange"), F.lit("1d").alias("timeframe"))
    return store.has_data(asked, bars(spark, sf_dir).where(F.col("timestamp") < F.lit(datetime(1995, 1, 5, tzinfo=UTC))))


@query
def has_data_window(spark, sf_dir):
    """Of each order: whether its customer's number names a series with a bar in the weeks after it; some windows are open on either side."""
    day = F.to_timestamp("o_orderdate")
    start = F.when(F.col("o_orderkey") % 7 != 0, day)
    end = F.when(F.col("o_orderkey") % 5 != 0, F.timestamp_add("DAY", (F.col("o_orderkey") % 23).cast("int"), day))
    asked = adapters.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("S"), F.col("o_custkey")).alias("symbol"), F.lit("WALK").alias("exchange"), F.lit("1d").alias("timeframe"), start.alias("start"), end.alias("end"))
    return store.has_data(asked, bars(spark, sf_dir)).select("o_orderkey", "symbol", "has_data")


@query
def dataset_catalog(spark, sf_dir):
    """Of a real store, in two batches; ``ingested`` says whether a series has a time of ingestion."""
    candles = bars(spark, sf_dir)
    path = _stored(spark, candles.where(F.col("timestamp") < F.lit(CUT1)))
    store.write(candles.where(F.col("timestamp") >= F.lit(CUT0)), path)
    return shown(store.store_catalog(spark, path).withColumn("ingested", F.col("ingested_at").isNotNull()).drop("ingested_at"))


@query
def list_datasets(spark, sf_dir):
    return store.list_datasets(store.read_candles(spark, _stored(spark, bars(spark, sf_dir))))


@query
def drop_series(spark, sf_dir):
    candles = bars(spark, sf_dir)
    path = _stored(spark, candles)
    store.drop_series(spark, path, candles.where("symbol like '%3'").select(*SERIES).distinct())
    return store.store_catalog(spark, path).select(*SERIES, "record_count")


@query
def norm_keys(spark, sf_dir):
    raw = adapters.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.col("event_type"), F.lit(" ")).alias("symbol"), F.lit("evt ").alias("exchange"), F.lit(" 1H").alias("timeframe"))
    return files.norm_keys(raw).withColumn("known", files.known_timeframe())


@query
def norm_timestamp(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = adapters.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("t"))
    text = raw.schema["t"].dataType
    aware = files.norm_timestamp(F.concat(F.regexp_replace("t", " ", "T"), F.lit("Z")), text, None)
    return shown(raw.select("event_id", aware.alias("aware"), files.norm_timestamp("t", text, "Asia/Kolkata").alias("localized"), files.norm_timestamp("t", text, None).alias("naive")))


@query
def norm_number(spark, sf_dir):
    raw = adapters.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit(" "), F.col("value").cast("string")).alias("v"))
    odd = F.element_at(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (F.col("event_id") % 3 + 1).cast("int"))
    return raw.select("event_id", files.norm_number("v").alias("parsed"), files.norm_number(odd).alias("not_finite"), files.norm_number(F.concat("v", F.lit("x"))).alias("not_numeric"))


def _raw(spark, sf_dir) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return adapters.raw_candles(spark, sf_dir)


#: The columns that tell all lines apart.
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity")


def line(*names: str) -> list:
    return [F.col(f"seq.{c}").alias(c) for c in names or ("l_orderkey", "l_linenumber", "l_partkey")]


@query
def row_errors(spark, sf_dir):
    parsed = files.parsed(_raw(spark, sf_dir), None)
    texts = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))), "; ")  # a few kinds of texts
    return parsed.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("records_read"), F.count_if(F.size("errors") > 0).alias("bad_rows"), F.sum(F.size("errors")).cast("long").alias("error_texts"), texts.alias("kinds"))


@query
def row_error_texts(spark, sf_dir):
    """Texts with file and row number, of CSV files with values that can't be read."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines, path = adapters.table(spark, sf_dir, "lineitem"), scratch(spark, "csv")
    price, unless = F.col("l_extendedprice").cast("string"), lambda bad, text, good: F.when(bad, text).otherwise(good)
    made = lines.select(
        (F.col("l_suppkey") % 4).alias("p"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.lit("x").alias("exchange"), F.lit("1d").alias("timeframe"),
        unless(F.col("l_linenumber") == 5, "soon", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"), unless(F.col("l_linenumber") == 3, "n/a", price).alias("open"),
        price.alias("high"), price.alias("low"), price.alias("close"), unless(F.col("l_quantity") > 45, "NaN", F.col("l_quantity").cast("string")).alias("volume"), *LINE,
    )
    made.repartition(4, "p").sortWithinPartitions("p", *LINE).drop(*LINE).write.partitionBy("p").option("header", True).csv(path)
    texts = files.error_texts(files.read_csv(spark, path, zone="UTC"))
    return texts.select(F.regexp_extract("file", r"/p=(\d+)/", 1).cast("long").alias("p"), "row", "text")


@query
def filter_range(spark, sf_dir):
    return files.filter_range(_raw(spark, sf_dir), CUT0, CUT1).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))


@query
def validate_candle(spark, sf_dir):
    return shown(quality.validate_candles(_raw(spark, sf_dir)).select(*KEY, *line(), F.size("errors").cast("long").alias("n_errors"), "is_valid"))


@query
def validate_series_strict(spark, sf_dir):
    return shown(quality.validate_series_strict(_raw(spark, sf_dir), "flag").select(*KEY, *line(), F.size("violations").cast("long").alias("n_violations")))


@query
def validate_quote(spark, sf_dir):
    checked = quality.validate_quotes(adapters.quotes(spark, sf_dir))
    return checked.groupBy("symbol").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(F.array_contains("errors", "bid above ask")).alias("crossed"), F.count_if("is_valid").alias("valid"))


@query
def validate_tick(spark, sf_dir):
    return quality.validate_ticks(adapters.ticks(spark, sf_dir)).groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.count_if("is_valid").alias("valid"))


@query
def validate_instrument(spark, sf_dir):
    parts = adapters.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.lit("X").alias("exchange"), F.col("p_size").alias("lot_size"), (F.col("p_retailprice") - 1000).alias("tick_size"))
    return quality.validate_instruments(parts).select("p_partkey", "is_valid", F.size("errors").cast("long").alias("n_errors"))


@query
def detect_duplicates(spark, sf_dir):
    found = quality.detect_duplicates(_raw(spark, sf_dir))
    return shown(found.select(*KEY, F.col("first_seq.l_orderkey").alias("first_order"), F.col("first_seq.l_linenumber").alias("first_line"), F.col("duplicate_seq.l_orderkey").alias("duplicate_order"), F.col("duplicate_seq.l_linenumber").alias("duplicate_line")))


def _hourly(spark, sf_dir) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return adapters.bars_event(spark, sf_dir)


@query
def detect_gaps(spark, sf_dir):
    return shown(quality.detect_gaps(_hourly(spark, sf_dir)))


@query
def check_ordering(spark, sf_dir):
    return shown(quality.check_ordering(_raw(spark, sf_dir)).select(*SERIES, *line(), "previous", "timestamp"))


@query
def check_staleness(spark, sf_dir):
    return shown(quality.check_staleness(_hourly(spark, sf_dir), datetime(2024, 2, 1, tzinfo=UTC), 86400))


@query
def quality_report(spark, sf_dir):
    return quality.quality_report(_raw(spark, sf_dir)).withColumns({c: F.array_join(c, "; ") for c in ("errors", "checks_run")})


@query
def coverage_report(spark, sf_dir):
    return shown(quality.coverage_report(_hourly(spark, sf_dir)).withColumn("gap_details", F.array_join("gap_details", "; ")))


@query
def batch_dedup(spark, sf_dir):
    return shown(ingest.batch_dedup(_raw(spark, sf_dir)).select(*KEY, *line(), "label"))


@query
def store_dedup(spark, sf_dir):
    candles = bars(spark, sf_dir)
    changed = candles.where(F.col("timestamp") < F.lit(CUT1)).withColumn("volume", F.when(F.col("volume") > 30, F.col("volume") + 1).otherwise(F.col("volume")))
    return shown(ingest.store_dedup(candles.where(F.col("timestamp") >= F.lit(CUT0)), changed).select(*KEY, "store_label"))


@query
def merge_candles(spark, sf_dir):
    candles = bars(spark, sf_dir)
    return shown(ingest.merge_candles(candles.where(F.col("timestamp") < F.lit(CUT1)), candles.where(F.col("timestamp") >= F.lit(CUT0))))


def _rows(candles: DataFrame) -> DataFrame:
    return files.parsed(candles.withColumn("seq", F.monotonically_increasing_id()), "UTC")


def _two_batches(spark, sf_dir) -> tuple[str, ingest.Ingested]:
    path, made = scratch(spark, "store"), scratch(spark, "bars")
    bars(spark, sf_dir).write.parquet(made)
    candles = spark.read.parquet(made)
    ingest.ingest(_rows(candles.where(F.col("timestamp") < F.lit(CUT1))), path)
    return path, ingest.ingest(_rows(candles.where(F.col("timestamp") >= F.lit(CUT0))), path)


@query
def ingest_summary(spark, sf_dir):
    return shown(_two_batches(spark, sf_dir)[1].summary)


def _ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(store.read_candles(spark, _two_batches(spark, sf_dir)[0]))


QUERIES["ingest"] = _ingest


@query
def compute_indicators(spark, sf_dir):
    specs = [indicators.ind("sma", period=10), "rolling_std", indicators.ind("roc", period=5)]
    return shown(indicators.compute(bars(spark, sf_dir), specs).select(*KEY, "sma", "rolling_std", "roc"))


#: Candles of a block in these queries; the series of the tables have some hundreds of bars.
BLOCK_ROWS = 200


@query
def block_recurrences(spark, sf_dir):
    """Exponential averages and what is made of them, as scans over blocks of each series."""
    names = ["ema", "ema_slope", "rsi", "macd", "atr", "natr", "obv"]
    columns = [c for n in names for c in (*indicators.ind(n).columns(), f"{n}_status")]
    return shown(indicators.compute(bars(spark, sf_dir), names, block_rows=BLOCK_ROWS).select(*KEY, *columns))


@query
def block_windows(spark, sf_dir):
    """Windows over blocks of each series with halos."""
    names = ["sma", "rolling_std", "rolling_high", "rolling_low", "bollinger_bands", "structure_breakout_distance", "roc"]
    columns = [c for n in names for c in (*indicators.ind(n).columns(), f"{n}_status")]
    return shown(indicators.compute(bars(spark, sf_dir), names, block_rows=BLOCK_ROWS).select(*KEY, *columns))


@query
def compute_from_store(spark, sf_dir):
    path = _stored(spark, bars(spark, sf_dir))
    return shown(indicators.compute_from_store(spark, path, ["sma"], start=CUT0, end=CUT1).select(*KEY, "sma", "sma_status"))


@query
def latest_point(spark, sf_dir):
    return shown(indicators.latest_point(bars(spark, sf_dir), ["sma"]).select(*KEY, "sma"))


@query
def to_long(spark, sf_dir):
    points = indicators.to_long(bars(spark, sf_dir), ["sma", "true_range", "bollinger_bands"])
    given = F.array_join(F.transform(F.array_sort(F.map_entries("provenance.parameters")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    parts = [F.col("components")[c].alias(c) for c in ("middle", "upper")]
    return shown(points.select(*KEY, "indicator_name", "value", *parts, "status", "provenance.version", given.alias("parameters"), "provenance.lookback_period", "provenance.source_window_start", "provenance.candles_analyzed"))


@query
def register_indicator(spark, sf_dir):
    """A user's indicator: the width of the last five bars' range."""
    w = lambda p: indicators.over(-(p["period"] - 1))
    own = indicators.Indicator("channel_width", "window", lambda p: {"": F.max("high").over(w(p)) - F.min("low").over(w(p))}, first=lambda p: p["period"] - 1, reach=lambda p: p["period"] - 1, lookback=lambda p: p["period"], defaults={"period": 5}, least={"period": 1}, fields=("high", "low"))
    indicators.register(own)
    try:
        return shown(indicators.compute(bars(spark, sf_dir), ["channel_width"]).select(*KEY, "channel_width", "channel_width_status"))
    finally:
        indicators.unregister("channel_width")


@query
def indicator_catalog(spark, sf_dir):
    """The catalog beside how many candles each indicator can have a value for."""
    listed = spark.createDataFrame([(c["name"], c["minimum_observations"]) for c in indicators.catalog()], "name string, minimum_observations int")
    sizes = bars(spark, sf_dir).groupBy(*SERIES).count()
    n = F.greatest(F.col("count") - F.col("need") + 1, F.lit(0))
    sums = sizes.select("count", F.explode(F.array(*[F.lit(k) for k in sorted({c["minimum_observations"] for c in indicators.catalog()})])).alias("need")).groupBy("need").agg(F.sum(n).alias("candles_with_value"))
    return listed.join(sums, listed["minimum_observations"] == sums["need"]).select("name", "minimum_observations", "candles_with_value")


@query
def position_valuation(spark, sf_dir):
    held = adapters.table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("symbol"), F.floor(F.col("s_acctbal") / 100).cast("double").alias("quantity"), F.lit(60.0).alias("average_price"))
    return shown(positions.valuation(held, bars(spark, sf_dir)).select("symbol", "quantity", "average_price", "current_price", "market_value", "unrealized_pnl"))


@query
def position_average_cost(spark, sf_dir):
    return positions.average_cost(adapters.fills(spark, sf_dir)).withColumn("average_price", F.round("average_price", 4))


@query
def position_open(spark, sf_dir):
    """Positions of fractional quantities, in tenths and hundredths; every fifth line sells out what may be left."""
    lines, parts = adapters.table(spark, sf_dir, "lineitem"), adapters.table(spark, sf_dir, "part")
    sells = (F.col("l_returnflag") == "R") | (F.col("l_linenumber") == 5)
    quantity = F.when(F.col("l_linenumber") == 5, 100.0).otherwise(F.col("l_quantity") / F.when(F.col("l_partkey") % 2 == 0, 10).otherwise(100))
    made = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_suppkey").alias("account"), F.col("p_brand").alias("symbol"), F.struct("l_shipdate", *LINE).alias("seq"), F.when(sells, "SELL").otherwise("BUY").alias("side"), quantity.alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return positions.open_positions(made).withColumn("average_price", F.round(F.col("average_price") + 1e-7, 4))  # averages of whole cents can end in 5


@query
def redact_text(spark, sf_dir):
    """The texts themselves, bare and with credentials around them; ``the `` stands for a secret of the caller's own."""
    talk = adapters.table(spark, sf_dir, "conversations")
    secret = F.md5("text")
    around = F.concat(F.lit("Authorization: Bearer "), secret, F.lit(", x-api-key: "), secret, F.lit(", "), F.col("text"), F.lit(" password='"), secret, F.lit("' postgresql://app:"), secret, F.lit("@db:5432/x bearer "), secret, F.lit(" end"))
    return talk.select("conv_id", "turn", redact.redact_text("text", ["that"]).alias("redacted"), redact.redact_text(around).alias("around"))


@query
def redact_many(spark, sf_dir):
    """Four thousand secrets of the caller's own in all texts, in one pass."""
    talk = adapters.table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.col("text"), F.lit(" key-"), (F.col("conv_id") % 5000).cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit("/end")))
    return talk.select("conv_id", "turn", redact.redact_text("text", [f"key-{i}-" for i in range(4000)]).alias("redacted"))


@query
def redact_map(spark, sf_dir):
    note = F.concat(F.lit("Bearer "), F.md5("props"), F.lit(" for "), F.col("props"))
    made = F.create_map(F.lit("api_key"), F.col("props"), F.lit("symbol"), F.col("event_type"), F.lit("note"), note, F.lit("Auth_Code"), F.col("event_type"), F.lit("body"), F.col("props"))
    out = adapters.table(spark, sf_dir, "events").select("event_id", made.alias("m")).withColumn("m", redact.redact_map("m"))
    return out.select("event_id", *[F.col("m")[k].alias(k.lower()) for k in ("api_key", "symbol", "note", "Auth_Code", "body")])


@query
def redact_json(spark, sf_dir):
    inner = F.struct(F.col("props").alias("access_token"), F.col("event_type").alias("kind"), F.col("props").alias("body"))
    nested = F.to_json(F.struct(inner.alias("inner"), F.concat(F.lit("password="), F.md5("props"), F.lit(" of "), F.col("event_type")).alias("note")))
    return adapters.table(spark, sf_dir, "events").withColumn("j", nested).select("event_id", redact.redact_json("j").alias("redacted"))
