"""Candles, quotes, ticks and fills made from the star-schema tables, each with the SQL that makes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier of a price that moves in eighths by each line's discount; window sums are exact."""
    lines = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity")
    step = F.round(F.col("l_discount") * 100).cast("long") - 5
    moved = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", step.alias("step"), F.row_number().over(lines).alias("rn"), (64 + F.sum(step).over(lines.rowsBetween(Window.unboundedPreceding, 0)) / 8.0).alias("price")
    )
    opened = F.min_by(F.col("price") - F.col("step") / 8.0, "rn")
    return moved.groupBy("l_suppkey", "l_shipdate").agg(
        opened.alias("open"), F.greatest(F.max("price"), opened).alias("high"), F.least(F.min("price"), opened).alias("low"), F.max_by("price", "rn").alias("close"), F.sum("l_quantity").alias("volume")
    ).select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.lit("WALK").alias("exchange"), F.lit("1d").alias("timeframe"), F.col("l_shipdate").cast("timestamp").alias("timestamp"), "open", "high", "low", "close", "volume")


WALK = """
lines AS (
  SELECT l_suppkey, l_shipdate, l_quantity, CAST(round(l_discount * 100) AS BIGINT) - 5 AS step, row_number() OVER w AS rn,
         64 + CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) OVER w AS DOUBLE) / 8.0::DOUBLE AS price
  FROM lineitem
  WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_quantity ROWS UNBOUNDED PRECEDING)),
bars AS MATERIALIZED (
  SELECT 'S' || l_suppkey AS symbol, 'WALK' AS exchange, '1d' AS timeframe, l_shipdate AS "timestamp",
         arg_min(price - step / 8.0::DOUBLE, rn) AS open, greatest(max(price), arg_min(price - step / 8.0::DOUBLE, rn)) AS high,
         least(min(price), arg_min(price - step / 8.0::DOUBLE, rn)) AS low, arg_max(price, rn) AS close, sum(l_quantity) AS volume
  FROM lines GROUP BY l_suppkey, l_shipdate)"""


def bars_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One benchmark bar a day: the mean close of all suppliers' bars, in whole eighths."""
    day = bars_walk(spark, sf_dir).groupBy("timeframe", "timestamp").agg(F.floor(F.avg("close") * 8).alias("c"))
    price = F.col("c") / 8.0
    return day.select(F.lit("MKT").alias("symbol"), F.lit("WALK").alias("exchange"), "timeframe", "timestamp", *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))


MARKET = """market AS (SELECT timeframe, "timestamp", floor(avg(close) * 8) / 8.0::DOUBLE AS close FROM bars GROUP BY timeframe, "timestamp")"""


def bars_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type; hours without events are gaps."""
    e = table(spark, sf_dir, "events").where("value > 0").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    at = F.struct("ts", "event_id")
    return e.groupBy("event_type", "hour").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    ).select(F.upper("event_type").alias("symbol"), F.lit("EVT").alias("exchange"), F.lit("1h").alias("timeframe"), F.col("hour").alias("timestamp"), "open", "high", "low", "close", "volume")


EVENT = """
bars AS MATERIALIZED (
  SELECT upper(event_type) AS symbol, 'EVT' AS exchange, '1h' AS timeframe, date_trunc('hour', ts) AS "timestamp",
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events WHERE value > 0 GROUP BY event_type, date_trunc('hour', ts))"""


def raw_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar per line: some break the candle rules, and keys repeat.  ``seq`` is the line's full key, so it orders without a global sort."""
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.lit("RAW").alias("exchange"), F.lit("1d").alias("timeframe"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        p.alias("open"), (p * (1 + F.col("l_tax"))).alias("high"), (p * (1 - F.col("l_discount"))).alias("low"), (p * (1 + F.col("l_discount"))).alias("close"), F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity").alias("seq"),
    )


RAW = """
raw AS MATERIALIZED (
  SELECT 'S' || l_suppkey AS symbol, 'RAW' AS exchange, '1d' AS timeframe, l_shipdate AS "timestamp", l_extendedprice AS open, l_extendedprice * (1 + l_tax) AS high,
         l_extendedprice * (1 - l_discount) AS low, l_extendedprice * (1 + l_discount) AS close, l_quantity AS volume,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_quantity
  FROM lineitem)"""
SEQ = "l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_quantity"
RAW_ERRORS = "(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0)::INT + (volume < 0)::INT + (high < open OR high < close OR high < low)::INT + (low > open OR low > close OR low > high)::INT"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("U"), F.col("user_id")).alias("symbol"), F.lit("EVT").alias("exchange"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("last_price"), F.lit(1.0).alias("last_quantity"), F.count(F.lit(1)).over(by_user).cast("double").alias("total_volume")
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.lit("QTE").alias("exchange"), F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        p.alias("last_price"), (p * (1 + F.col("l_tax"))).alias("bid"), (p * (1 + F.col("l_discount"))).alias("ask"), F.col("l_quantity").alias("bid_qty"), F.lit(None).cast("double").alias("ask_qty"), F.col("l_quantity").alias("volume"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of accounts (suppliers) in the parts' brands; returned lines are sales."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_suppkey").alias("account"), F.col("p_brand").alias("symbol"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity").alias("seq"),
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
