"""Ingestion: duplicates and conflicts within a batch and against the store, one gate, an all-or-nothing append, a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.candles import KEY, NUMBERS, SERIES
from barloom.functions.scratch import scratch
from barloom.sources import store as stores
from barloom.sources.files import candle_errors, error_texts, filter_range


def batch_dedup(df: DataFrame) -> DataFrame:
    """Adds ``label``: the FIRST row of a key by ``seq``; a later row is a DUPLICATE if all its numbers equal the first's, else a CONFLICT."""
    by_seq = Window.partitionBy(*KEY).orderBy("seq")
    numbers = F.struct(*NUMBERS)
    first = F.first(numbers).over(by_seq)
    label = F.when(F.row_number().over(by_seq) == 1, "FIRST").when(numbers.eqNullSafe(first), "DUPLICATE").otherwise("CONFLICT")
    return df.withColumn("label", label)


def store_dedup(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``store_label`` to unique batch rows: NEW, DUPLICATE of what is stored, or CONFLICT with it."""
    known = stored.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.struct(*NUMBERS).alias("_stored"))
    on = [F.col(c) == F.col(f"_{c}") for c in KEY]
    label = F.when(F.col("_stored").isNull(), "NEW").when(F.struct(*NUMBERS).eqNullSafe(F.col("_stored")), "DUPLICATE").otherwise("CONFLICT")
    return batch.join(known, on, "left").withColumn("store_label", label).drop(*[f"_{c}" for c in KEY], "_stored")


def merge_candles(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored candles and those of ``new`` whose key isn't stored; raises if a stored candle has other numbers."""
    labelled = store_dedup(new.select(*KEY, *NUMBERS), stored)
    if not labelled.where("store_label = 'CONFLICT'").isEmpty():
        raise ValueError("a stored candle has other values")
    return stored.select(*KEY, *NUMBERS).unionByName(labelled.where("store_label = 'NEW'").select(*KEY, *NUMBERS))


@dataclass(frozen=True)
class Ingested:
    """The summary by series, the batch's outcome, and the texts of bad rows by file and row number (None for rows without a place)."""

    summary: DataFrame
    status: str
    written: int
    errors: DataFrame | None = None


def labelled(rows: DataFrame, stored: DataFrame, start=None, end=None) -> DataFrame:
    """Parsed rows with their labels.  Rows that can't be parsed count before the range filter, so a bad row anywhere fails its batch."""
    bad = rows.where(F.size("errors") > 0).withColumns({"label": F.lit("ERROR"), "store_label": F.lit(None).cast("string")})
    good = batch_dedup(filter_range(rows.where(F.size("errors") == 0), start, end))
    unique = store_dedup(good.where("label = 'FIRST'"), stored)
    return unique.unionByName(good.where("label <> 'FIRST'").withColumn("store_label", F.lit(None).cast("string"))).unionByName(bad)


def summarised(labels: DataFrame, scope: str) -> DataFrame:
    """One row per series: counters, first and last stamp of the unique rows, status.  ``scope`` says whose failures stop a series: its own, or the batch's.

    The counters are written once, so that the batch's outcome is one flag of the small table.
    """
    is_ = lambda **k: F.count_if(eval_all(**k))
    out = labels.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("records_read"),
        is_(label="ERROR").alias("_errors"),
        is_(label="FIRST").alias("_unique"),
        is_(store_label="NEW").alias("_new"),
        (is_(label="DUPLICATE") + is_(store_label="DUPLICATE")).alias("duplicates"),
        (is_(label="CONFLICT") + is_(store_label="CONFLICT")).alias("conflicts"),
        F.sum(F.when(F.col("label") == "ERROR", F.size("errors")).otherwise(0)).cast("long").alias("_texts"),
        F.min(F.when(F.col("label") == "FIRST", F.col("timestamp"))).alias("earliest"),
        F.max(F.when(F.col("label") == "FIRST", F.col("timestamp"))).alias("latest"),
    )
    own = F.col("_errors") + F.col("conflicts") > 0
    path = scratch(labels.sparkSession, "summary")  # written, since the store that it was made from changes below
    out.write.parquet(path)
    out = labels.sparkSession.read.schema(out.schema).parquet(path)
    out = out.withColumn("_failed", own if scope == "series" else F.lit(not out.where(own).isEmpty()))
    return out.select(
        *SERIES,
        "records_read",
        F.when((F.col("conflicts") == 0) & (F.col("_errors") == 0), F.col("_unique")).otherwise(0).alias("records_valid"),
        F.when(F.col("_failed"), 0).otherwise(F.col("_new")).alias("records_written"),
        F.col("duplicates").alias("records_skipped"),
        "duplicates",
        "conflicts",
        (F.col("_texts") + F.col("conflicts")).alias("validation_failures"),
        "earliest",
        "latest",
        F.when(F.col("_failed"), "FAILED").otherwise("SUCCESS").alias("status"),
    )


def eval_all(**wanted: str) -> F.Column:
    cond = F.lit(True)
    for column, value in wanted.items():
        cond = cond & F.coalesce(F.col(column) == value, F.lit(False))
    return cond


def ingest(rows: DataFrame, store: str, start=None, end=None, scope: str = "batch", batch: stores.Batch | str | None = None) -> Ingested:
    """Adds the new candles of parsed ``rows`` (as ``sources.files`` reads them) to the store at ``store``.

    Any row error, conflict or invalid candle stops the batch (or, with ``scope="series"``, its series): nothing of it
    is written.  Only new rows are written, whatever the store holds; the store is read for the batch's series and
    time span alone.  ``batch`` is the batch's identity, or a name (that and the rows make the identity): a batch that the
    store knows is SKIPPED without a look at its candles, and its summary is empty.
    """
    if scope not in ("batch", "series"):
        raise ValueError("scope is batch or series")
    spark = rows.sparkSession
    path = scratch(spark, "rows")  # parsed once, read for the spans and for the labels
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    seen = stores.committed(spark, store)
    batch = stores.named(rows, batch) if isinstance(batch, str) else batch
    if seen.knows(batch):
        return Ingested(summarised(labelled(rows.where("false"), stores._stored(spark, store, []).select(*KEY, *NUMBERS)), scope), "SKIPPED", 0)
    stored = stores._stored(spark, store, seen.batches).select(*KEY, *NUMBERS)
    labels = labelled(rows, stores.near(rows, stored) if seen.batches else stored, start, end).persist()
    try:
        summary = summarised(labels, scope)
        ok = summary.where("status = 'SUCCESS'").select(*SERIES)
        totals = summary.agg(F.coalesce(F.sum("records_written"), F.lit(0)).alias("w"), F.count_if(F.col("status") == "FAILED").alias("f")).first()
        if totals["w"]:
            new = labels.where("store_label = 'NEW'")
            stores.append(new.join(ok, SERIES, "left_semi") if totals["f"] else new, store, batch, seen)
        return Ingested(summary, "FAILED" if totals["f"] and (scope == "batch" or not totals["w"]) else "SUCCESS", totals["w"], error_texts(rows) if {"file", "row"} <= set(rows.columns) else None)
    finally:
        labels.unpersist()
