"""The candle store: Parquet batches partitioned by exchange and timeframe, and small numbered lists of committed batches.

Every attempt to write a batch has a folder of its own (``batch=<unique>``) and becomes visible with the next list, which
comes up by one rename that fails if another writer has made that list meanwhile.  So readers see all of a batch or
nothing, and no writer overwrites what another one has added.  The listed folders are read as one table with ``batch`` as
a partition column.  ``compact`` writes them anew as one batch, ``vacuum`` deletes what no list names any more.

Who wrote what is kept in the list apart from the folders: for each writer (a stream's id, or a caller's name and the
content of the batch) the number of its last batch.  A batch whose writer has come as far already is done, and writing it
again changes nothing.  A stream has one entry however many batches it writes.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.candles import KEY, NUMBERS, SCHEMA, SERIES, interval, micros, series
from barloom.functions.scratch import scratch

LIST = re.compile(r"batches-(\d{10})\.json")
STORED = T.StructType([*SCHEMA.fields, T.StructField("ingested_at", T.TimestampType()), T.StructField("batch", T.StringType())])


class StoreChanged(RuntimeError):
    """Another writer has committed since the store was read; nothing was made visible."""


class Batch(NamedTuple):
    """A batch's identity: a writer, and a number that only rises for one writer."""

    writer: str
    number: int = 0


class Committed(NamedTuple):
    """The number of the newest list (0 without any), the folders that it names, and each writer's last batch."""

    number: int
    batches: list[str]
    writers: dict[str, int]

    def knows(self, batch: Batch | None) -> bool:
        return batch is not None and self.writers.get(batch.writer, -1) >= batch.number


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, store: str) -> Committed:
    fs, p = _fs(spark, store)
    if not fs.exists(p):
        return Committed(0, [], {})
    newest = max((int(m[1]) for f in fs.listStatus(p) if (m := LIST.fullmatch(f.getPath().getName()))), default=0)
    if not newest:
        return Committed(0, [], {})
    text = spark.read.option("wholetext", True).text(f"{store}/batches-{newest:010d}.json").collect()
    listed = json.loads("".join(r.value for r in text))
    if isinstance(listed, list):  # lists of stores that knew no writers
        return Committed(newest, listed, {})
    return Committed(newest, listed["batches"], listed["writers"])


def batches(spark: SparkSession, store: str) -> list[str]:
    return committed(spark, store).batches


def publish(spark: SparkSession, store: str, listed: list[str], seen: Committed, batch: Batch | None = None) -> None:
    """Makes ``listed`` the committed folders by one rename, with ``batch`` as its writer's last one; StoreChanged if list ``seen`` isn't the newest any more."""
    fs, target = _fs(spark, f"{store}/batches-{seen.number + 1:010d}.json")
    writers = seen.writers | ({batch.writer: batch.number} if batch else {})
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_{uuid.uuid4().hex}.json")
    out = fs.create(path, True)
    try:
        out.write(bytearray(json.dumps({"batches": listed, "writers": writers}).encode()))
    finally:
        out.close()
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(path, target, none)
    except Py4JJavaError as e:
        fs.delete(path, False)
        if "FileAlreadyExists" in str(e.java_exception):
            raise StoreChanged(f"another writer has committed to {store}") from None
        raise


def _laid_out(df: DataFrame, path: str) -> None:
    spread = df.repartition("exchange", "timeframe", F.pmod(F.xxhash64("symbol"), F.lit(64))).sortWithinPartitions("exchange", "timeframe", "symbol", "timestamp")
    bloom = {"parquet.bloom.filter.enabled#symbol": "true", "parquet.bloom.filter.adaptive.enabled": "true"}  # row groups without an asked symbol are skipped
    spread.write.options(compression="snappy", **bloom).partitionBy("exchange", "timeframe").parquet(path)


def append(new: DataFrame, store: str, batch: Batch | None = None, seen: Committed | None = None) -> str | None:
    """Writes candles as one batch and commits it; returns its folder's name, or None if ``batch`` is known already.

    The caller has checked the candles against the folders in ``seen``.
    """
    spark = new.sparkSession
    seen = seen or committed(spark, store)
    if seen.knows(batch):
        return None
    name = f"batch={uuid.uuid4().hex}"
    _laid_out(new.select(*KEY, *NUMBERS).withColumn("ingested_at", F.current_timestamp()), f"{store}/{name}")
    publish(spark, store, [*seen.batches, name], seen, batch)
    return name


def named(rows: DataFrame, name: str) -> Batch:
    """The identity of a caller's batch: its name and its content, whatever the order of the rows."""
    h = [F.xxhash64(F.lit(i), *KEY, *NUMBERS).cast("decimal(38,0)") for i in (1, 2)]
    n, a, b = rows.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(x), F.lit(0)) for x in h]).first()
    return Batch(f"{name}#{n}.{int(a) % 2**64:016x}{int(b) % 2**64:016x}")


def write(candles: DataFrame, store: str, name: str | None = None) -> int:
    """Adds candles: equal ones that are stored change nothing; candles that break the candle rules, and other values for a stored key, raise and nothing is written.  Returns how many were new.

    A batch of a ``name`` that was written with the same content is done already and isn't compared again, even if its
    candles have been dropped since; other content under that name is another batch.
    """
    from barloom.operators.ingest import batch_dedup, store_dedup
    from barloom.sources.files import candle_errors

    spark, path = candles.sparkSession, scratch(candles.sparkSession, "rows")
    candles.select(*KEY, *NUMBERS).withColumn("seq", F.monotonically_increasing_id()).write.parquet(path)  # numbered once, whatever executor is lost
    rows = spark.read.parquet(path)
    seen = committed(spark, store)
    batch = named(rows, name) if name is not None else None
    if seen.knows(batch):
        return 0
    broken = rows.select(candle_errors().alias("e")).where(F.size("e") > 0).limit(1).collect()
    if broken:
        raise ValueError(f"candles break the candle rules, such as: {'; '.join(broken[0]['e'])}")
    once = batch_dedup(rows)
    labels = store_dedup(once.where("label = 'FIRST'"), near(rows, _stored(spark, store, seen.batches))).persist()
    try:
        if not once.where("label = 'CONFLICT'").isEmpty() or not labels.where("store_label = 'CONFLICT'").isEmpty():
            raise ValueError("a candle of the same key has other values")
        new = labels.where("store_label = 'NEW'")
        n = new.count()
        if n:
            append(new, store, batch, seen)
        return n
    finally:
        labels.unpersist()


def near(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored candles of the series of ``rows``, each within the span of its rows there; the whole span prunes row groups."""
    spans = rows.where("timestamp is not null").groupBy(*[F.col(c).alias(f"_{c}") for c in SERIES]).agg(F.min("timestamp").alias("_from"), F.max("timestamp").alias("_to"))
    whole = spans.agg(F.min("_from").alias("a"), F.max("_to").alias("b")).first()
    if whole["a"] is None:
        return stored.where("false")
    inside = stored.where(F.col("timestamp").between(F.lit(whole["a"]), F.lit(whole["b"])))
    on = [F.col(c) == F.col(f"_{c}") for c in SERIES]
    return inside.join(spans, [*on, F.col("timestamp").between(F.col("_from"), F.col("_to"))], "left_semi")


def _stored(spark: SparkSession, store: str, listed: list[str] | None = None) -> DataFrame:
    """One scan over all committed batches."""
    listed = batches(spark, store) if listed is None else listed
    if not listed:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("basePath", store).parquet(*[f"{store}/{name}" for name in listed])


def compact(spark: SparkSession, store: str) -> str | None:
    """Writes all committed batches anew as one and publishes it in their place; the old folders stay for who reads them."""
    seen = committed(spark, store)
    if len(seen.batches) < 2:
        return None
    name = f"batch={uuid.uuid4().hex}"
    _laid_out(_stored(spark, store, seen.batches).drop("batch"), f"{store}/{name}")
    publish(spark, store, [name], seen)
    return name


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes the batch folders and lists that the newest list has replaced; only when nobody reads or writes them.  Returns how many batches went."""
    number, listed, _ = committed(spark, store)
    fs, p = _fs(spark, store)
    gone = 0
    for f in fs.listStatus(p) if number else []:
        name = f.getPath().getName()
        old = LIST.fullmatch(name)
        if name.startswith("batch=") and name not in listed or old and int(old[1]) < number:
            fs.delete(f.getPath(), True)
            gone += not old
    return gone


def read_candles(spark: SparkSession, store: str, symbols: list[str] | None = None, exchange: str | None = None, timeframe: str | None = None, start=None, end=None, ordered: bool = False) -> DataFrame:
    """Candles of the given keys (compared without case) between two stamps, both included.  The predicates prune partitions and row groups."""
    from barloom.sources.files import filter_range

    df = _stored(spark, store)
    if symbols is not None:
        df = df.where(F.col("symbol").isin([s.strip().upper() for s in symbols]))
    if exchange is not None:
        df = df.where(F.col("exchange") == exchange.strip().upper())
    if timeframe is not None:
        df = df.where(F.col("timeframe") == timeframe.strip().lower())
    df = filter_range(df, start, end).select(*KEY, *NUMBERS)
    return df.orderBy(*KEY) if ordered else df


def has_data(requested: DataFrame, candles: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Adds ``has_data`` to requested series: whether any candle is there, in the window from ``start`` to ``end`` (both
    included) if ``requested`` has these columns.  A null bound is open; a window that ends before it starts is empty.

    Windows meet candles by series and time bucket: one that starts inside a bucket is compared with the candles of that
    bucket alone, and beyond it only with the first stamp of the next bucket that isn't empty.
    """
    windowed = [c for c in ("start", "end") if c in requested.columns]
    asked = requested.select(*SERIES).distinct()
    candles = candles.select(*KEY).join(asked, SERIES, "left_semi")
    if not windowed:
        keys = candles.select(*SERIES).distinct().withColumn("has_data", F.lit(True))
        return requested.join(keys, SERIES, "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))
    bounds = {c: (F.col(c).cast("timestamp") if c in windowed else F.lit(None).cast("timestamp")).alias(f"_{c}") for c in ("start", "end")}
    windows = requested.select(*SERIES, *bounds.values()).distinct()
    bucket = lambda c: F.floor(F.unix_seconds(c) / bucket_seconds)
    dealt = candles.where("timestamp is not null").withColumn("_bucket", bucket("timestamp"))
    windows = windows.withColumn("_bucket", bucket("_start"))

    stamps = dealt.select(*[F.col(c).alias(f"_c_{c}") for c in SERIES], F.col("_bucket").alias("_b"), F.col("timestamp").alias("_at"))
    same = [F.col(c) == F.col(f"_c_{c}") for c in SERIES]
    within = (F.col("_at") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("_at") <= F.col("_end")))
    near_start = windows.where("_start is not null").join(stamps, [*same, F.col("_bucket") == F.col("_b"), within], "left_semi").select(*SERIES, "_start", "_end")

    firsts = dealt.groupBy(*SERIES, "_bucket").agg(F.min("timestamp").alias("_first"))
    asks = windows.select(*SERIES, "_bucket").distinct().withColumn("_first", F.lit(None).cast("timestamp"))
    both = firsts.withColumn("_asks", F.lit(False)).unionByName(asks.withColumn("_asks", F.lit(True)))
    # From the last bucket backwards, what is asked of a bucket before its own candles: the least stamp so far is of later buckets.
    backwards = Window.partitionBy(*SERIES).orderBy(F.col("_bucket").desc_nulls_last(), F.col("_asks").desc())
    ahead = F.min("_first").over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    ahead = both.withColumn("_next", ahead).where("_asks and _next is not null").select(*[F.col(c).alias(f"_c_{c}") for c in SERIES], F.col("_bucket").alias("_b"), "_next")
    reaches = F.col("_end").isNull() | ((F.col("_next") <= F.col("_end")) & (F.col("_start").isNull() | (F.col("_start") <= F.col("_end"))))
    after = windows.join(ahead, [*same, F.col("_bucket").eqNullSafe(F.col("_b")), reaches], "left_semi").select(*SERIES, "_start", "_end")

    found = near_start.unionByName(after).distinct().select(*[F.col(c).alias(f"_c_{c}") for c in SERIES], F.col("_start").alias("_s"), F.col("_end").alias("_e"), F.lit(True).alias("has_data"))
    on = [*same, bounds["start"].eqNullSafe(F.col("_s")), bounds["end"].eqNullSafe(F.col("_e"))]
    return requested.join(found, on, "left").withColumn("has_data", F.coalesce("has_data", F.lit(False))).select(*requested.columns, "has_data")


def dataset_catalog(candles: DataFrame) -> DataFrame:
    """Per series: first and last stamp, records, ``validation_status`` and, for stored candles, the last ingestion.

    The status is that of a quality report: INVALID if a candle breaks the candle rules or a stamp repeats, WARNING if
    neighbouring stamps are further apart than the timeframe, else VALID.
    """
    from barloom.sources.files import candle_errors

    before = F.lag("timestamp").over(series())
    rows = candles.withColumns({"_bad": (F.size(candle_errors()) > 0) | F.coalesce(before == F.col("timestamp"), F.lit(False)), "_gap": F.coalesce(micros("timestamp") - micros(before) > interval() * 1_000_000, F.lit(False))})
    extra = [F.max("ingested_at").alias("ingested_at")] if "ingested_at" in candles.columns else []
    status = F.when(F.max("_bad"), "INVALID").when(F.max("_gap"), "WARNING").otherwise("VALID")
    return rows.groupBy(*SERIES).agg(F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"), F.count(F.lit(1)).alias("record_count"), status.alias("validation_status"), *extra)


def store_catalog(spark: SparkSession, store: str) -> DataFrame:
    return dataset_catalog(_stored(spark, store))


def list_datasets(candles: DataFrame) -> DataFrame:
    return candles.select(*SERIES).distinct()


def drop_series(spark: SparkSession, store: str, keys: DataFrame) -> bool:
    """Removes the series of ``keys``: the batches that hold some of them are rewritten as one, published in their place.  True if any was there."""
    seen = committed(spark, store)
    stored = _stored(spark, store, seen.batches)
    hit = sorted(r["batch"] for r in stored.join(keys, SERIES, "left_semi").select("batch").distinct().collect())  # names of batches
    if not hit:
        return False
    touched = {f"batch={b}" for b in hit}
    name = f"batch={uuid.uuid4().hex}"
    _laid_out(stored.where(F.col("batch").isin(hit)).join(keys, SERIES, "left_anti").drop("batch"), f"{store}/{name}")
    publish(spark, store, [*[b for b in seen.batches if b not in touched], name], seen)
    return True
