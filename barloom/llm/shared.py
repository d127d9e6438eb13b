"""Pieces that several training-data operators use: input tables, staged tables, distributed running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word of the contracts: a run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts may be very long, so an Arrow batch holds few of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; only local sessions may do without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="spark-barloom-")
    return f"file://{shared_dir.own}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def ends_with_application(spark: SparkSession, path: str) -> None:
    """The folder at ``path``, which is there already, is deleted when the application ends."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, lost executors cost nothing.

    The folder goes when the application ends, or with ``release``.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    ends_with_application(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of staged tables that nothing reads any more."""
    for df in frames:
        fs, p = _file_system(df.sparkSession, df.staged_path)
        fs.delete(p, True)


def hash_key(*cols) -> F.Column:
    """A uniform key of 60 bits from the MD5 of the columns as text (nulls count as empty)."""
    text = F.concat_ws("\x1f", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_key(df: DataFrame) -> list[F.Column]:
    """``k1, k2``: 128 bits of hashes of a row's whole content; only rows that are equal in all columns share them."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    parts = [*cols, *[c.isNull() for c in cols]]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(7), *reversed(parts)).alias("k2")]


def running_total(df: DataFrame, group: str, size: str, out: str, order: list[str]) -> DataFrame:
    """``df`` (narrow columns) with ``out``: the sum of ``size`` over the rows of the same ``group`` that come before in ``order``.

    A group may hold a third of all rows, so no window spans a group: the rows are dealt by ranges of group and order,
    as many as the data needs; the ranges' sums are added up over one row per group and range, and only the rows of one
    range are sorted together.  Give ``order`` a last column that tells all rows apart, so that ties can be split.
    """
    dealt = staged(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "_range").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn(out, F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .join(sums, dealt[group].eqNullSafe(sums["_g"]) & (dealt["_range"] == sums["_r"]))
        .withColumn(out, F.col("_base") + F.col(out))
        .drop("_range", "_g", "_r", "_base")
    )
