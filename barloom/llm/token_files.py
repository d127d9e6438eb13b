"""Token ids in Parquet list columns.

``write`` orders documents by id over ranges and writes ``doc_id, part, at, n_tokens, ids``: dictionary encoding for
the ids (a vocabulary fits one dictionary page), delta encoding for the counters, bounded row groups and small pages
with a page index.  So a reader takes only the metadata columns, or only the pages of the documents it asks for.

Null text counts as empty: the end token alone.  Null ids come first; repeated rows are separate documents, in any order.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.shared import ends_with_application, shared_dir
from barloom.llm.tokens import encoder

END = b"\x00\x00\x00\x00"
SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
OPTIONS = {
    "compression": "snappy",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
}


def write(docs: DataFrame, path: str, vocabulary: str) -> None:
    """Writes the ids of ``doc_id, text`` in ascending order of ``doc_id``; ``at`` counts the ids before a document in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for b in batches:
            packed = [data + END for data in encode(b.column(1).to_pylist())]
            sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            ends = np.cumsum(sizes)
            flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), flat)
            columns = [b.column(0), pa.array(np.full(len(sizes), part, dtype=np.int32)), pa.array(done + ends - sizes), pa.array(sizes), lists]
            done += int(ends[-1]) if len(ends) else 0
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "at", "n_tokens", "ids"])

    # the place in the input splits an id that very many rows have
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("n"))
    ordered = placed.repartitionByRange("doc_id", "n").sortWithinPartitions("doc_id", "n").drop("n")
    ordered.mapInArrow(run, SCHEMA).write.options(**OPTIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """``part, base``: the ids before each part, from the metadata columns alone.  One row per file."""
    sums = files.groupBy("part").agg(F.max(F.col("at") + F.col("n_tokens")).alias("n"))
    return sums.select(F.col("part").alias("part_"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def digest(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, cuts = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy().tolist()
            sums = pa.array([zlib.crc32(flat[a:z].tobytes()) for a, z in zip(cuts, cuts[1:])], pa.int64())
            sizes = pa.array(np.diff(cuts).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sizes, sums], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    read_back = files.select("doc_id", "part", "at", "ids").mapInArrow(run, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    based = read_back.join(starts(files), F.col("part") == F.col("part_"))
    return based.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Writes the files and gives what they hold.  Without ``path`` they lie in the shared folder and go when the application ends."""
    spark = docs.sparkSession
    own = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}" if path is None else None
    write(docs, path or own, vocabulary)
    if own:
        ends_with_application(spark, own)
    return digest(read(spark, path or own))
