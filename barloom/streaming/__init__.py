"""Incremental ingestion: candle files that arrive in a folder, ingested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barloom.functions.candles import NUMBERS, SERIES
from barloom.operators.ingest import ingest
from barloom.sources.files import norm_keys, parsed
from barloom.sources.store import Batch, StoreChanged

#: Files of a stream have fixed columns, all read as text.
TEXT = T.StructType([T.StructField(c, T.StringType()) for c in [*SERIES, "timestamp", *NUMBERS]])


#: How often a batch is tried when other writers commit to its store meanwhile.
TRIES = 10


def ingest_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, zone: str | None = None, scope: str = "series") -> StreamingQuery:
    """Ingests the CSV files of ``folder`` and ends when all that is there is done.

    Each micro-batch goes through the one gate of ``ingest`` as the batch of its number of the query's id, which stays
    with the checkpoint.  So a batch that is run again after a failure is known and skipped, and several streams (or one
    that begins anew with another checkpoint) may write to one store, at the same time too.
    """
    rows = spark.readStream.schema(TEXT).option("header", True).csv(folder)

    def one(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        read = parsed(norm_keys(batch.withColumn("seq", F.monotonically_increasing_id())), zone)
        for left in range(TRIES - 1, -1, -1):
            try:
                ingest(read, store, scope=scope, batch=Batch(f"stream-{query}", number))
                return
            except StoreChanged:
                if not left:
                    raise

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
