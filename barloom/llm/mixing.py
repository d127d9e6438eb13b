"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key; the rows of a source are taken in key order.  The order is cut into key
ranges whose sums are added up, so running word counts need no task that holds a whole source.  A source takes whole
epochs of its documents and then the rows before its remaining budget; the document at the cut gives the words that
are left of the budget (``taken``), so each source meets its target to the word.

Null text has size 0; a null source is a source of its own and comes last; sources of size 0 get target 0.
Repeated rows are separate documents; rows of one id are taken by size, and those of one size by a hash of their text.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.shared import WORD, hash_key, row_key, running_total, staged

#: A source is read at most so many times.
MOST_EPOCHS = 3
WEIGHTS = (1, 2, 3)


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From one row ``source, source_size`` per source: adds ``target``, its part of the words of all sources.

    Shares follow the weights; a source whose share passes MOST_EPOCHS times its size stops there and the others
    take the rest by weight.  Sources are few, so one window orders them by the level at which they stop.
    """
    all_rows = Window.partitionBy(F.lit(1))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    df = sizes.withColumn("_w", cycle).withColumn("_cap", F.col("source_size") * float(MOST_EPOCHS))
    by_level = all_rows.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = by_level.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"_total": F.sum("source_size").over(all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double"), "_caps": F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)), "_left": F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing))})
    df = df.withColumn("_full", F.col("_cap") * F.col("_left") <= (F.col("_total") - F.col("_caps")) * F.col("_w"))
    whole = all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_used": F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(whole), "_open": F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(whole)})
    share = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_total") - F.col("_used")) * F.col("_w") / F.col("_open"))
    return df.select("source", "source_size", share.alias("target"))


def _planned(docs: DataFrame, *more: Column) -> DataFrame:
    """Narrow rows ``doc_id, source, _size`` and ``more`` with ``source_size, target, _epochs, _rest, _before``: the words that a source still wants after whole epochs, and those that come before the row."""
    rows = docs.select("doc_id", "source", word_count("text").alias("_size"), F.xxhash64("text").alias("_text"), hash_key("doc_id").alias("_key"), *more)
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "mix")
    per = targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size"))).withColumnRenamed("source", "_source")
    placed = running_total(rows, "source", "_size", "_before", ["_key", "doc_id", "_size", "_text", "_row"])
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div source_size")).otherwise(F.lit(0))
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("_epochs") * F.col("source_size")
    return placed.join(per, placed["source"].eqNullSafe(per["_source"])).withColumn("_epochs", epochs).withColumn("_rest", rest)


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``doc_id, text, source``; other columns aren't carried."""
    planned = _planned(docs)
    cut = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before")))
    return planned.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_epochs") * F.col("_size") + cut).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with all their columns.

    Texts stay whole, so the document at a source's cut comes once more if at least half of it fits; a document
    without words comes once.  Only narrow rows are ranked; the texts are joined to their counts once.
    """
    planned = _planned(docs, *row_key(docs))
    again = F.when(2 * F.col("_before") + F.col("_size") <= 2 * F.col("_rest"), 1).otherwise(0)
    copies = F.when(F.col("_size") > 0, F.col("_epochs") + again).otherwise(F.lit(1))
    per = staged(planned.groupBy("k1", "k2").agg(F.sum(copies).cast("int").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0").select(F.col("k1").alias("_taken_1"), F.col("k2").alias("_taken_2"), "_copies", "_rows"), "copies")
    keyed = docs.select("*", *[k.alias(c) for k, c in zip(row_key(docs), ("_row_key_1", "_row_key_2"))])
    held = keyed.join(per, (F.col("_row_key_1") == F.col("_taken_1")) & (F.col("_row_key_2") == F.col("_taken_2")))
    if not per.where("_rows > 1").isEmpty():  # rows that are equal in all columns: one of them stands for all
        held = held.where("_rows = 1").unionByName(held.where("_rows > 1").dropDuplicates(["_row_key_1", "_row_key_2"]))
    return held.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
