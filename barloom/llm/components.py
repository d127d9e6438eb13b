"""Connected components of a link table, by alternating large-star and small-star steps.

Every step keeps the components and moves links towards the smallest node; no node's links are ever gathered in one
row, and no table reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import release, staged


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (a < b).  Large: each node ties its larger neighbours to its least one; small: its smaller ones and itself."""
    near = links.select(F.col("b").alias("n"), F.col("a").alias("m"))
    if large:
        near = near.unionByName(links.select(F.col("a").alias("n"), F.col("b").alias("m")))
    least = near.groupBy("n").agg(F.min("m").alias("least")).select(F.col("n").alias("n_"), F.least("n", "least").alias("least"))
    tied = near.join(least, F.col("n") == F.col("n_"))
    if large:
        out = tied.where("m > n").select(F.col("least").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.where("m <> least").select(F.col("least").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("least").alias("a"), F.col("n_").alias("b")))
    return out.where("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``links`` (two columns of longs) that isn't its component's least node; ``label`` is that node."""
    u, v = links.columns
    now = staged(links.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        old, now = now, staged(_stars(_stars(now, True), False), "links")
        before, mark = mark, _mark(now)
        release(old)
        if before == mark:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("label"))
