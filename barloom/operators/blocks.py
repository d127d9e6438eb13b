"""Indicators of series of any length: every task holds one block of a series, however long the series is.

The rows of all series are dealt by ranges of series and time and numbered in their series; a series is cut into blocks
of ``rows`` candles, and each block gets the last candles of the block before it (its halo), as many as the widest window
reaches back.  Windows then run per block, and halo rows go.

Recurrences are scans of affine maps.  One candle changes the state of an exponential average (the sum that its seed is
made of, and its value) by an affine map, so a whole block does: state -> A state + b.  A first pass takes each block's
A and b, a small table with one row per block; these are combined along each series, which gives the state that each
block begins with; a second pass runs the blocks from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.candles import KEY, NUMBERS, SERIES, parts_of_series
from barloom.functions.scratch import scratch
from barloom.operators import indicators as I
from barloom.operators.scans import INPUTS, SCANS, Runs, Scans, bars_of

BLOCK = [*SERIES, "_block"]


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def indexed(df: DataFrame) -> DataFrame:
    """Adds ``_i``, the place of a row in its series by time, and ``_length``, the rows of the series; no task holds a series."""
    ranges = written(df.repartitionByRange(*KEY).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*SERIES).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy(*SERIES, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(c).alias(f"_{c}") for c in SERIES], F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*SERIES)).alias("_length"))
    inside = F.row_number().over(Window.partitionBy(*SERIES, "_range").orderBy("timestamp")) - 1
    on = [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SERIES], F.col("_range") == F.col("_r")]
    return ranges.withColumn("_in", inside).join(counts, on).withColumn("_i", F.col("_base") + F.col("_in")).drop("_range", "_r", "_base", "_in", *[f"_{c}" for c in SERIES])


def cut(df: DataFrame, rows: int, halo: int) -> DataFrame:
    """The rows of ``indexed`` with their ``_block``, and once more in the next block if they belong to its halo (at most ``rows`` candles)."""
    own = F.floor(F.col("_i") / rows)
    next_too = F.when(F.col("_i") % rows >= rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    made = df.withColumn("_block", F.explode(next_too))
    return made.where(F.col("_block") <= F.floor((F.col("_length") - 1) / rows)).drop("_length")  # no block of a halo alone


def scanned(df: DataFrame, specs: list[I.Spec], rows: int, lead: int) -> DataFrame:
    """Adds the values of ``specs`` to the rows of blocks, and leaves out halo rows but for ``lead``.

    A block's states begin ``lead`` candles before it, so that lagged values of its first candles are there too.
    Tasks go through their blocks in order, many at once; of a block that a batch ends in, a task keeps the rows.
    """
    scans = Scans(specs)
    begin = F.greatest(F.col("_block") * rows - lead, F.lit(0))
    block_fields = [f for f in df.schema.fields if f.name in BLOCK]

    def begun(part: pd.DataFrame) -> np.ndarray:
        """The first rows of the blocks; those of two series never go on from one place to the next."""
        place, block = part["_i"].to_numpy(), part["_block"].to_numpy()
        return np.flatnonzero(np.append(True, (place[1:] != place[:-1] + 1) | (block[1:] != block[:-1])))

    def map_of(part: pd.DataFrame) -> pd.DataFrame:
        starts = begun(part)
        runs = Runs(part["_i"].to_numpy(), starts)
        shift = scans.run(bars_of(*[part[c] for c in INPUTS]), runs, np.zeros((len(starts), scans.size)))[1]
        return part.iloc[starts][[*BLOCK, "_i"]].assign(n=runs.last - starts + 1, shift=list(shift))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            part = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(part):
                cut = begun(part)[-1]
                held = part.iloc[cut:]
                if cut:
                    yield map_of(part.iloc[:cut])
        if held is not None:
            yield map_of(held)

    known: dict[tuple[int, int], list[np.ndarray]] = {}

    def scale(first: int, n: int) -> list[np.ndarray]:
        """What ``n`` candles from place ``first`` make of states, apart from their own numbers: a matrix for each indicator."""
        key = min(first, scans.seeded), n
        if key not in known:
            none = {k: np.zeros(n) for k in ("close", "step", "tr", "volume")}
            known[key] = [np.array([run(none, first, unit)[1] for unit in np.eye(size)]) for (_, _, run), size in zip(scans.plans, scans.sizes)]
        return known[key]

    def combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = np.zeros(scans.size)
        for b in batches:
            begins = []
            for block, first, n, shift in zip(b["_block"], b["_i"], b["n"], b["shift"]):
                if block == 0:
                    state = np.zeros(scans.size)
                begins.append(state)
                at, after = 0, []
                for matrix in scale(int(first), int(n)):
                    after.append(state[at : at + len(matrix)] @ matrix)
                    at += len(matrix)
                state = np.concatenate(after) + shift
            yield b[BLOCK].assign(state=begins)

    pairs = T.StructType([*block_fields, T.StructField("_i", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shift", T.ArrayType(T.DoubleType()))])
    states = T.StructType([*block_fields, T.StructField("state", T.ArrayType(T.DoubleType()))])
    mine = df.where((F.col("_i") >= begin) & (F.col("_i") < (F.col("_block") + 1) * rows - lead)).select(*KEY, "_block", "_i", *INPUTS)
    begins = mine.sortWithinPartitions(*BLOCK, "timestamp").mapInPandas(maps, pairs).repartition(*SERIES).sortWithinPartitions(*BLOCK).mapInPandas(combined, states)
    begins = begins.select(*[F.col(c).alias(f"_{c}") for c in SERIES], F.col("_block").alias("_b"), "state")
    met = df.where(F.col("_i") >= begin).join(begins, [*[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SERIES], F.col("_block") == F.col("_b")]).drop("_b", *[f"_{c}" for c in SERIES])
    met = met.withColumn("_state", F.when(F.col("_i") == begin, F.col("state"))).drop("state").sortWithinPartitions(*BLOCK, "timestamp")
    return I.valued(met, specs, "_state").drop("_state")


def compute(df: DataFrame, specs: list[I.Spec], benchmark: DataFrame | None, keep_index: bool, strict: bool, rows: int) -> DataFrame:
    """``indicators.compute`` with at most ``rows`` candles and a halo in one task."""
    scans = [s for s in specs if s.name in SCANS]
    others = [s for s in specs if s.name not in SCANS]
    endless = [s.name for s in others if s.indicator.kind == "series" or s.indicator.reach(s.p) is None]
    if endless:
        raise ValueError(f"indicators that need a whole series at once: {endless}")
    lead = Scans(scans).lead
    halo = max([1, lead + 1, *(s.indicator.reach(s.p) for s in others)])
    rows = max(rows, halo)
    blocks = written(cut(indexed(df.select(*KEY, *NUMBERS)), rows, halo), "blocks")
    with parts_of_series("_block"):
        out = I.windowed(blocks, [s for s in others if s.indicator.kind == "window"], [s for s in others if s.indicator.kind == "benchmark"], strict, true_range=bool(scans))
        if scans:
            out = scanned(out, scans, rows, lead)
    out = out.where(F.col("_i") >= F.col("_block") * rows)
    marked = [s for s in others if s.indicator.kind == "benchmark"]
    if marked:
        out = I._against(out, marked, benchmark)
    return out.drop("_prev", "_tr", "_block", *([] if keep_index else ["_i"]))
