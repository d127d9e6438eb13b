"""Best-fit packing of documents into sequences, by bin completion with branch and bound.

Documents become pieces of at most ``capacity`` tokens.  Pieces of equal length are interchangeable, so the search
works on how many pieces there are of each length: a table of at most ``capacity`` rows, whatever the corpus.
Best-fit gives the first incumbent.  Then sequences are completed around the largest piece that is left, with the
undominated fillings of the remaining room; a filling is used as often as the counts allow, and branches whose waste
can't beat the incumbent are pruned.  The search ends at the lower bound or after ``nodes`` nodes; every piece is
placed either way.  The plan says which sequences hold how many pieces of a length; Spark numbers the pieces of each
length and so finds every piece's place.

Null text counts as empty: a document of the end token alone.  Repeated rows are separate documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import hash_key, running_total, staged
from barloom.llm.tokens import MOST_PIECES, encoder

CAPACITY = 2048
END = b"\x00\x00\x00\x00"

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing: every piece goes where the least room is left; equal sequences are kept as one with a count."""
    open_: dict[int, list[list]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                per = capacity // length
                if left >= per:
                    open_.setdefault(capacity - per * length, []).append([(length,) * per, left // per])
                    left %= per
                else:
                    open_.setdefault(capacity - left * length, []).append([(length,) * left, 1])
                    left = 0
                continue
            group = open_[room][-1]
            used = min(group[1], left)
            open_.setdefault(room - length, []).append([(*group[0], length), used])
            group[1] -= used
            left -= used
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
    return [(f, n) for groups in open_.values() for f, n in groups]


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: all tokens, or for some cut the pieces too long to share a sequence plus what the others need beyond their room."""
    total = sum(length * n for length, n in counts.items())
    bound = -(-total // capacity)
    for cut in [0, *sorted({length for length in counts if 2 * length <= capacity})]:
        large = [(length, n) for length, n in counts.items() if length > capacity - cut]
        middle = [(length, n) for length, n in counts.items() if capacity - cut >= length and 2 * length > capacity]
        small = sum(length * n for length, n in counts.items() if cut <= length and 2 * length <= capacity)
        alone = sum(n for _, n in large) + sum(n for _, n in middle)
        room = sum((capacity - length) * n for length, n in middle)
        bound = max(bound, alone + max(0, -(-(small - room) // capacity)))
    return bound


def dominates(one: Filling, other: Filling) -> bool:
    """Whether the pieces of ``other`` fit into those of ``one`` as bins (first fit): then ``one`` is no worse."""
    rooms = list(one)
    for length in other:
        at = next((i for i, r in enumerate(rooms) if r >= length), None)
        if at is None:
            return False
        rooms[at] -= length
    return True


def fillings(counts: np.ndarray, room: int, most: int | None = 3, steps: int | None = 3000) -> list[Filling]:
    """Undominated fillings of ``room``, least waste first: up to ``most`` of them, found in ``steps`` steps, or all if both are None.  A single piece that fits exactly dominates all."""
    if room and counts[room]:
        return [(room,)]
    lengths = np.flatnonzero(counts[: room + 1])
    lengths = lengths[lengths > 0][::-1].tolist()
    if not lengths:
        return [()]
    falling = [-x for x in lengths]
    shortest, found, budget = lengths[-1], [], [float("inf") if steps is None else steps]
    enough = float("inf") if most is None else most

    def note(waste: int, filling: Filling) -> None:
        found.append((waste, filling))
        found.sort(key=lambda x: (x[0], len(x[1])))
        if most is not None:
            del found[4 * most :]

    def grow(chosen: Filling, left: int, at: int, more: bool) -> None:
        """Goes on with how many pieces of one length after another; different lengths are few, since they add up to ``room``.  ``more``: another piece of the last length would fit."""
        full = not more
        for i in range(bisect_left(falling, -left, at), len(lengths)):
            length = lengths[i]
            limit = min(int(counts[length]), left // length)
            full = False
            closing = next((n for n in range(1, limit + 1) if (rest := left - n * length) >= shortest and rest <= length and counts[rest] > (n if rest == length else 0)), None)
            if closing:
                note(0, (*chosen, *[length] * closing, left - closing * length))
                limit = closing - 1
            for n in range(limit, 0, -1):
                budget[0] -= 1
                if budget[0] < 0 or found and found[0][0] == 0 and len(found) >= enough:
                    return
                grow((*chosen, *[length] * n), left - n * length, i + 1, n < limit or bool(closing))
        if full or left < shortest:
            note(left, chosen)

    grow((), room, 0, False)
    out: list[Filling] = []
    for _, f in sorted(set(found), key=lambda x: (x[0], len(x[1]), tuple(-a for a in x[1]))):
        if len(out) < enough and not any(dominates(o, f) for o in out):
            out.append(f)
    return out or [()]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = 6000, most: int | None = 3, steps: int | None = 3000) -> Plan:
    """Few sequences for the pieces: fillings with how often each is used.

    With ``nodes``, ``most`` and ``steps`` of None the search is whole: every undominated filling is tried, each used once
    before the next choice, so the plan is a shortest one; that is for few pieces.
    """
    counts = {length: n for length, n in counts.items() if n}
    if not counts:
        return []
    incumbent = best_fit(counts, capacity)
    best, bound = sum(n for _, n in incumbent), least_sequences(counts, capacity)
    if best == bound:
        return incumbent
    total = sum(length * n for length, n in counts.items())
    start = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        start[length] = n
    # depth-first; a frame is the counts, the plan's length and sequences so far, and the fillings still to try
    plan: Plan = []
    stack: list[tuple[np.ndarray, int, int, int, list[Filling]]] = []

    def frame(now: np.ndarray, made: int, waste: int) -> tuple:
        longest = int(np.flatnonzero(now)[-1])
        now[longest] -= 1
        options = [(longest, *f) for f in fillings(now, capacity - longest, most, steps)]
        now[longest] += 1
        return now, len(plan), made, waste, options[::-1]

    stack.append(frame(start, 0, 0))
    left = float("inf") if nodes is None else nodes
    while stack and left and best > bound:
        now, depth, made, waste, options = stack[-1]
        del plan[depth:]
        if not options:
            stack.pop()
            continue
        left -= 1
        chosen = options.pop()
        need = Counter(chosen)
        times = 1 if nodes is None else min(int(now[length]) // n for length, n in need.items())
        lost = waste + times * (capacity - sum(chosen))
        if total + lost > capacity * (best - 1):
            continue  # the waste so far already costs what the incumbent takes
        after = now.copy()
        for length, n in need.items():
            after[length] -= n * times
        plan.append((chosen, times))
        if after.any():
            stack.append(frame(after, made + times, lost))
        else:
            best, incumbent = made + times, list(plan)
    return incumbent


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False, remembered: int = MOST_PIECES) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, the packed ``ids`` of every document's pieces."""

    def run(texts: pd.Series) -> pd.Series:
        width, out = 4 * capacity, []
        for data in encoder(path, remembered).encode(texts):
            data += END
            cut = [(i, at // 4, data[at : at + width]) for i, at in enumerate(range(0, len(data), width))]
            out.append([{"piece": i, "start": start, "length": len(p) // 4, "ids_crc32": zlib.crc32(p), "ids": p if ids else None} for i, start, p in cut])
        return pd.Series(out)

    cut = F.pandas_udf(run, "array<struct<piece: int, start: long, length: long, ids_crc32: long, ids: binary>>")
    made = docs.select("doc_id", F.explode(cut("text")).alias("_p")).select("doc_id", "_p.*")
    return made if ids else made.drop("ids")


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: where runs of equal places begin, counted in pieces; the run's first sequence, places in a sequence, and offset."""
    out: dict[int, list] = {}
    first = 0
    for filling, times in plan:
        at = 0
        for length, n in sorted(Counter(filling).items(), reverse=True):
            out.setdefault(length, []).append((n * times, first, n, at))
            at += n * length
        first += times
    found = {}
    for length, runs in out.items():
        size, seq, per, at = np.array(runs, dtype=np.int64).T
        found[length] = (np.concatenate(([0], np.cumsum(size)[:-1])), seq, per, at)
    return found


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False, remembered: int = MOST_PIECES) -> DataFrame:
    """The pieces of ``doc_id, text`` with ``sequence_id`` and ``offset``; other columns aren't carried."""
    key = hash_key("doc_id", "piece", "ids_crc32")
    cut = staged(pieces(docs, path, capacity, ids, remembered).withColumns({"_key": key, "_one": F.lit(1), "_row": F.monotonically_increasing_id()}), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    shared = docs.sparkSession.sparkContext.broadcast(places(complete(counts, capacity)))

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, k = length.to_numpy(), rank.to_numpy()
        seq, at = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
        for one in np.unique(n):
            mine = n == one
            begin, first, per, offset = shared.value[int(one)]
            run = np.searchsorted(begin, k[mine], side="right") - 1
            inside = k[mine] - begin[run]
            seq[mine] = first[run] + inside // per[run]
            at[mine] = offset[run] + inside % per[run] * one
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    narrow = [c for c in cut.columns if c != "ids"]
    ranked = running_total(cut.select(*narrow), "length", "_one", "_rank", ["_key", "_row"])
    placed = ranked.withColumn("_at", F.pandas_udf(place, "sequence_id long, offset long")("length", "_rank"))
    out = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset", "_row")
    if ids:  # only narrow rows are ranked; the ids are joined once
        out = out.join(cut.select(F.col("_row").alias("_of"), "ids"), F.col("_row") == F.col("_of")).drop("_of")
    return out.drop("_row")
