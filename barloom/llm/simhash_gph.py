"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are linked when they differ in at most ``distance`` bits.  Copies share a fingerprint, so the search runs
over distinct fingerprints only.  The bits are grouped into partitions, correlated bits together; each partition i gets
a threshold t_i >= -1 with sum(t_i + 1) = distance + 1, so every linked pair agrees up to t_i bits in some partition.
Dynamic programming picks the thresholds of least cost from candidate counts estimated on a bounded sample (it steers
the cost only, never the result).  Fingerprints probe by their partition bits with t_i of them masked; those that meet
are verified.  A bucket beyond ``BLOCK`` fingerprints is compared block by block in tasks of their own; its members are
still compared all with all, half the square of its size in XORs and bit counts, spread over as many tasks as it has
pairs of blocks.  Thresholds grow with the number of fingerprints, which keeps buckets small.

``near_duplicates`` links by the distance of 64-bit fingerprints alone.  Of a bucket it keeps a spanning forest of the
links, which joins the same components as all its pairs.

``deduplicated`` takes texts for near copies whose sets of five-word shingles have a cosine of ``SIMILARITY`` or more.
A first pass probes with wider fingerprints (``WIDE`` bits, of the set of words, which small changes move least), of
which all within ``PROBE_DISTANCE`` bits meet; what meets is verified on the shingles of the whole texts.  Of a bucket
every fingerprint keeps its nearest one and its neighbour of most neighbours, so candidates grow with the texts, not
with the square of a group.  A second pass is exact and finds every link that the first one left out between two of its
groups: texts whose cosine is high enough share a shingle among the first of each in one order of all shingles (prefix
filter).  The texts of such a shingle meet under the least of them, once for all shingles of which it is the least; pairs
of different groups that meet are candidates, unless their sketches, which grow with the texts, show that too many
shingles differ, or too few can be shared there; those are verified likewise.  So texts that share much and are no near
copies cost comparisons in a task, half the square of those that meet, but no rows unless their cosine is just under
``SIMILARITY``.

Null, empty and wordless texts have fingerprint zero and are linked like any other.  ``component_id`` is null only if
no document of the component has an id.  Repeated rows share a fingerprint and a component.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.components import components
from barloom.llm.shared import release, row_key, staged

BITS = 64
WIDE = 128
SEED = 42
#: Most fingerprints that one task row compares with each other (a pair of blocks holds twice as many).
BLOCK = 4096
SAMPLE = 2048
#: Relative cost of an emitted key and of a compared pair: some 6 microseconds of shuffle and join, and 15 nanoseconds, as measured.
KEY_COST, PAIR_COST = 1.0, 0.0025
#: Most bits that a probe of one partition hides (their choices are emitted as keys).
MOST_HIDDEN = 4
#: Near copies: least cosine of the sets of shingles; words of a shingle; wide fingerprints within the first distance
#: surely meet, those that meet are candidates up to the second.
SIMILARITY, SHINGLE = 0.8, 5
PROBE_DISTANCE, CANDIDATE_DISTANCE = 15, 24
#: Longs of a sketch, at least and at most: about so many bits for each shingle (this steers the cost only); most texts that a task row compares with each other in the exact pass.
SKETCH, SKETCH_MOST, SKETCH_BITS, LISTED = 8, 512, 2, 1024
#: Shingles that so many of so many sampled texts have are put last in the order of shingles, at most so many of them (this steers the cost only).
COMMON_LEAST, COMMON_SAMPLE, COMMON_MOST = 3, 20_000, 50_000


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) for every row."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", F.pandas_udf(run, "long")("text").alias("fp"))


def grouped_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The bit numbers in ``parts`` groups of equal size, each grown from the most correlated pair that is left."""
    width = bits.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        near = np.abs(np.nan_to_num(np.corrcoef(bits, rowvar=False))) if len(bits) > 1 else np.zeros((width, width))
    np.fill_diagonal(near, 0.0)
    left, out = list(range(width)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        sub = near[np.ix_(left, left)]
        group = [left[int(sub.max(axis=1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(near[np.ix_(rest, group)].sum(axis=1).argmax())])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def costs(bits: np.ndarray, group: list[int], most: int, n: int) -> list[float]:
    """Estimated cost of a partition by its threshold, -1 to ``most``: the keys that ``n`` fingerprints emit and the pairs that meet."""
    b, own = len(group), bits[: SAMPLE // 2, group].astype(np.float32)
    apart = own @ (1 - own).T
    apart = apart + apart.T
    pairs = max(1, len(own) * (len(own) - 1))
    seen = [(np.count_nonzero(apart == d) - (len(own) if d == 0 else 0)) / pairs for d in range(most + 1)]
    out = [0.0]
    for t in range(most + 1):
        met = sum(max(seen[d], comb(b, d) / 2.0**b) * comb(b - d, t - d) for d in range(t + 1))
        out.append(n * comb(b, t) * KEY_COST + n * n / 2 * met * PAIR_COST)
    return out


def plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, least in estimated cost over 2 to ``distance + 1`` partitions.

    ``sample`` has a row of one or more 64-bit words for each fingerprint.
    """
    words = np.ascontiguousarray(sample.astype(np.int64)).reshape(len(sample), *(sample.shape[1:] or (1,)))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), 8 * words.shape[1]), axis=1, bitorder="little")
    best = (float("inf"), [])
    for parts in range(2, distance + 2):
        most = min(distance, MOST_HIDDEN)
        if parts * (most + 1) < distance + 1:
            continue
        groups = grouped_bits(bits, parts)
        price = [costs(bits, g, most, n) for g in groups]
        table = {0: (0.0, [])}
        for i in range(parts):
            step: dict[int, tuple[float, list[int]]] = {}
            for used, (paid, chosen) in table.items():
                for t in range(-1, min(most, distance - used) + 1):
                    total = paid + price[i][t + 1]
                    if used + t + 1 not in step or total < step[used + t + 1][0]:
                        step[used + t + 1] = (total, [*chosen, t])
            table = step
        paid, chosen = table[distance + 1]
        if paid < best[0]:
            best = (paid, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def masks(partitions: list[tuple[list[int], int]], words: int = 1) -> list:
    """The bits that each probe keeps, as signed longs (tuples of them for several words): a partition's bits without every choice of t of them."""
    out = []
    for group, t in partitions:
        for hidden in combinations(group, t):
            mask = sum(1 << b for b in group if b not in hidden)
            split = tuple(signed(mask >> 64 * w & (1 << 64) - 1) for w in range(words))
            out.append(split if words > 1 else split[0])
    return out


def forest(fps: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints."""
    left = np.unique(np.asarray(fps, dtype=np.int64))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= distance
            if near.any():
                found, left = left[near], left[~near]
                queue += list(found)
                yield from ((int(at), int(x)) for x in found)


def small_forest(fps: list[int], distance: int) -> Iterator[tuple[int, int]]:
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance:
                yield a, b


def blocks(distinct: DataFrame, words: list[str], distance: int, carried: list[str], block: int) -> DataFrame:
    """Lists of the ``carried`` columns, side by side: the rows of ``distinct`` that meet in a probe of the fingerprint in ``words``."""
    n = distinct.count()
    some = distinct.where(F.pmod(F.xxhash64(*words), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20) + 1)).select(*words).limit(2 * SAMPLE)
    sample = np.array([tuple(r) for r in some.collect()], dtype=np.int64).reshape(-1, len(words))
    probes = [m if len(words) > 1 else (m,) for m in masks(plan(sample, max(n, SAMPLE), distance), len(words))]
    kept = lambda m: [F.col(w).bitwiseAND(F.lit(x).cast("long")) for w, x in zip(words, m) if x or len(words) == 1]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.xxhash64(*kept(m)) if len(kept(m)) > 1 else kept(m)[0]).alias("k")) for i, m in enumerate(probes)]))
    keyed = distinct.select(*carried, keys.alias("p")).select(*carried, "p.i", "p.k")
    sizes = keyed.groupBy("i", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return side_by_side(keyed.join(sizes, ["i", "k"]), ["i", "k"], carried, block)


def side_by_side(met: DataFrame, by: list[str], carried: list[str], block: int) -> DataFrame:
    """Lists of the ``carried`` columns of rows that are equal in ``by``, of which there are ``n``: of two blocks of about so many rows each."""
    met = met.withColumn("c", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64(*carried), F.col("c")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return met.groupBy(*by, F.least("own", "o").alias("lo_"), F.greatest("own", "o").alias("hi_")).agg(*[F.collect_list(c).alias(c) for c in carried]).select(*carried)


def links(distinct: DataFrame, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """``u, v``: verified links of the distinct fingerprints ``fp``, enough of them to join every component."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for fps in b["fp"]:
                found += small_forest(fps.tolist(), distance) if len(fps) <= 8 else forest(fps, distance)
            yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return blocks(distinct, ["fp"], distance, ["fp"], block).mapInPandas(verify, "u long, v long").distinct()


def clustered(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``doc_id, text``; other columns aren't carried."""
    made = staged(fingerprints(docs, shingle), "fingerprints")
    distinct = staged(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = components(links(distinct.select("fp"), distance))
    labelled = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id")).withColumnRenamed("label", "label_")
    named = staged(labelled.join(least, F.col("label") == F.col("label_")).select(F.col("fp").alias("fp_"), "component_id"), "named")
    return made.join(named, made["fp"] == named["fp_"]).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """``doc_id``, the fingerprint as 16 hex digits, and ``component_id`` (the least id reachable)."""
    return clustered(docs, distance, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def lowered(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Digests(dict):
    """word -> 16 bytes of its hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_128_digest(word, SEED)
        if len(self) < 100_000:
            self[word] = value
        return value


digests = Digests()


def wide(words: list[bytes]) -> tuple[int, int]:
    """The fingerprint of the set of words, as two signed words of 64 bits."""
    once = set(words)
    if not once:
        return 0, 0
    bits = np.unpackbits(np.frombuffer(b"".join([digests[w] for w in once]), dtype=np.uint8).reshape(-1, WIDE // 8), axis=1)
    low, high = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(once)).view(np.int64).tolist()
    return low, high


def content(words: list[bytes]) -> int:
    """A hash of the sequence of words; texts that differ in case or white space alone are one node of the links."""
    return signed(xxhash.xxh64_intdigest(b" ".join(words), SEED))


def apart(low: np.ndarray, high: np.ndarray, rows: slice) -> np.ndarray:
    """The distances of some fingerprints to all of them."""
    return np.bitwise_count(low[rows, None] ^ low[None, :]) + np.bitwise_count(high[rows, None] ^ high[None, :])


def neighbours(node: np.ndarray, low: np.ndarray, high: np.ndarray, distance: int, rows: int = 256) -> list[tuple[int, int]]:
    """Of each fingerprint that has others within ``distance`` bits: the one of them that has most, and the nearest one if that is nearer."""
    order = np.argsort(node)  # so equal sets give equal neighbours
    node, low, high = node[order], low[order].view(np.uint64), high[order].view(np.uint64)
    degree = np.concatenate([np.count_nonzero(apart(low, high, slice(i, i + rows)) <= distance, axis=1) for i in range(0, len(node), rows)]) - 1
    some = np.flatnonzero(degree)
    node, low, high, degree, out = node[some], low[some], high[some], degree[some].astype(np.int32), []
    for i in range(0, len(some), rows):
        far = apart(low, high, slice(i, i + rows))
        own = np.arange(len(far))
        far[own, own + i] = 255
        near, most = far.argmin(axis=1), np.where(far <= distance, degree[None, :], -1).argmax(axis=1)
        nearer = far[own, near] < far[own, most]
        here = node[i : i + rows]
        out += zip(here.tolist(), node[most].tolist())
        out += zip(here[nearer].tolist(), node[near[nearer]].tolist())
    return out


@lru_cache(64)
def shingles(text: str | None, width: int) -> frozenset[int]:
    words = lowered(text)
    n = max(1, len(words) - width + 1) if words else 0
    return frozenset(xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n))


def cosine(one: str | None, other: str | None, width: int = SHINGLE) -> float:
    """Cosine of the texts' sets of shingles; wordless texts are alike."""
    a, b = shingles(one, width), shingles(other, width)
    if not a or not b:
        return float(not a and not b)
    return len(a & b) / (len(a) * len(b)) ** 0.5


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The set of shingles as ascending hashes of 64 bits; of fewer words all are one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(width, len(words))
    own = np.frombuffer(b"".join([digests[w] for w in words]), dtype=np.uint64)[::2]
    n = len(words) - width + 1
    mixed = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[j : j + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ mixed >> np.uint64(32))


def sketch(hashes: np.ndarray) -> bytes:
    """Bits that tell whether an odd number of the shingles falls on them: two sketches differ in no more bits than the sets in shingles.

    Their number is a power of two; a sketch of half the bits is the sum of the halves.
    """
    longs = SKETCH
    while longs < SKETCH_MOST and 64 * longs < SKETCH_BITS * len(hashes):
        longs *= 2
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def halved(sketch: np.ndarray, longs: int) -> np.ndarray:
    """The sketch (rows of longs) in fewer longs."""
    while sketch.shape[-1] > longs:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles of a set: any two sets of that cosine share one of them.  ``common`` ones (ascending) come after all others, by their ``place``.

    Sets of such a cosine have ``similarity ** 2`` of the larger one in common at least, so all common shingles but one can lie behind these.
    """
    n = len(hashes)
    if len(common):
        at = np.searchsorted(common, hashes).clip(max=len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, place[at], -1), kind="stable")]
    return hashes[: min(n, n - ceil(similarity**2 * n - 1e-6) + 1)]


def least_shared(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of their prefixes sets of such sizes share at least if they have that cosine: what they share elsewhere lies behind the prefix that ends first."""
    return np.maximum(1, np.ceil(similarity * np.sqrt(a * b) - 1e-6) - np.ceil(similarity**2 * np.maximum(a, b) - 1e-6) + 1)


def most_apart(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """The most shingles by which sets of such sizes may differ; -1 if their sizes alone are too far apart."""
    return np.where(np.minimum(a, b) >= similarity**2 * np.maximum(a, b) - 1e-6, a + b - 2 * np.ceil(similarity * np.sqrt(a * b) - 1e-6), -1)


def possible(node: np.ndarray, label: np.ndarray, size: np.ndarray, sketches: list[bytes], similarity: float, shared: np.ndarray | None = None, rows: int = 128) -> list[tuple[int, int]]:
    """All pairs of different labels but those that sizes, sketches or ``shared`` (of each, how many shingles of its prefix others have) rule out."""
    made = [np.frombuffer(s, dtype=np.uint64) for s in sketches]
    longs, size, out = np.array([len(m) for m in made]), size.astype(np.float64), []
    level = {SKETCH: np.array([halved(m, SKETCH) for m in made])}  # of those of so many longs or more, others zero
    for i in range(0, len(node), rows):
        a, b, here = size[i : i + rows, None], size[None, :], slice(i, i + rows)
        may = (label[here, None] < label[None, :]) & (most_apart(a, b, similarity) >= 0)
        if shared is not None:
            may &= np.minimum(shared[here, None], shared[None, :]) >= least_shared(a, b, similarity)
        x, y = np.nonzero(may)
        x += i
        most, both, n = most_apart(size[x], size[y], similarity), np.minimum(longs[x], longs[y]), SKETCH
        while len(x):
            if n not in level:
                at = np.flatnonzero(longs >= n)
                level[n] = np.zeros((len(node), n), dtype=np.uint64)
                level[n][at] = [halved(made[k], n) for k in at]
            bits, step, near = level[n], max(1, (1 << 20) // n), both < n
            for j in np.split(np.flatnonzero(~near), range(step, np.count_nonzero(~near), step)):
                near[j] = np.bitwise_count(bits[x[j]] ^ bits[y[j]]).sum(axis=1, dtype=np.int64) <= most[j]
            x, y, most, both, n = x[near], y[near], most[near], both[near], 2 * n
            if not (both >= n).any():
                break
        out += zip(node[x].tolist(), node[y].tolist())
    return out


def common_shingles(texts: DataFrame, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of many texts in a bounded sample, ascending, and their places in the order of how common they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"s": np.concatenate([shingle_hashes(lowered(t), width) for t in b["text"]] or [np.zeros(0, np.uint64)]).view(np.int64)})

    some = texts.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 20)) < int(min(1.0, COMMON_SAMPLE / max(n, 1)) * (1 << 20) + 1))
    often = some.select("text").mapInPandas(run, "s long").groupBy("s").count().where(F.col("count") >= COMMON_LEAST)
    got = often.orderBy(F.desc("count"), "s").limit(COMMON_MOST).collect()
    found = np.array([r["s"] for r in got][::-1], dtype=np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], order


def left_out(texts: DataFrame, nodes: DataFrame, label: DataFrame, similarity: float, width: int, block: int) -> DataFrame:
    """``u, v``: texts of different labels that may be near copies, by the prefix filter.  ``texts`` (``k1, k2, text``) has each node's text."""
    n = nodes.count()
    common = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, n, width))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [lowered(t) for t in b["text"]]
            made = [prefix(shingle_hashes(w, width), similarity, *common.value) for w in words]
            node = np.repeat(np.array([content(w) for w in words], dtype=np.int64), [len(m) for m in made])
            yield pd.DataFrame({"s": np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64), "node": node})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = {(min(p), max(p)) for x in b.itertuples(index=False) for p in possible(x.node, x.label, x.size, list(x.sketch), similarity, x.shared)}
            yield pd.DataFrame(list(found), columns=["u", "v"], dtype="int64")

    by = Window.partitionBy("s")
    rows = texts.select("text").mapInPandas(first, "s long, node long").withColumns({"lo": F.min("node").over(by), "hi": F.max("node").over(by)})
    shared = staged(rows.where("lo <> hi").select("s", F.col("node").alias("of")), "shared")
    named = shared.join(label, F.col("of") == F.col("node"), "left").select("s", "of", F.coalesce("label", "of").alias("label"))
    named = named.withColumns({"under": F.min("of").over(by), "lo": F.min("label").over(by), "hi": F.max("label").over(by)})
    opened = staged(named.where("lo <> hi").groupBy("under", "of", "label").agg(F.count(F.lit(1)).alias("times")), "open")
    # texts that share a shingle meet under the least text that has it, once whatever they share
    own = opened.groupBy("of").agg(F.sum("times").alias("shared")).withColumnRenamed("of", "node_")
    own = nodes.select("node", "size", "sketch").join(own, F.col("node") == F.col("node_")).select("node", "size", "sketch", "shared")
    sizes = opened.groupBy("under").agg(F.count(F.lit(1)).alias("n"))
    met = opened.join(sizes, "under").join(own, F.col("of") == F.col("node")).select("under", "n", "node", "label", "size", "shared", "sketch")
    out = side_by_side(met, ["under"], ["node", "label", "size", "shared", "sketch"], block).mapInPandas(pairs, "u long, v long")
    out = staged(out.distinct(), "left_out")
    release(shared, opened)
    return out


def verified(met: DataFrame, keyed: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs ``u, v`` of ``met`` whose texts have the cosine."""
    asked = staged(nodes.join(met.select("u").union(met.select("v")).distinct(), F.col("node") == F.col("u"), "left_semi").select("node", F.col("k1").alias("k1_"), F.col("k2").alias("k2_")), "asked")
    texts = keyed.select("k1", "k2", "text").join(within(asked.select("k1_", "k2_")), (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left_semi")
    held = staged(asked.join(texts, (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_"))).select("node", "text").dropDuplicates(["node"]), "texts")
    alike = F.pandas_udf(lambda a, b: pd.Series([cosine(x, y, shingle) for x, y in zip(a, b)]), "double")
    first = met.join(held.withColumnsRenamed({"node": "a", "text": "one"}), F.col("u") == F.col("a"))
    both = first.join(held.withColumnsRenamed({"node": "b", "text": "other"}), F.col("v") == F.col("b"))
    out = staged(both.where(alike("one", "other") >= similarity).select("u", "v"), "verified")
    release(asked, held)
    return out


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, distance: int = PROBE_DISTANCE, block: int = BLOCK) -> DataFrame:
    """``k1, k2`` (the key of the row's whole content), ``doc_id`` and ``label``, equal for rows of one group of near copies, for every row of ``docs``."""

    def run(texts: pd.Series) -> pd.DataFrame:
        words = [lowered(t) for t in texts]
        sets = [shingle_hashes(w, shingle) for w in words]
        return pd.DataFrame([(content(w), *wide(w), len(s), sketch(s)) for w, s in zip(words, sets)], columns=["node", "low", "high", "size", "sketch"])

    keyed = docs.select(*row_key(docs), "doc_id", "text")
    made = keyed.select("k1", "k2", "doc_id", F.pandas_udf(run, "node long, low long, high long, size int, sketch binary")("text").alias("_f"))
    made = staged(made.select("k1", "k2", "doc_id", "_f.*"), "fingerprints")
    nodes = made.groupBy("node", "low", "high", "size", "sketch").agg(F.min(F.struct("k1", "k2")).alias("row"))
    nodes = staged(nodes.select("node", "low", "high", "size", "sketch", "row.*"), "nodes")

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [pair for x in b.itertuples(index=False) for pair in neighbours(x.node, x.low, x.high, CANDIDATE_DISTANCE)]
            yield pd.DataFrame([p for p in found if p[0] != p[1]], columns=["u", "v"], dtype="int64")

    met = blocks(nodes, ["low", "high"], distance, ["node", "low", "high"], block).mapInPandas(candidates, "u long, v long")
    met = staged(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    linked = verified(met, keyed, nodes, similarity, shingle)
    label = components(linked)
    copies = made.join(nodes.select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_")), (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left_anti")
    copies = staged(copies.select(F.col("k1").alias("k1_"), F.col("k2").alias("k2_")).distinct(), "copies")
    once = keyed.select("k1", "k2", "text").join(within(copies), (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")), "left_anti")
    rest = left_out(once, nodes, label, similarity, shingle, min(block, LISTED))
    more = verified(rest.join(met, ["u", "v"], "left_anti"), keyed, nodes, similarity, shingle)
    if not more.isEmpty():
        label = components(linked.unionByName(more))
    release(met, nodes, copies, rest, linked, more)
    return made.join(label.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("k1", "k2", "doc_id", F.coalesce("label", "node").alias("label"))


#: Names that no column of a table of documents is expected to have.
KEY, GONE = ["_row_key_1", "_row_key_2"], ["_gone_key_1", "_gone_key_2"]
#: Row keys are broadcast up to so many (some 80 bytes each as a hash relation, so 40 MB); beyond that joins shuffle.
BROADCAST_KEYS = 500_000


def within(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, distance: int = PROBE_DISTANCE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near copies, that of the least id (null ids last).

    Rows are told apart by their whole content, so rows of one id with other texts are decided one by one, as are rows
    without an id; of rows that are equal in all columns one stays.
    """
    rows = staged(near_copies(docs, similarity, shingle, distance, block), "labelled")
    rank = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "k1", "k2")
    stay = rows.groupBy("label").agg(F.min(rank).alias("s")).select(F.col("label").alias("label_"), F.col("s.k1").alias("k1_"), F.col("s.k2").alias("k2_"))
    stay = staged(stay, "stay")  # so the join's sides are plain shuffles, of which Spark splits those of a large group
    judged = rows.join(stay, F.col("label") == F.col("label_")).withColumn("stays", (F.col("k1") == F.col("k1_")) & (F.col("k2") == F.col("k2_")))
    judged = staged(judged.groupBy("k1", "k2").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "judged")
    keyed = docs.select("*", *[k.alias(c) for k, c in zip(row_key(docs), KEY)])
    same_row = [F.col(c) == F.col(g) for c, g in zip(KEY, GONE)]
    named = lambda which: within(judged.where(which).select(*[F.col(k).alias(g) for k, g in zip(("k1", "k2"), GONE)]))
    left = keyed.join(named("not stays"), same_row, "left_anti")
    if not judged.where("stays").isEmpty():  # rows that are equal in all columns
        often = named("stays")
        left = left.join(often, same_row, "left_anti").unionByName(left.join(often, same_row, "left_semi").dropDuplicates(KEY))
    return left.select(*docs.columns)
