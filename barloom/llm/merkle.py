"""Merkle dataset manifest: a digest per document, a tree per source, a tree over the sources, and a proof per document.

The tree is built as a sparse forest.  Leaves are numbered inside their source and dealt into blocks of consecutive
leaves.  A block's forest holds nodes by tree, level and index; the arity of every run of siblings is known from the
number of leaves, so wherever a run is complete its nodes give way to their parent, and a complete tree to a leaf of the
tree above it.  What can't be completed in the block stays: some thirty nodes a level at most.  Merging two forests is
union and completion, which is associative; neighbouring forests are merged in rounds until one node, the root, is left.

Completed runs are rows of a table with the digests of their nodes.  Proofs come from it top down, one join a level:
a node's way to the root is its own siblings and its parent's way.

Leaves ascend by id (null first), equal ids by leaf digest.  Null fields count as ``-``, so a null text and an empty one
differ.  Repeated rows are leaves of their own.  A document without an id is not tampered with.  An empty table has no
leaves and gives no rows.  Other columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import running_total, staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 16
#: Leaves of a block, and forests that one merge takes.
BLOCK, FAN = 4_000, 16
#: The tree over the sources.
TOP = -1
FOREST = "kind string, block long, tree long, level int, idx long, n long, digest string, kids array<string>"
SCHEMA = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("kids", pa.list_(pa.string()))])


def leaf_digest(fields: dict[str, Column] | None = None) -> Column:
    """The leaf of a row; ``fields`` replaces columns."""
    values = [(fields or {}).get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def complete(nodes: dict[tuple[int, int, int], tuple[int, str]], trees: int) -> list[tuple]:
    """Replaces every complete run in ``nodes`` by its parent, again and again; the completed runs and trees.

    ``nodes``: (tree, level, index) to the number of the tree's leaves and the digest.
    """
    made, todo = [], {(t, level, i // ARITY) for t, level, i in nodes}
    while todo:
        tree, level, run = todo.pop()
        first = run * ARITY
        n = next((nodes[k][0] for i in range(first, first + ARITY) if (k := (tree, level, i)) in nodes), 0)
        width = -(-n // ARITY**level)
        if width == 1:
            if tree == TOP:
                continue
            n, digest = nodes.pop((tree, level, 0))
            made.append(("tree", tree, level, 0, n, digest, None))
            nodes[TOP, 0, tree] = (trees, digest)
            todo.add((TOP, 0, tree // ARITY))
            continue
        keys = [(tree, level, i) for i in range(first, min(first + ARITY, width))]
        if not keys or any(k not in nodes for k in keys):
            continue
        kids = [nodes.pop(k)[1] for k in keys]
        digest = joined(kids)
        made.append(("run", tree, level + 1, run, n, digest, kids))
        nodes[tree, level + 1, run] = (n, digest)
        todo.add((tree, level + 1, run // ARITY))
    return made


def merged(trees: int):
    """The merge as a function of grouped Arrow tables: open nodes in; completed runs and what stays open out."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        nodes = {(t, level, i): (n, digest) for t, level, i, n, digest in zip(*(table.column(c).to_pylist() for c in ("tree", "level", "idx", "n", "digest")))}
        made = complete(nodes, trees)
        rows = [(kind, block, *x) for kind, *x in made] + [("open", block, *k, *v, None) for k, v in nodes.items()]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return run


def numbered(docs: DataFrame, tampered: Column, changed: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Leaves with their place in all of them (``g``), and the sources: number of leaves, first place, rank."""
    leaves = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(tampered, leaf_digest(changed)).alias("forged"), F.lit(1).alias("one"), F.lit(0).alias("all"))
    placed = staged(running_total(leaves, "all", "one", "g", ["source", "doc_id", "leaf"]).drop("one", "all"), "leaves")
    sources = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("begin")).withColumns({"one": F.lit(1), "all": F.lit(0)})
    return placed, staged(running_total(sources, "all", "one", "tree", ["source"]).drop("one", "all"), "sources")


def forest(leaves: DataFrame, trees: int, leaf_count: int, block: int, fan: int) -> tuple[DataFrame, str]:
    """The completed runs and trees of ``tree, idx, n, digest, g``, and the root."""
    done, opened = [], leaves.select(F.floor(F.col("g") / block).alias("block"), "tree", F.lit(0).alias("level"), "idx", "n", "digest")
    blocks = -(-leaf_count // block)
    while True:
        step = staged(opened.groupBy("block").applyInArrow(merged(trees), FOREST), "forest")
        done.append(step)
        if blocks == 1:
            break
        blocks = -(-blocks // fan)
        opened = step.where("kind = 'open'").select(F.floor(F.col("block") / fan).alias("block"), "tree", "level", "idx", "n", "digest")
    (root,) = done[-1].where("kind = 'open'").collect()  # one row
    runs = done[0]
    for step in done[1:]:
        runs = runs.unionByName(step)
    return runs.where("kind <> 'open'"), root["digest"]


def depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return sum((n > ARITY**k).cast("int") for k in range(15))


def siblings(at: Column) -> Column:
    """The run's other nodes, left and right of the one at place ``at``."""
    return F.struct(F.concat_ws("", F.slice("kids", F.lit(1), at)).alias("left"), F.concat_ws("", F.slice("kids", at + 2, F.lit(ARITY))).alias("right"))


def first_ways(top: DataFrame) -> DataFrame:
    """The ways of the root's children, from the root's run."""
    met = top.select("tree", F.posexplode("kids").alias("at", "_kid"), "kids")
    return met.select("tree", F.col("at").cast("long").alias("idx"), F.lit(None).cast("string").alias("subroot"), F.array(siblings(F.col("at"))).alias("way"))


def children(ways: DataFrame, runs: DataFrame) -> DataFrame:
    """The ways of the nodes one level below those of ``ways`` (``tree, idx, subroot, way``)."""
    below = runs.select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), "kids")
    met = ways.join(below, (F.col("tree") == F.col("_t")) & (F.col("idx") == F.col("_i"))).select("tree", "idx", "subroot", "way", "kids", F.posexplode("kids").alias("at", "_kid"))
    return met.select("tree", (F.col("idx") * ARITY + F.col("at")).alias("idx"), "subroot", F.concat(F.array(siblings(F.col("at"))), F.col("way")).alias("way"))


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: a row per document.

    Rows for which ``tampered`` holds are checked with the columns in ``changed`` in place of their own.
    """
    placed, sources = numbered(docs.select(*FIELDS), tampered, changed)
    counts = sources.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    trees, total, largest = counts[0], counts[1] or 0, counts[2] or 0
    if not total:
        return placed.select("doc_id", "leaf", *[F.lit(None).cast("string").alias(c) for c in ("subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    own = sources.select(F.col("source").alias("_s"), "tree", "n", "begin")
    leaves = placed.join(own, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "leaf", "forged", "tree", "n", (F.col("g") - F.col("begin")).alias("idx"), "g")
    runs, root = forest(leaves.withColumnRenamed("leaf", "digest"), trees, total, block, fan)

    levels = lambda n: next(k for k in range(99) if ARITY**k >= n)
    of_top = lambda level: runs.where(f"kind = 'run' and tree = {TOP} and level = {level}")
    if levels(trees):
        ways = first_ways(of_top(levels(trees)))
    else:  # the only source
        no_way = F.array().cast("array<struct<left:string,right:string>>")
        ways = sources.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(None).cast("string").alias("subroot"), no_way.alias("way"))
    for level in range(levels(trees) - 1, 0, -1):
        ways = children(ways, of_top(level))
    subroots = runs.where("kind = 'tree'").select(F.col("tree").alias("_t"), F.col("n"), F.col("digest"))
    tops = staged(ways.join(subroots, F.col("idx") == F.col("_t")).select(F.col("_t").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "way", depth(F.col("n")).alias("depth")), "tops")

    at = lambda level: tops.where(F.col("depth") == level).drop("depth")
    of = lambda level: runs.where(f"kind = 'run' and tree <> {TOP} and level = {level}")
    ways = at(levels(largest))
    for level in range(levels(largest), 1, -1):
        ways = children(ways, of(level)).unionByName(at(level - 1))
    several, single = leaves.where("n > 1"), leaves.where("n = 1")
    lone = single.join(at(0).select(F.col("tree").alias("_t"), "subroot", "way"), F.col("tree") == F.col("_t"))
    found = lone.select("doc_id", "leaf", "forged", "subroot", "way")
    if levels(largest):
        lowest = of(1).select(F.col("tree").alias("_t"), F.col("idx").alias("_i"), "kids")
        above = lowest.join(ways.withColumnsRenamed({"tree": "_wt", "idx": "_wi"}), (F.col("_t") == F.col("_wt")) & (F.col("_i") == F.col("_wi"))).drop("_wt", "_wi")
        met = several.withColumns({"run": F.floor(F.col("idx") / ARITY), "at": (F.col("idx") % ARITY).cast("int")}).join(above, (F.col("tree") == F.col("_t")) & (F.col("run") == F.col("_i")))
        found = found.unionByName(met.select("doc_id", "leaf", "forged", "subroot", F.concat(F.array(siblings(F.col("at"))), F.col("way")).alias("way")))
    proof = F.sha2(F.concat_ws("", F.transform("way", lambda x: F.concat(x["left"], x["right"]))), 256)
    folded = F.aggregate("way", F.coalesce("forged", "leaf"), lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
    return found.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def sql(levels: int = 6, top: int = 3) -> str:
    """The manifest in SQL for at most 16 ** levels leaves a source and 16 ** top sources."""
    value = lambda c, e: f"coalesce(strlen({e})::VARCHAR || ':' || {e}, '-')"
    leaf = lambda text: f"sha256({' || '.join(value(c, text if c == 'text' else f'{c}::VARCHAR') for c in FIELDS)})"
    byte = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, x: {byte}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS forged, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, source FROM documents)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d)",
        "a0 AS (SELECT t, i, n, leaf AS h FROM p)",
    ]
    for k in range(levels):
        ctes.append(f"a{k + 1} AS (SELECT t, i // 16 AS i, (any_value(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS kids FROM a{k} WHERE n > 1 GROUP BY t, i // 16)")
    ends = " UNION ALL ".join(f"SELECT t, h FROM a{k} WHERE n = 1" for k in range(levels + 1))
    ctes += [f"r AS ({ends})", "b0 AS (SELECT t AS i, (SELECT count(*) FROM r) AS n, h FROM r)"]
    for k in range(top):
        ctes.append(f"b{k + 1} AS (SELECT i // 16 AS i, (any_value(n) + 15) // 16 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS kids FROM b{k} WHERE n > 1 GROUP BY i // 16)")
    ctes.append(f"root AS ({' UNION ALL '.join(f'SELECT h FROM b{k} WHERE n = 1' for k in range(top + 1))})")
    way = "q0 AS (SELECT p.doc_id, p.leaf, r.h AS subroot, p.t, p.i, coalesce(p.forged, p.leaf) AS f, '' AS proof FROM p JOIN r ON p.t = r.t)"
    ctes.append(way)
    steps = [(f"a{k + 1}", "q.t = x.t AND q.i // 16 = x.i", "q.i // 16") for k in range(levels)] + [("", "", "q.t")] + [(f"b{k + 1}", "q.i // 16 = x.i", "q.i // 16") for k in range(top)]
    for k, (table, on, i) in enumerate(steps):
        if not table:
            ctes.append(f"q{k + 1} AS (SELECT doc_id, leaf, subroot, t, t AS i, f, proof FROM q{k})")
            continue
        left, right = "array_to_string(x.kids[1:q.i % 16], '')", "array_to_string(x.kids[q.i % 16 + 2:], '')"
        ctes.append(f"q{k + 1} AS (SELECT doc_id, leaf, subroot, q.t, {i} AS i, CASE WHEN x.h IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, CASE WHEN x.h IS NULL THEN proof ELSE proof || {left} || {right} END AS proof FROM q{k} q LEFT JOIN {table} x ON {on})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM q{len(steps)}, root"
