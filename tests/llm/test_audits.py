"""The filter audit and the Merkle manifest against brute force in plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from barloom.llm import filter_audit, merkle
from barloom.llm.queries import fold
from tests.llm.conftest import SCHEMA, prose
from tests.llm.test_operators import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def many_ranges(spark):
    """Range partitions stay apart, so that runs of copies span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fails(text, doc, all_rows):
    words = WORD.findall(text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": doc is not None and any(o is not None and o < doc and (t or "") == text for o, t in all_rows),
    }


def brute_audit(rows, marks):
    """Every document goes through every order."""
    everything = [(r[0], r[1]) for r in rows]
    found = defaultdict(lambda: [0] * 6)
    shares = defaultdict(int)
    for doc, text, part in rows:
        bad = fails(text or "", doc, everything)
        good, toxic = marks.get(doc, (0, 0)) if doc is not None else (0, 0)
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                sums = found[part or "", "".join(order), step]
                if bad[f] and not gone:
                    shares[part or "", f] += 1
                sums[1] += bad[f] and not gone
                sums[2] += bad[f] and gone
                sums[3] += bad[f] and sum(bad.values()) == 1
                sums[4] += bool(good) and bad[f] and not gone
                sums[5] += bool(toxic) and bad[f] and not gone
                gone |= bad[f]
                sums[0] += not gone
    return [(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in found.items()]


def audited(docs, labels):
    return filter_audit.audit(docs, labels).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]


def test_audit_against_brute_force(spark, docs, clashing, none, many_ranges):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(0, 110, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    marks = defaultdict(lambda: (0, 0))
    for i, q, t in labels.collect():
        marks[i] = (max(marks[i][0], q == 1), max(marks[i][1], t == 1))
    got = audited(docs, labels)
    assert same(got, brute_audit(plain(docs), marks)) and len(got) == 3 * 600
    assert same(audited(clashing, labels), got)
    assert audited(none, labels) == []
    assert same(audited(docs, labels.limit(0)), brute_audit(plain(docs), {}))


def test_a_group_of_copies_over_many_ranges(spark, many_ranges):
    """A third of all rows are one text; some of its ids repeat, some are null, and some texts are empty."""
    rows = [(i % 700, "# copies " * 40, "en", "s", 1) for i in range(1400)] + [(None, "# copies " * 40, "en", "s", 1)] * 9
    rows += [(5000 + i, prose(i % 900, 120), "de", "s", 1) for i in range(1800)] + [(9000 + i, None if i % 2 else "", None, "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    failed = filter_audit.masks(docs)
    assert failed.count() == len(rows)
    copied = {(r["doc_id"], r["n"]) for r in failed.where("mask >= 16").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert copied == {(i, 2) for i in range(1, 700)} | {(5000 + i, 1) for i in range(900, 1800)} | {(9000 + i, 1) for i in range(1, 300)}


def test_counters_add_up(spark, docs):
    """Counters of two halves, with duplicates marked before, give the report of the whole."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    failed = filter_audit.masks(docs)
    halves = [filter_audit.counters(failed.where(f"coalesce(doc_id, 0) % 2 = {k}"), labels) for k in (0, 1)]
    assert same(filter_audit.report(halves[0].unionByName(halves[1])).collect(), filter_audit.report(filter_audit.counters(failed, labels)).collect())


# Merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """All levels, from the leaves to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in by[s]])
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            forged = r[4] if r[0] is None or r[4] is None or zlib.crc32(str(r[0]).encode()) % 5 else re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
            folded, proof = leaf_of((*r[:4], forged)), ""
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    left, right = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    folded, proof, at = H(left, folded, right), proof + left + right, at // 16
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], H(proof), folded, folded == top[-1][0]))
    return out


def manifest(docs, **sizes):
    return merkle.manifest(docs, fold(5) == 0, {"text": merkle.lowered(F.col("text"))}, **sizes).collect()


def fields(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_against_brute_force(docs, clashing, none):
    expected = brute_manifest(fields(docs))
    assert same(manifest(docs), expected)
    assert same(manifest(docs, block=3, fan=2), expected)  # runs are completed in merges of merges
    assert same(manifest(clashing), expected)
    assert manifest(none) == []


@pytest.mark.parametrize("block, fan", [(50, 3), (700, 16)])
def test_manifest_of_deep_trees(spark, block, fan):
    """A hot source of 4,500 leaves (four levels), 40 small sources of 1 to 20 (two levels over them), a lone leaf."""
    rows = [(i, f"Text {i} Ü", "en", "hot", i) for i in range(4500)] + [(10_000 + 100 * s + i, "Small", None, f"s{s:03d}", 5) for s in range(40) for i in range(1 + s % 20)] + [(99_999, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = manifest(docs, block=block, fan=fan)
    assert same(got, brute_manifest(fields(docs)))
    forged = {r["doc_id"] for r in got if not r["verified"]}
    assert forged == {r[0] for r in rows if r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_one_document(spark):
    docs = spark.createDataFrame([(1, "One", "en", "s", 3)], SCHEMA)
    (r,) = manifest(docs)
    assert r["leaf"] == r["subroot"] == r["root"] == leaf_of((1, "s", "en", 3, "One")) and r["proof_sha256"] == H() and r["verified"]


def test_forests_merge_in_any_grouping():
    """Merging is associative: blocks of one tree, grouped either way, end in one root."""
    leaves = {(0, 0, i): (700, H(str(i))) for i in range(700)}
    parts = [dict(list(leaves.items())[a : a + 90]) for a in range(0, 700, 90)]

    def merge(*forests):
        nodes = {k: v for f in forests for k, v in f.items()}
        merkle.complete(nodes, 1)
        return nodes

    parts = [merge(p) for p in parts]
    assert max(map(len, parts)) <= 2 * 15 * 3
    left = parts[0]
    for p in parts[1:]:
        left = merge(left, p)
    pairs = merge(*[merge(*parts[i : i + 2]) for i in range(0, len(parts), 2)])
    assert left == pairs == merge(*reversed(parts)) == {(merkle.TOP, 0, 0): (1, tree([H(str(i)) for i in range(700)])[-1][0])}
