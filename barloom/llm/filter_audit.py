"""Filter interaction audit: what five filters take away in each of their 120 orders, per part of the corpus.

Duplicates are found by sorting: documents are dealt by ranges of text fingerprint and id, sorted inside a range by
fingerprint, whole text and id, and each row is compared with the one before it.  A group of copies may span many
ranges, so the first rows of a range are decided afterwards, from a table with one row per edge of a range.  What is
left of a document then is its mask of failed filters; masks are counted per part, and every figure of the report is a
sum of those counters, so counters of several corpora or shards may be added up before ``report``.

Null texts count as empty.  A document without an id is never a duplicate and makes none; ids that repeat with one text
are no duplicates of each other.  A null part is the empty part.  Several label rows of an id count as one that has
all their marks.  An empty table gives an empty report.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import staged

FILTERS = "ABCDE"
UPPER, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
ROWS = "doc_id long, part string, mask int, at int, open boolean, edge string, least long, text string"


def content_mask(text: str, raw: bytes) -> int:
    """Bits of the filters A to D that the text fails; ``bytes.split`` splits at just the contract's blanks."""
    words = raw.split()
    n, capitals = len(words), len(raw) - len(raw.translate(None, UPPER))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * len(text)) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of the rows of one range, in its order, and at the end its edges: text and least id of the first and the last run.

    A row is ``open`` if it stands in the first run and nothing in this range makes it a duplicate.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("at", pa.int32()), ("open", pa.bool_()), ("edge", pa.string()), ("least", pa.int64()), ("text", pa.string())])
    raw, least, runs, at, before, first = None, None, 0, None, 0, None
    for batch in batches:
        out = []
        for doc, part, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "text", "at"))):
            now = text.encode()
            if now != raw:
                first = least if runs == 1 else first
                raw, least, runs, before = now, None, runs + 1, content_mask(text, now)
                if runs == 1:
                    first_text = text
                last_text = text
            least = doc if least is None else least
            copied = doc is not None and least < doc
            out.append((doc, part, before | copied << 4, at, runs == 1 and doc is not None and not copied, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
    if runs:
        edges = [(None, None, None, at, False, "first", least if runs == 1 else first, first_text)]
        edges += [(None, None, None, at, False, "last", least, last_text)] if runs > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*edges), schema)], schema=schema)


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """``doc_id, part, mask``: a row per document, with the bits of the filters that it fails (A is 1, E is 16)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("print"))
    ranged = dealt.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id").withColumn("at", F.spark_partition_id())
    made = staged(ranged.select("doc_id", "part", "text", "at").mapInArrow(_compared, ROWS), "masks")
    edges = made.where("edge is not null").select("at", "edge", "text", "least")
    whole = edges.groupBy("text").agg(F.min("least").alias("overall"))  # of a run that spans ranges
    begins = edges.where("edge = 'first'").join(whole, "text").select(F.col("at").alias("_at"), "overall")
    rows = made.where("edge is null")
    late = rows.where("open").join(begins, F.col("at") == F.col("_at")).withColumn("mask", F.when(F.col("overall") < F.col("doc_id"), F.col("mask").bitwiseOR(16)).otherwise(F.col("mask")))
    return rows.where("not open").select("doc_id", "part", "mask").unionByName(late.select("doc_id", "part", "mask"))


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows a part.  Repeated ids are summed up before the join with the labels."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    same = failed.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return same.join(marks, F.col("doc_id") == F.col("_id"), "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("_good").alias("good"), of("_toxic").alias("toxic"))


def steps() -> F.Column:
    """All orders and their steps, as one constant array: the step's bit and the bits of the steps before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    made = [{"o": "".join(p), "s": i + 1, "b": bit[f], "e": sum(bit[x] for x in p[:i])} for p in permutations(FILTERS) for i, f in enumerate(p)]
    return F.from_json(F.lit(json.dumps(made)), "array<struct<o:string,s:int,b:int,e:int>>")


def report(counted: DataFrame) -> DataFrame:
    """A row per part, order and step, from counters that may be given in several pieces."""
    each = counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]).withColumn("x", F.explode(steps()))
    fails, earlier = F.col("mask").bitwiseAND(F.col("x.b")) != 0, F.col("mask").bitwiseAND(F.col("x.e")) != 0
    total = lambda size, when: F.sum(F.when(when, size).otherwise(0)).cast("long")
    here, n = fails & ~earlier, F.col("n")
    return each.groupBy("part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step")).agg(
        total(n, ~fails & ~earlier).alias("kept"),
        total(n, here).alias("removed"),
        total(n, fails & earlier).alias("redundant"),
        total(n, F.col("mask") == F.col("x.b")).alias("unique_fails"),
        total(F.col("good"), here).alias("good_lost"),
        total(F.col("toxic"), here).alias("toxic_lost"),
        total((n * 120 / F.bit_count("mask")).cast("long"), fails).alias("shapley"),  # a failing filter comes first in 120 / failures orders
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return report(counters(masks(docs, part), labels))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
m AS (
  SELECT doc_id, part,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask
  FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS step FROM o),
x AS (SELECT filter_order, step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS e FROM s)
SELECT part, filter_order, step::INT AS step,
       sum(CASE WHEN mask & (b | e) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & b <> 0 AND mask & e <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & b <> 0 AND mask & e = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & b <> 0 THEN n * 120 // bit_count(mask) ELSE 0 END)::BIGINT AS shapley
FROM c, x GROUP BY part, filter_order, step
"""
