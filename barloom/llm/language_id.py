"""Language identification: word-first backoff.

A known word scores by its log frequency in each language.  An unseen word falls back to the longest character
n-grams of it that the model knows, then to shorter ones.  Words are runs of letters (Unicode category L).  The word and
n-gram tables are counted by Spark over a bounded sample of labelled rows (``sample_rows``, dealt equally to the
languages), and cut to ``max_words`` and ``max_grams`` entries over all languages, so the broadcast model has a fixed
size whatever the corpus is.

Null or letterless text gives ``und`` with score 0.  No labelled row at all gives ``und`` everywhere.
Rows whose ``lang`` is null or whose ``doc_id`` is null train nothing; rows of equal id, text and language train once.
All languages are learned unless ``most_langs`` is set (then those of most distinct rows); the more there are, the fewer
words and n-grams each has, so that the model stays within ``max_cells`` numbers.  Words of one count that don't all fit are
taken by hash.  Repeated rows are scored one by one; ties between
languages go to the one first by code point.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONGEST = 5
runs_of = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters.  The pattern also takes numbers that are no decimal digits, such as fractions and Roman numerals; they are cut out."""
    found = runs_of(text)
    if not "".join(found).isalpha():
        found = [part for w in found for part in ("".join(c if c.isalpha() else " " for c in w).split())]
    return found


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(b["lang"], b["text"]):
            counts.setdefault(lang, Counter()).update(words_of(text.lower()))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "word", "n"])


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        counts: Counter = Counter()
        for lang, word, n in zip(b["lang"], b["word"], b["n"]):
            for k in range(1, LONGEST + 1):
                for g in grams_of(word, k):
                    counts[lang, k, g] += n
        yield pd.DataFrame([(*key, n) for key, n in counts.items()], columns=["lang", "k", "gram", "n"])


#: Items of one count are cut by hash at so many places.
CUTS = 4096


def most_frequent(counts: DataFrame, per: list[str], item: str, most: int) -> DataFrame:
    """The rows of each ``per`` group of greatest ``n``, up to ``most``; of those whose ``n`` is at the bound, the part that fits, by hash.

    Only the few levels of ``n`` and the hash ranges of one level are ordered, so the items of a group never meet in one task.
    """
    group = Window.partitionBy(*per)
    levels = counts.groupBy(*per, "n").agg(F.count(F.lit(1)).alias("_c"))
    levels = levels.withColumn("_upto", F.sum("_c").over(group.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.col("_upto") <= most
    bounds = levels.groupBy(*per).agg(F.min(F.when(fits, F.col("n"))).alias("_least"), F.max(F.when(~fits, F.col("n"))).alias("_edge"), F.coalesce(F.max(F.when(fits, F.col("_upto"))), F.lit(0)).alias("_above"))
    # one row per language and n-gram length
    dealt = counts.withColumn("_cut", F.pmod(F.xxhash64(item), F.lit(CUTS))).join(F.broadcast(bounds), per)
    edge = dealt.where("n = _edge").groupBy(*per, "_cut", "_above").agg(F.count(F.lit(1)).alias("_c"))
    edge = edge.withColumn("_upto", F.col("_above") + F.sum("_c").over(group.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)))
    last = edge.where(F.col("_upto") <= most).groupBy(*per).agg(F.max("_cut").alias("_last"))
    kept = dealt.join(F.broadcast(last), per, "left").where("n >= _least or n = _edge and _cut <= _last")
    return kept.select(*counts.columns)


def sampled(docs: DataFrame, langs: dict[str, int], sample_rows: int) -> DataFrame:
    """About ``sample_rows`` rows ``lang, text`` by hash, the same number for each language (all of a rarer one).

    ``langs`` has the number of distinct rows of each language.  Equal rows are one row, so the bound holds whatever repeats.
    """
    each = sample_rows / len(langs)
    share = F.create_map(*[F.lit(x) for lang, n in langs.items() for x in (lang, int(min(1.0, each / max(n, 1)) * (1 << 30)))])
    return docs.where(F.pmod("_h", F.lit(1 << 30)) <= share[F.col("lang")]).dropDuplicates(["lang", "_h"]).select("lang", "text")


def fit(docs: DataFrame, sample_rows: int = 20_000, max_words: int = 80_000, max_grams: int = 120_000, most_langs: int | None = None, max_cells: int = 8_000_000) -> dict:
    """The model from ``doc_id, text, lang``: languages, and one table of log-probability vectors for words and for each n-gram length."""
    docs = docs.select("text", "lang", F.xxhash64("doc_id", "text").alias("_h")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    per = docs.groupBy("lang").agg(F.approx_count_distinct("_h", 0.02).alias("n")).orderBy(F.desc("n"), "lang")
    per = (per.limit(most_langs) if most_langs else per).collect()
    langs = sorted(r["lang"] for r in per)
    if not langs:
        return {"langs": [], "tables": []}
    sample = sampled(docs.where(F.col("lang").isin(langs)) if most_langs else docs, {r["lang"]: r["n"] for r in per}, sample_rows)
    words = sample.select("lang", "text").mapInPandas(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    grams = words.mapInPandas(count_grams, "lang string, k int, gram string, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).persist()
    share = lambda most: min(most, max_cells // len(langs)) // len(langs)
    kept = most_frequent(words, ["lang"], "word", max(1, share(max_words))).select("lang", F.lit(0).alias("k"), F.col("word").alias("item"), "n")
    kept = kept.unionByName(most_frequent(grams, ["lang", "k"], "gram", max(1, share(max_grams) // LONGEST)).select("lang", "k", F.col("gram").alias("item"), "n"))
    found = kept.toPandas()
    words.unpersist(), grams.unpersist()
    tables = []
    for k in range(LONGEST + 1):
        part = found[found["k"] == k]
        grid = part.pivot(index="item", columns="lang", values="n").reindex(columns=langs).fillna(0.0)
        freq = grid.to_numpy(dtype="float64") + 0.2
        logs = np.log(freq / freq.sum(axis=0)) if len(grid) else np.zeros((0, len(langs)))
        tables.append(dict(zip(grid.index, map(tuple, (logs - logs.mean(axis=1, keepdims=True)).tolist()))))
    return {"langs": langs, "tables": tables}


class Scorer(dict):
    """word -> row of ``vectors``; a memo of at most ``most`` words and about ``cells`` numbers, filled as words come up."""

    def __init__(self, model: dict, most: int = 300_000, cells: int = 20_000_000):
        super().__init__()
        self.langs, self.tables = model["langs"], model["tables"]
        self.most = most = max(1000, min(most, cells // max(1, len(self.langs))))
        self.vectors = np.zeros((most, len(self.langs)), dtype="float32")

    def __missing__(self, word: str) -> int:
        row = len(self)
        self.vectors[row] = self.vector(word)
        self[word] = row
        return row

    def vector(self, word: str) -> tuple | list:
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for k in range(min(LONGEST, len(word) + 2), 0, -1):
            seen = [v for g in grams_of(word, k) if (v := self.tables[k].get(g)) is not None]
            if seen:
                return [sum(v) / len(seen) for v in zip(*seen)]
        return [0.0] * len(self.langs)

    def label(self, text: str | None) -> tuple[str, float]:
        words = words_of(text.lower()) if text else []
        if not words or not self.langs:
            return "und", 0.0
        total = np.zeros(len(self.langs))
        step = min(50_000, self.most)
        for at in range(0, len(words), step):
            part = words[at : at + step]
            if len(self) + len(part) > self.most:
                self.clear()
            total += self.vectors[[self[w] for w in part]].sum(axis=0, dtype="float64")
        odds = total * (min(len(words), 20) / len(words))  # evidence beyond twenty words only sharpens what they say
        odds = np.exp(odds - odds.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; other columns aren't carried."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.label(t) for t in texts], columns=["lang_pred", "score"])

    made = docs.select("doc_id", F.pandas_udf(score, "lang_pred string, score double", F.PandasUDFType.SCALAR_ITER)("text").alias("_p"))
    return made.select("doc_id", "_p.lang_pred", "_p.score")
