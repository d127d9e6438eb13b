"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled rows (``sample_rows``) gives a vocabulary of ``vocabulary`` features (words, and shapes
of words, such as ``Xx,``), their inverse document frequencies, and a truncated SVD of ``dimensions``.  The labelled
vectors are broadcast (sample_rows x dimensions numbers); every document is projected, its cosines with all of them are
computed in blocks, and the nearest ``neighbours`` vote with their labels, weighted by similarity.

Null, empty and featureless texts get the mean label of the sample.  Without any labelled row every score is 1:
nothing speaks against a text.  Labels that disagree on one id count as their mean.  Repeated rows get equal scores.
Neighbours as near as the last one that votes (to six places) vote too, so their order doesn't matter.  Of labelled ids with
more than ``sample_rows`` rows in all, the rows least by a hash of id and text are taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEIGHBOURS = 21
#: Cosines that differ by no more count as equal.
TIED = 1e-6
THRESHOLD = 0.7
split = re.compile(r"[^\x20\x09-\x0D]+").findall
SHAPES = ((re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "XX"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


class Shapes(dict):
    """word -> its shape, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> str:
        shape = word[:64]
        for pattern, by in SHAPES:
            shape = pattern.sub(by, shape)
        if len(self) > 200_000:
            self.clear()
        self[word] = shape
        return shape


shapes = Shapes()


def features(text: str | None) -> Counter:
    words = Counter(split(text or ""))
    out: Counter = Counter()
    for w, n in words.items():
        out[w.lower()] += n
        out["\x00" + shapes[w]] += n
    if words:
        repeated = 1 - len(words) / sum(words.values())
        out[f"\x01{int(repeated * 10)}"] = 1
    return out


class Space:
    """Vocabulary, weights and axes; turns texts into unit vectors."""

    def __init__(self, names: list[str], weights: np.ndarray, axes: np.ndarray | None = None):
        self.at, self.weights, self.axes = {n: i for i, n in enumerate(names)}, weights, axes

    def sparse(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = [(i, n) for f, n in features(text).items() if (i := self.at.get(f)) is not None]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        rows, counts = np.array(found, dtype=np.int64).T
        values = (1 + np.log(counts)) * self.weights[rows]
        return rows, (values / np.linalg.norm(values)).astype(np.float32)

    def vectors(self, texts) -> np.ndarray:
        out = np.zeros((len(texts), self.axes.shape[1]), dtype=np.float32)
        for i, t in enumerate(texts):
            rows, values = self.sparse(t)
            out[i] = values @ self.axes[rows]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def axes_of(rows: list[tuple[np.ndarray, np.ndarray]], width: int, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of the sparse rows, by subspace iteration over dense blocks."""
    rng = np.random.default_rng(7)
    basis = np.linalg.qr(rng.standard_normal((width, min(dimensions + 8, width))))[0].astype(np.float32)
    for _ in range(5):
        total = np.zeros_like(basis)
        for at in range(0, len(rows), 256):
            block = np.zeros((len(rows[at : at + 256]), width), dtype=np.float32)
            for i, (r, v) in enumerate(rows[at : at + 256]):
                block[i, r] = v
            total += block.T @ (block @ basis)
        basis = np.linalg.qr(total)[0]
    return basis[:, :dimensions]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, vocabulary: int = 4096, dimensions: int = 64) -> dict | None:
    """The model from ``doc_id, text`` and labels ``doc_id, quality``; None without labelled rows."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(F.col("doc_id").alias("id_"), "quality")
    # the sample has at most sample_rows narrow rows, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id_")).select("doc_id", "text", "quality").persist()

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b["text"]:
                seen.update(features(t).keys())
            yield pd.DataFrame(seen.items(), columns=["name", "n"])

    total = sample.count()
    if total > sample_rows:  # ids that repeat: labels bound the ids, not the rows
        fewer = sample.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample_rows).repartition(8).persist()
        total = fewer.count()
        sample.unpersist()
        sample = fewer

    often = sample.select("text").mapInPandas(names, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(vocabulary).collect()
    if not often:
        sample.unpersist()
        return None
    space = Space([r["name"] for r in often], np.log((total + 1) / (np.array([r["n"] for r in often]) + 0.5)) + 0.1)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shared.value.sparse(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "at": [r.tolist() for r, _ in made], "x": [v.tolist() for _, v in made]})

    got = sample.mapInPandas(weighed, "doc_id long, quality double, at array<int>, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    sample.unpersist()
    rows = [(np.asarray(a, dtype=np.int64), np.asarray(x, dtype=np.float32)) for a, x in zip(got["at"], got["x"])]
    space.axes = axes_of(rows, len(often), min(dimensions, len(often)))
    known_vectors = np.array([v @ space.axes[r] for r, v in rows], dtype=np.float32)
    norm = np.linalg.norm(known_vectors, axis=1, keepdims=True)
    return {"space": space, "vectors": known_vectors / np.where(norm > 0, norm, 1), "labels": got["quality"].to_numpy(dtype=np.float32)}


def votes(model: dict, texts, block: int = 256) -> np.ndarray:
    """Scores of the texts: exact cosines in blocks, then a vote of the nearest, weighted by similarity."""
    vectors, near, y = model["space"].vectors(texts), model["vectors"], model["labels"]
    out, k = np.full(len(texts), float(y.mean())), min(NEIGHBOURS, len(y))
    for at in range(0, len(texts), block):
        cosines = vectors[at : at + block] @ near.T
        last = np.partition(cosines, len(y) - k, axis=1)[:, len(y) - k]
        row, best = np.nonzero(cosines >= last[:, None] - TIED)
        weight = np.clip(cosines[row, best], 0, 1).astype(np.float64) ** 4
        total = np.bincount(row, weight, len(cosines))
        out[at : at + block] = np.where(total > 0, np.bincount(row, weight * y[best], len(cosines)) / np.where(total > 0, total, 1), y.mean())
    return np.clip(out, 0.0, 1.0)


def scored(docs: DataFrame, model: dict | None, column: str = "score") -> DataFrame:
    """``docs`` with ``column``, the score of ``text``."""
    if model is None:
        return docs.withColumn(column, F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    vote = F.pandas_udf(lambda texts: pd.Series(votes(shared.value, texts.tolist())), "double")
    return docs.withColumn(column, vote("text"))


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, score, predicted`` for every row of ``doc_id, text``; other columns aren't carried."""
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
