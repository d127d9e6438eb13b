"""The corpus pipeline: quality classifier, near-duplicate removal, secret redaction, source mix, packing.

Each stage takes and returns the columns of ``documents``; the last one returns the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import mixing, packing, quality_knn, secrets, simhash_gph
from barloom.llm.queries import fold
from barloom.llm.shared import small_batches, staged, table
from barloom.llm.tokens import vocabulary

#: Pieces of text whose token ids a worker remembers: it still holds what the stages before remember.
REMEMBERED = 200_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    small_batches(spark)
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels").where(fold(4) != 2))
    return quality_knn.scored(docs, model, "_score").where(F.col("_score") >= quality_knn.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, cosine of 0.8 or more) the document of the least id stays."""
    small_batches(spark)
    return simhash_gph.deduplicated(docs).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    small_batches(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), ids=True, remembered=REMEMBERED)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Neither the classifier nor the token ids can be had in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
