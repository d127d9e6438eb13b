"""The registered queries of the training-data operators, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import filter_audit, language_id, media_mpeg, merkle, mixing, packing, pii, quality_knn, quality_rules, secrets, simhash_gph, substring_chain, token_files
from barloom.llm.shared import small_batches, staged, table
from barloom.llm.tokens import vocabulary


def fold(modulus: int, column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold(3) != 1))
    return language_id.predict(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality_knn.predict(docs, quality_knn.fit(docs, labels.where(fold(4) != 2)))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 200)
    return media_mpeg.digest(staged(media_mpeg.catalogued(media_mpeg.encode(table(spark, sf_dir, "documents"))), "media"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_chain.passages(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash_gph.near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return pii.digest(docs, pii.fit(docs))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), fold(5) == 0, {"text": merkle.lowered(F.col("text"))})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_source_mix": op2_source_mix,
    "op3_secret_scan": op3_secret_scan,
    "op4_pack": op4_pack,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_knn": op6_quality_knn,
    "op7_token_files": op7_token_files,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_passages": op9_passages,
    "op10_simhash": op10_simhash,
    "op11_filter_audit": op11_filter_audit,
    "op12_personal_data": op12_personal_data,
    "op13_merkle": op13_merkle,
}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w
  FROM s),
o AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w),
f AS (SELECT *, cap * open <= (total - caps) * w AS full_ FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN full_ THEN cap ELSE (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () END AS target
  FROM f),
r AS (
  SELECT doc_id, size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) END::BIGINT AS taken
FROM r
"""

RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l
  FROM documents),
v AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
g AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM v) WHERE c > 1),
p AS (SELECT rid, sum(step)::BIGINT AS n FROM (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8)) AS step FROM g) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(p.n, 0) AS n_repeat_words, len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: list_contains([STOPS], lower(x))))::BIGINT AS n_stop_words,
         len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper, len(regexp_extract_all(t, '\p{L}'))::BIGINT AS n_letters
  FROM d LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CASE WHEN base_failed THEN false ELSE RULES END AS kept, n_lines, n_stop_words, n_upper, n_letters
FROM b
"""


def rules_sql() -> str:
    both = [(r.measure, ">=", r.least) for r in quality_rules.RULES] + [(r.measure, "<=", r.most) for r in quality_rules.RULES]
    rules = " AND ".join(f"({m}) {op} {x}" for m, op, x in both if x is not None)
    return RULES_SQL.replace("STOPS", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)).replace("RULES", rules)


ORACLE: dict[str, str] = {"op2_source_mix": MIX_SQL, "op5_quality_rules": rules_sql(), "op11_filter_audit": filter_audit.SQL, "op13_merkle": merkle.sql()}
