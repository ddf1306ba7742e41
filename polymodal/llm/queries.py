"""The queries opN_<name> over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, language, licenses, lm_scoring, mixing, packing, simhash, token_files
from ._base import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(spark, *token_files.write_token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_with_own_labels(documents(spark, sf_dir))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.concat_ws(",", F.transform("mask_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("mask_spans", spans)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(documents(spark, sf_dir))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lm_scoring.cross_entropy_difference(documents(spark, sf_dir), labels.where("quality = 1 and toxic = 0").select("doc_id"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_ann, op2_license_scan, op3_mixing, op4_exact_dedup, op5_packing, op6_token_files, op7_language_id, op8_chat, op9_simhash, op10_lm_scoring, pipeline)
    return {f.__name__: f for f in own}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         coalesce(len(regexp_extract_all(text, '[#$%&*|<>{{}}=!]')), 0) AS symbols FROM documents
), k AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':0'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {1 << 48}.0::DOUBLE)
            / (1.0::DOUBLE / (1.0::DOUBLE + symbols / greatest(size, 1)::DOUBLE)) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM l WHERE ratio > level) * w, 2.0::DOUBLE * source_size)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(floor(e.target - e.epochs * e.source_size) AS BIGINT) AS rest,
         CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size) AS BIGINT) AS upto, count(*) OVER (PARTITION BY k.source, k.key, k.doc_id, k.size) AS n
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - n * size < rest THEN (rest - (upto - n * size)) // n ELSE 0 END AS BIGINT) AS taken FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": _MIX_SQL,
        "op4_exact_dedup": f"""
WITH f AS (SELECT doc_id, {_FOLD} AS folded FROM documents), g AS (
  SELECT doc_id, sha256(folded) AS text_sha256, max(doc_id) OVER (PARTITION BY folded) AS keep_id, count(*) OVER (PARTITION BY folded) AS group_size FROM f)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g""",
        "op8_chat": chat.ROTATE_SQL,
    }
