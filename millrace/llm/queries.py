"""The operators of this subpackage over their whole tables, with production parameters, and the documents pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, fim, fingerprint, langid, linededup, pii, quality, simhash, suffixtree, toxicity, urlfilter, whitening
from millrace.llm.common import table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenized(table(spark, sf_dir, "documents"), vocabulary_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", linededup.worded_lines(F.col("text")).alias("n_lines"))
    return linededup.deduped(docs, removed="n_removed").select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_next(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spans``: offending offsets, ``start:end`` in code points, comma-joined."""
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.scored(table(spark, sf_dir, "documents"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = F.sha2(fim.restored(F.col("output"), F.col("form")), 256)
    made = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    return fim.transformed(docs).select(*made, F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


FIM_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), numbered AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS other,
    ('0x' || h[25:32])::BIGINT % 100 AS which
  FROM drawn
), cut AS (
  SELECT *,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') THEN 'plain'
      WHEN which < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(one, other)], '') AS prefix,
    array_to_string(units[least(one, other) + 1:greatest(one, other)], '') AS middle,
    array_to_string(units[greatest(one, other) + 1:], '') AS suffix
  FROM numbered
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM cut
"""


QUERIES: dict[str, tuple] = {
    "op1_decontamination": (op1_decontamination, None),
    "op2_bpe": (op2_bpe, None),
    "op3_line_dedup": (op3_line_dedup, None),
    "op4_simhash": (op4_simhash, None),
    "op5_pii": (op5_pii, None),
    "op6_url_filter": (op6_url_filter, None),
    "op7_language": (op7_language, None),
    "op8_fingerprints": (op8_fingerprints, None),
    "op9_quality": (op9_quality, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_whitening": (op11_whitening, None),
    "op12_suffix_tree": (op12_suffix_tree, None),
    "op13_fim": (op13_fim, FIM_SQL),
}
