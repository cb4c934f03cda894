"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audit, bpe, exact, fingerprint, langid, minhash, mixing, pseudo, sharding, suffix, toxicity
from .ann_sql import nearest_sql
from .audit_sql import AUDIT_SQL
from .common import held_out, table
from .exact_sql import EXACT_SQL
from .mixing_sql import mixing_sql
from .sharding_sql import sharding_sql
from .suffix_sql import suffix_sql


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    return toxicity.fit_and_score(docs, table(spark, sf_dir, "labels"), ~held_out(), keep=("held_out",))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_min_cost_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    # only the id and the text reach the prediction
    langs, model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), langs, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.neighbours(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "common_edited",
        "common_next",
    )


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo.fit_and_score(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_min_cost_mixing": op3_min_cost_mixing,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op5_mixture_language_id": op5_mixture_language_id,
    "op6_backtracking_bpe": op6_backtracking_bpe,
    "op7_prefix_fingerprints": op7_prefix_fingerprints,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_additive_quantisation": op9_additive_quantisation,
    "op10_masked_pseudo_likelihood": op10_masked_pseudo_likelihood,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
}

ORACLE_SQL = {
    "op3_min_cost_mixing": mixing_sql(),
    "op4_rendezvous_sharding": sharding_sql(16),
    "op8_suffix_array_dedup": suffix_sql(),
    "op9_additive_quantisation": nearest_sql(),
    "op11_exact_dedup": EXACT_SQL,
    "op12_filter_interaction_audit": AUDIT_SQL,
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
    WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * n >= 80 * (p.n_shingles + q.n_shingles - n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION
  SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.node WHERE r.low < b.y),
lowest AS (SELECT node, min(low) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n_shingles, component_id, component_id = doc_id AS kept FROM sizes JOIN lowest ON node = doc_id
""",
}
