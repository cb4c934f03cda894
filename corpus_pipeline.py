"""A training-data pipeline: toxicity, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.
Null, empty and very long texts, rows that repeat an id or have none, and columns beside those of
``documents`` pass through each stage as its operator says; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.llm import bpe, minhash, mixing, suffix, toxicity
from lexigrid.llm.common import DOCUMENT_COLUMNS, Workspace, held_out, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted toxic by a model of the labelled documents of the training folds."""
    body = docs.select(*DOCUMENT_COLUMNS, F.col("text").alias("body"))
    scored = toxicity.fit_and_score(body, table(spark, sf_dir, "labels"), ~held_out(), text_col="body", keep=DOCUMENT_COLUMNS[1:])
    return scored.where("predicted = 0").select(*DOCUMENT_COLUMNS)


def _row() -> Column:
    """Tells rows of differing id or text apart; equal rows are alike."""
    return F.xxhash64("doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group whose sets of five-word shingles are 80 % alike.

    Rows that repeat a doc_id are documents of their own, by their text (of two in one group, the
    smaller hash stays); of rows equal in id and text the one with the smallest other values stays. A
    null doc_id is beyond all others.
    """
    docs = docs.select(*DOCUMENT_COLUMNS).withColumn("row", _row())
    groups = minhash.near_duplicates(docs, width=5, percent=80, id_col="row").select("row", "component_id").distinct()
    ids = docs.select("doc_id", "row").distinct().join(groups, "row")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = ids.groupBy("component_id").agg(F.min(first).alias("first")).select(F.col("first.row").alias("row"))
    rest = ("lang", "source", "n_chars")
    one = docs.join(kept, "row", "left_semi").groupBy("row", "doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    return one.select("doc_id", "text", *(F.col(f"rest.{c}") for c in rest))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove strings of 200 bytes or more that occur elsewhere, with the whole of characters at their ends."""
    out = suffix.remove_repeats(docs.select(*DOCUMENT_COLUMNS), keep=("text", "lang", "source", "n_chars"), characters=True)
    cut = F.size("spans") > 0
    out = out.withColumn("text", F.when(cut, F.col("kept").cast("string")).otherwise(F.col("text"))).withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of its source asks for; rows equal in id and text as often as the one taken most."""
    docs = docs.select(*DOCUMENT_COLUMNS).withColumn("row", _row())
    taken = mixing.mix(docs, keep=("row",)).groupBy("row").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.join(taken, "row")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary: little-endian unsigned 32-bit) of each text, checked by decoding."""
    out = bpe.encode_decode(docs.select(*DOCUMENT_COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), keep_text=True)
    return out.select("doc_id", "lang", "source", "n_chars", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the classifier nor BPE can be said in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; of what came before, only the last stage's result is left there."""
    space = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():
            docs = space.put(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return docs
