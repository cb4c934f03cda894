"""Exact duplicates: group by a 128-bit hash of the text, keep the smallest id, compare bytes inside groups.

Each row is reduced to its hash, a digest and its id; only these small rows are grouped and joined.
The bytes are compared where a hash occurs twice: texts are grouped by hash and text, which
collapses copies before they are shuffled, and a hash with more than one text is a collision, whose
rows are told apart by their texts from then on. Which hashes occur twice is broadcast up to
``REPEATED`` of them, so that no other text moves; beyond that all texts are grouped. Built-in functions
only.

A group of any size is a count and a least row for each task that meets it, and the join of rows with
their groups has a plain exchange on either side, so a hot group's rows can be split.

Texts are equal when they are identical after each run of white space is replaced by one space. A null
text counts as empty, and empty texts are equal to each other; very long ones are compared as a whole.
A null id comes after all others. Of rows that repeat an id in one group a single one stays, told by
a hash of all its columns; of rows equal in all columns, any one. An empty table gives an empty result.
Columns are read by name and renamed at once, so further ones may have any name; those named in
``keep`` come out as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Hashes that occur more than once, of 16 bytes each, that are broadcast: some 30 MB.
REPEATED = 500_000


def one_space(text: Column) -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def _texts(docs: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(one_space(F.col(text_col)).alias("t")).select(digest(F.col("t")).alias("h"), "t")


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], digest: Callable[[Column], Column]) -> DataFrame:
    """A row for each of ``docs``: h, t, sha, i, all (a hash of the row), k0, k1, ... (what is kept) and row (no two are alike)."""
    kept = [F.col(c).alias(f"k{k}") for k, c in enumerate(keep)]
    named = docs.select(F.col(id_col).alias("i"), one_space(F.col(text_col)).alias("t"), F.xxhash64(*docs.columns).alias("all"), *kept)
    return named.withColumns({"h": digest(F.col("t")), "sha": F.unhex(F.sha2("t", 256)), "row": F.monotonically_increasing_id()})


def collisions(texts: DataFrame) -> DataFrame:
    """(h) of the hashes that more than one text (t) has."""
    return texts.distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def duplicates(docs: DataFrame, *, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id (of the row that stays), group_size, kept, text_sha256, and the columns ``keep``."""
    space = Workspace(docs.sparkSession, "exact")
    rows = space.put(_rows(docs, id_col, text_col, keep, digest).withColumn("t", F.lit("")), "rows")
    sizes = rows.groupBy("h").agg(F.count("*").alias("n"))
    repeated = space.put(sizes.where("n > 1").select("h"), "repeated")
    texts = _texts(docs, text_col, digest)
    if repeated.count() <= REPEATED:
        texts = texts.join(F.broadcast(repeated), "h", "left_semi")
    collided = space.put(collisions(texts), "collided")
    if not collided.isEmpty():
        apart = _rows(docs, id_col, text_col, keep, digest).join(collided, "h", "left_semi")
        rows = space.put(rows.join(collided, "h", "left_anti").unionByName(apart), "told-apart")

    first = F.min(F.struct(F.col("i").isNull(), "i", "all", "row")).alias("first")
    # written, so that the join has a plain exchange on either side
    groups = space.put(rows.groupBy("h", "t").agg(F.count("*").alias("group_size"), first), "groups")
    out = rows.join(groups, ["h", "t"])
    stays = F.col("row") == F.col("first.row")
    kept = [F.col(f"k{k}").alias(c) for k, c in enumerate(keep)]
    return out.select(F.col("i").alias(id_col), F.col("first.i").alias("keep_id"), "group_size", stays.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *kept)
