"""Weighted rendezvous hashing of stable record keys.

Each record draws a number for every shard from a hash of its key and the shard alone; with
weights w the shard of least -ln(u) / w wins, so shard k gets a share of records in proportion to
its weight. A new shard wins some records and no other record moves; a removed one's records fall
to their second choices.

Slots number a shard's records without gaps. They come from counts of small buckets of a shard
(by a hash of the record) and row numbers within a bucket, so that no task sees a whole shard.

Law ``key``: the key and the shard count decide. Null keys share a shard. Rows that repeat a key
go to the same shard and get slots of their own; equal rows are interchangeable. Equal costs fall to the
lower shard. Null and empty texts have size 1, very long ones count as others do. An empty table gives
an empty result. No column but the id and the text is read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: Records of a bucket that a slot window is planned for.
BUCKET_ROWS = 20_000


def digest(text: Column) -> Column:
    """The first 52 bits of md5, which SQL has too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _cost(key: Column, shard: int, weight: float, seed: int) -> Column:
    """(cost, shard): what the shard asks for ``key``."""
    u = (digest(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}:{seed}"))).cast("double") + 0.5) / float(1 << 52)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """(cost, shard) of the shard, from 0, that wins ``key`` (an expression of built-in functions)."""
    return F.array_min(F.array(*(_cost(key, k, w, seed) for k, w in enumerate(weights))))


def assign(docs: DataFrame, shards: int, *, weights: Sequence[float] | None = None, added: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard): size is UTF-8 bytes plus 1, grown_shard the shard with one more of weight ``added``."""
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("a positive weight for each shard is needed")
    space = Workspace(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"))
    # with one more shard, the winner stays or the new one wins
    rows = rows.withColumn("won", rendezvous(F.col("i"), weights, seed)).withColumn("grown", F.least("won", _cost(F.col("i"), shards, added, seed))["shard"])
    rows = space.put(rows.withColumn("shard", F.col("won.shard")).drop("won"), "rows")
    buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS)))
    record = F.concat_ws(":", F.coalesce(F.col("i").cast("string"), F.lit("")), "size", "crc")
    rows = rows.withColumn("bucket", F.pmod(digest(record), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "bucket", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("i", "size", "crc")) - 1
    out = rows.withColumn("place", place).join(starts, ["shard", "bucket"])
    return out.select(F.col("i").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"), F.col("grown").alias("grown_shard"))
