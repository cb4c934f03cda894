import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import sharding
from lexigrid.llm.common import table
from lexigrid.llm.queries import ORACLE_SQL, op4_rendezvous_sharding
from lexigrid.llm.sharding_sql import sharding_sql
from tests.conftest import SF


def winner(key, weights, seed=0):
    """The shard of least cost, from the hash of the record's key, the shard and the seed, one after another."""

    def cost(k):
        h = int(hashlib.md5(f"{key}:{k}:{seed}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / 2**52) / weights[k], k

    return min(map(cost, range(len(weights))))[1]


def test_shards_against_a_plain_version(spark):
    rows = op4_rendezvous_sharding(spark, SF).collect()
    assert all((r.shard, r.grown_shard) == (winner(r.doc_id, [1.0] * 16), winner(r.doc_id, [1.0] * 17)) for r in rows)
    rows = sharding.assign(spark.range(500).selectExpr("id as doc_id", "'t' as text"), 3, weights=[1, 2, 5], added=2, seed=9).collect()
    assert all((r.shard, r.grown_shard) == (winner(r.doc_id, [1, 2, 5], 9), winner(r.doc_id, [1, 2, 5, 2], 9)) for r in rows)


def test_query(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op4_rendezvous_sharding(spark, SF).collect()
    slots = defaultdict(list)
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _rows(df):
    return sorted((tuple(r) for r in df), key=str)


def test_query_against_sql(spark, monkeypatch):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert _rows(op4_rendezvous_sharding(spark, SF).collect()) == _rows(con.sql(ORACLE_SQL["op4_rendezvous_sharding"]).fetchall())
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    assert _rows(op4_rendezvous_sharding(spark, SF).collect()) == _rows(con.sql(sharding_sql(16, bucket_rows=4)).fetchall())


def test_odd_documents_against_sql(spark, odd):
    con = duckdb.connect()
    documents = odd.select("doc_id", "text").toPandas()  # noqa: F841  DuckDB reads it by name
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    got = sharding.assign(odd, 16).select("doc_id", "size", "text_crc32", F.lit("key"), "shard", "slot", "grown_shard")
    assert _rows(got.collect()) == _rows(con.sql(sharding_sql(16)).fetchall())


def test_weights_and_growth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("x"))
    rows = sharding.assign(ids, 3, weights=[1, 2, 5], added=2).cache()
    share = {r.shard: r["count"] / 20_000 for r in rows.groupBy("shard").count().collect()}
    assert share == pytest.approx({0: 1 / 8, 1: 2 / 8, 2: 5 / 8}, abs=0.02)
    moved = rows.where("grown_shard <> shard")
    assert moved.where("grown_shard <> 3").isEmpty()
    assert moved.count() / 20_000 == pytest.approx(0.2, abs=0.02)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = sharding.assign(spark.range(3000).selectExpr("id as doc_id", "'t' as text"), 4).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_odd_documents(odd):
    rows = sharding.assign(odd, 4).collect()
    assert len(rows) == 15
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({r.shard for r in rows if r.doc_id == 8}) == 1
    assert {r.size for r in rows if r.doc_id in (4, 5)} == {1}
    assert {r.text_crc32 for r in rows if r.doc_id in (4, 5)} == {0}
    assert max(Counter((r.shard, r.slot) for r in rows).values()) == 1


def test_empty_table(none):
    assert sharding.assign(none, 4).isEmpty()


def test_bad_weights(odd):
    with pytest.raises(ValueError, match="weight"):
        sharding.assign(odd, 2, weights=[1, 0])
