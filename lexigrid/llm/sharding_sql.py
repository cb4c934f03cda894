"""Rendezvous shards of equal weights in SQL, and CRC-32 by a table of its 256 steps."""

from __future__ import annotations

from .sharding import BUCKET_ROWS


def sharding_sql(shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> str:
    return rf"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, {0xEDB88320}) ELSE x // 2 END, b)) AS crc_table),
raw AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes FROM documents),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(bytes, lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1]), {0xFFFFFFFF}), {0xFFFFFFFF}) AS BIGINT) AS text_crc32
  FROM raw, steps),
draws AS (
  SELECT r, k, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || k || ':{seed}'), 1, 13) AS BIGINT) AS draw
  FROM docs, range({shards + 1}) AS s(k)),
won AS (
  SELECT r, CAST(arg_max(k, draw) FILTER (k < {shards}) AS INTEGER) AS shard, CAST(arg_max(k, draw) AS INTEGER) AS grown_shard FROM draws GROUP BY r),
buckets AS (
  SELECT docs.*, shard, grown_shard, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32), 1, 13) AS BIGINT)
    % greatest(1, CAST(ceil((SELECT count(*) FROM docs) / {shards * bucket_rows}) AS BIGINT)) AS bucket
  FROM docs JOIN won USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot, grown_shard
FROM buckets
"""
