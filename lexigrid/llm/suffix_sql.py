"""The removal of repeats in SQL: every string of ``length`` bytes is hashed and counted (texts with an id of their own)."""


def suffix_sql(length: int = 200) -> str:
    return rf"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
texts AS (SELECT doc_id, hx, CAST(len(hx) // 2 AS BIGINT) AS n_bytes FROM raw),
strings AS (SELECT doc_id, i, md5_number(substr(hx, 2 * i + 1, {2 * length})) AS h FROM texts, unnest(range(0, n_bytes - {length - 1})) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM strings) WHERE n > 1),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM again),
islands AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
runs AS (SELECT doc_id, k, min(i) AS a, max(i) + {length} AS z FROM islands GROUP BY ALL),
pieces AS (
  SELECT t.doc_id, 0 AS k, substr(hx, 1, 2 * coalesce(min(a), n_bytes)) AS part FROM texts t LEFT JOIN runs r ON r.doc_id = t.doc_id GROUP BY t.doc_id, hx, n_bytes
  UNION ALL
  SELECT doc_id, k, substr(hx, 2 * z + 1, 2 * (upto - z)) FROM (SELECT r.*, hx, coalesce(lead(a) OVER (PARTITION BY r.doc_id ORDER BY k), n_bytes) AS upto FROM runs r JOIN texts t ON t.doc_id = r.doc_id)),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY k) AS hx FROM pieces GROUP BY doc_id)
SELECT t.doc_id, t.n_bytes, CAST(t.n_bytes - len(k.hx) // 2 AS BIGINT) AS n_removed, (SELECT count(*) FROM runs r WHERE r.doc_id = t.doc_id) AS n_spans, sha256(unhex(k.hx)) AS kept_sha256
FROM texts t JOIN kept k ON k.doc_id = t.doc_id
"""
