"""The nearest other vectors in SQL, by all distances in double precision (components whose squares stay in range)."""

from __future__ import annotations


def nearest_sql(every: int = 100, k: int = 10) -> str:
    return f"""
WITH lists AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
good AS (
  SELECT vec_id, v, len(v) AS dim FROM lists
  WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x, CAST(0 AS DOUBLE))) AS score
  FROM good q JOIN good c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id AND c.dim = q.dim),
places AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM places WHERE rank <= {k}
"""
