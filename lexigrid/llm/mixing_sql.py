"""The mix of single sources in SQL: shares in rounds, then the seeded prefix of each source."""

from __future__ import annotations

ROUNDS = 25  # each round stops a source at least, or changes nothing


def mixing_sql(seed: int = 7, most: int = 3) -> str:
    rounds = "".join(
        f"""
t{k} AS (SELECT *, CASE WHEN stop THEN CAST({most} * source_size AS DOUBLE) ELSE CAST(total - coalesce(sum({most} * source_size) FILTER (stop) OVER (), 0) AS DOUBLE) * w / sum(w) FILTER (NOT stop) OVER () END AS target FROM r{k}),
r{k + 1} AS (SELECT source, source_size, total, w, stop OR target > {most} * source_size AS stop FROM t{k}),"""
        for k in range(ROUNDS)
    )
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':{seed}'), 1, 13) AS BIGINT) AS draw
  FROM documents),
r0 AS (
  SELECT source, source_size, CAST(sum(source_size) OVER () AS BIGINT) AS total, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, false AS stop
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)),{rounds}
plan AS (SELECT source, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t{ROUNDS - 1}),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 1 END AS base, CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS rest FROM plan),
upto AS (
  SELECT s.doc_id, s.source, s.size, s.draw, p.source_size, p.target, p.base, p.rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN parts p ON p.source IS NOT DISTINCT FROM s.source),
marked AS (SELECT *, rest > 0 AND upto <= rest AS extra, rest - coalesce(max(upto) FILTER (rest > 0 AND upto <= rest) OVER (PARTITION BY source), 0) AS gap FROM upto),
fits AS (SELECT *, NOT extra AND gap > 0 AND abs(gap - size) < gap AS may FROM marked),
placed AS (SELECT *, may AND row_number() OVER (PARTITION BY source, may ORDER BY abs(gap - size), draw, doc_id, size) = 1 AS closes FROM fits)
SELECT doc_id, size, source_size, target, CAST(least(base + CASE WHEN extra OR closes THEN 1 ELSE 0 END, {most}) * size AS BIGINT) AS taken FROM placed
"""
