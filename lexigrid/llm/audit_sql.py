"""Interaction of filters in SQL."""

AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS least FROM texts),
masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN least IS NOT NULL AND (doc_id IS NULL OR doc_id > least) THEN 16 ELSE 0 END AS mask
  FROM firsts),
said AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
counters AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(string_split('A,B,C,D,E', ',')) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS o FROM letters a, letters b, letters d, letters e, letters f
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5),
steps AS (
  SELECT o, k, 1 << (instr('ABCDE', o[k]) - 1) AS own,
    coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (instr('ABCDE', o[j]) - 1))), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS s(k))
SELECT part, o AS filter_order, k::INTEGER AS step,
  coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM counters, steps GROUP BY part, o, k
"""
