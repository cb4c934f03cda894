"""The jobs as queries over the given tables, with the same in SQL.

A query runs its job twice into a new folder of the cluster's shared one, and returns the whole output as
it stands after the second run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.operators.counts import POSITIONS
from lexigrid.plans import oracle as O
from lexigrid.sources.shared import new_folder

from . import page_feed, publish_groups


def job1_page_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job1")
    for _ in range(2):
        page_feed.run(spark, f"{sf_dir}/documents.parquet", f"{at}/out", f"{at}/checkpoint")
    rows = page_feed.read(spark, f"{at}/out")
    return rows.withColumn("share", F.round("share", 6))


def job2_publish_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = new_folder(spark, "job2")
    for _ in range(2):
        publish_groups.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at)
    rows = publish_groups.read(spark, at)
    return rows.withColumn("share", F.round("share", 6))


QUERIES = {"job1_page_feed": job1_page_feed, "job2_publish_groups": job2_publish_groups}


def _published(key: str, pages: str, *ctes: str) -> str:
    """Rows of (key, kind, item, n, share) from grams, moves and places, which are keyed alike."""
    places = " UNION ALL ".join(f"""SELECT {key}, '{p}' AS kind, glyph AS item, "{p}" AS n, round("{p}" / total, 6) AS share FROM places""" for p in POSITIONS)
    return (
        "WITH "
        + ",".join(ctes)
        + f"""
SELECT {key}, 'ngram' AS kind, ngram AS item, cnt AS n, round(cnt / total, 6) AS share
FROM (SELECT *, sum(cnt) OVER (PARTITION BY {key}, n) AS total FROM counted) WHERE cnt >= 5
UNION ALL SELECT {key}, 'transition', from_tok || '|' || to_tok, n, round(n / sum(n) OVER (PARTITION BY {key}, from_tok), 6) FROM moves
UNION ALL {places}
UNION ALL {pages}"""
    )


_PLACES = ", ".join(f'CAST(sum("{p}") AS BIGINT) AS "{p}"' for p in (*POSITIONS, "total"))
_SUM = "CAST(sum({}) AS BIGINT) AS {}"


def _matches(where: dict) -> str:
    tests = [f"ascii(quire) - 64 = {v}" if k == "quire" and isinstance(v, int) else f"{k} = '{v}'" for k, v in where.items()]
    return " AND ".join(tests) or "true"


_GROUPS = publish_groups.settings()["groups"]
_MEMBERS = f"""
said AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
attributed AS (
  SELECT d.doc_id AS folio, coalesce(lang, '') AS language, coalesce(source, '') AS hand, chr(CAST(d.doc_id % 20 + 65 AS INTEGER)) AS quire,
    coalesce('q' || quality || 't' || toxic, '') AS illustration
  FROM documents d LEFT JOIN said USING (doc_id)),
members AS (SELECT folio, unnest(list_filter([{", ".join(f"CASE WHEN {_matches(g.get('where', {}))} THEN '{g['name']}' END" for g in _GROUPS)}], lambda x: x IS NOT NULL)) AS agg FROM attributed),
defs AS (SELECT * FROM (VALUES {", ".join(f"('{g['name']}', '{g['description']}')" for g in _GROUPS)}) AS v(agg, description))"""
_BY_FOLIO = O._grams("[1, 2, 3]", "folio").replace("SELECT folio, folio,", "SELECT folio,")
_GROUPED = f"""
counted AS (SELECT agg, ngram, n, {_SUM.format("cnt", "cnt")} FROM grams JOIN members USING (folio) GROUP BY ALL),
moves AS (SELECT agg, from_tok, to_tok, {_SUM.format("n", "n")} FROM trans JOIN members USING (folio) GROUP BY ALL),
places AS (SELECT agg, glyph, {_PLACES} FROM wp JOIN members USING (folio) GROUP BY ALL)"""
_LANGUAGES = f"""
counted AS (SELECT language, ngram, n, cnt FROM grams),
moves AS (SELECT * FROM bylang),
places AS (SELECT language, glyph, {_PLACES} FROM wp GROUP BY ALL)"""

ORACLE_SQL = {
    "job1_page_feed": _published("language", "SELECT language, 'pages', '', count(*), NULL FROM src GROUP BY ALL", O.BASE, O.G123, O.TRANS, O.AT, O._positions("language"), _LANGUAGES),
    "job2_publish_groups": _published(
        "agg",
        """SELECT agg, 'pages', description, count(folio), NULL FROM defs LEFT JOIN members USING (agg) GROUP BY ALL
UNION ALL SELECT agg, 'glyphs', description, CAST(coalesce(sum(total), 0) AS BIGINT), NULL FROM defs LEFT JOIN places USING (agg) GROUP BY ALL""",
        O.BASE, _MEMBERS, _BY_FOLIO, O.TRANS, O.AT, O._positions("folio"), _GROUPED,
    ),
}
