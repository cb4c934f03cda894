"""SQL of ``further_queries``."""

from __future__ import annotations

from ..functions.profiles import EVA_DISTINCT
from ..operators import groups as R
from . import oracle as O
from .more_oracle import _JOINED, LDENSE, LINES, LPROF
from .oracle import AT, BASE, BOXES, G1, MEMBERS, NM, PAGES, PG, PLACED, PM, PROFILE, SM, TM, TRANS, _q, add

_glyph = f"from_tok NOT IN {O._border} AND to_tok NOT IN {O._border}"
for _name in ("profiles_nested_and_back", "profiles_merged"):
    add(_name, "SELECT * FROM prof", BASE, AT, PROFILE)
_wide = ", ".join(f"CAST(coalesce(sum(n) FILTER (to_tok = '{c}'), 0) AS BIGINT) AS to_{k}" for k, c in enumerate(EVA_DISTINCT.order))
add("markov_matrix_wide", f"SELECT language, from_tok, {_wide} FROM bylang WHERE {_glyph} GROUP BY ALL", BASE, TRANS)
add("markov_matrix_wide_and_back", f"SELECT * FROM bylang WHERE {_glyph}", BASE, TRANS)
add("groups_written_and_read", f"SELECT agg, from_tok, to_tok, CAST(sum(n) AS BIGINT) AS n FROM trans {_JOINED}", BASE, TRANS, PAGES, MEMBERS)
add("pages_written_and_read", "SELECT p.folio, quire, illustration, language, hand, coalesce(total, 0) AS total, coalesce(kinds, 0) AS kinds FROM pages p LEFT JOIN (SELECT folio, CAST(sum(n) AS BIGINT) AS total, count(*) AS kinds FROM trans GROUP BY folio) USING (folio)", BASE, TRANS, PAGES)
add("ratio_profiles_nested_and_back", "SELECT language, glyph, length, pos, round(ratio, 6) AS ratio FROM dense WHERE ratio <> 0", BASE, LINES, LPROF, LDENSE)
_transcribed = """SELECT 'f' || doc_id || 'r' AS folio, CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE coalesce(lang, '') END AS language, '' AS hand,
  array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: (i - 1) % 4 <> 2), lambda i: regexp_replace(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+', '.', 'g')), chr(10)) AS body
FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)"""
add(
    "command_line_ngrams",
    """SELECT agg, page_count, n, ngram, cnt, round(cnt / sum(cnt) OVER (PARTITION BY agg, n), 6) AS freq FROM (
  SELECT 'all' AS agg, n, ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM grams GROUP BY ALL UNION ALL SELECT 'language_b', n, ngram, cnt FROM grams WHERE language = 'B')
JOIN (SELECT 'all' AS agg, count(*) AS page_count FROM src UNION ALL SELECT 'language_b', count(*) FROM src WHERE language = 'B') USING (agg)""",
    O._base(_transcribed), O.G123,
)
_shown = "(VALUES " + ", ".join(f"({_q(g.name)}, {k})" for k, g in enumerate(sorted(R.DOCUMENTS, key=lambda g: len(g.where) > 1), 1)) + ") AS d(agg, place)"
add("groups_in_display_order", f"SELECT d.agg, d.place, count(m.folio) AS page_count FROM {_shown} LEFT JOIN members m ON m.agg = d.agg GROUP BY ALL", PAGES, MEMBERS)

NAMES = """
names AS (
  SELECT 'f' || (doc_id // 4 + 1) || CASE WHEN doc_id % 2 = 0 THEN 'r' ELSE 'v' END || CASE WHEN doc_id % 4 >= 2 THEN '2' ELSE '' END AS page,
    doc_id // 4 + 1 AS number, chr(CAST(doc_id % 20 + 65 AS INTEGER)) AS quire
  FROM documents)"""
_place = "SELECT quire, page, CAST(row_number() OVER (PARTITION BY quire ORDER BY {}) AS INTEGER) AS place FROM names"
add("page_order_natural", _place.format("number, page"), NAMES)
add("page_order_by_name", _place.format("page"), NAMES)
add("folio_bases", "SELECT page, 'f' || number AS leaf, regexp_replace(page, '[rv]+$', '') AS without_side, number FROM names", NAMES)

add(
    "nearest_pages",
    """SELECT place, folio, squared FROM (
  SELECT p.folio AS place, c.folio, (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) AS squared FROM centres p, centres c WHERE p.folio % 50 = 0 AND c.folio % 50 <> 0)
WHERE squared <= 10000000000 QUALIFY row_number() OVER (PARTITION BY place ORDER BY squared, folio) = 1""",
    BASE, PLACED, SM, "\ncentres AS (SELECT folio, CAST(round(page_center_x * 1000000) AS BIGINT) AS x, CAST(round(page_center_y * 1000000) AS BIGINT) AS y FROM m4)",
)

_tables = (("m1", "ngram", 2), ("m2", "markov", 3), ("m3", "wordpos", 5), ("m4", "pagepos", 1))
add(
    "page_metrics_first_table",
    "SELECT x.* EXCLUDE (k1, k2, k3, k4), coalesce(k1, k2, k3, k4) AS known_from, src.language FROM (SELECT * FROM s1 FULL JOIN s2 USING (folio) FULL JOIN s3 USING (folio) FULL JOIN s4 USING (folio)) x JOIN src USING (folio)",
    BASE, PG, NM, TRANS, TM, AT, PM, PLACED, SM, *(f"\ns{k} AS (SELECT *, '{name}' AS k{k} FROM {m} WHERE folio % {n} = 0)" for k, (m, name, n) in enumerate(_tables, 1)),
)
add("page_metrics_joined", O.ORACLE_SQL["page_metrics_full_join"])
add("box_glyphs_by_label", "SELECT quality, toxic, count(*) AS pages, CAST(sum(n) AS BIGINT) AS glyphs FROM (SELECT folio, count(*) AS n FROM pix GROUP BY folio) JOIN labels ON doc_id = folio GROUP BY ALL", BASE, BOXES)
add(
    "cell_pixels",
    f"""SELECT col, row, count(*) AS n, CAST(round(col / 100 * any_value(g_width)) AS INTEGER) AS x, CAST(round(row / 150 * any_value(g_height)) AS INTEGER) AS y
FROM (SELECT CAST(least(floor(trunc(x) / g_width * {O._pc}), {O._pc - 1}) AS INTEGER) AS col, CAST(least(floor(trunc(y) / g_height * {O._pr}), {O._pr - 1}) AS INTEGER) AS row, g_width, g_height FROM pix) GROUP BY col, row""",
    BASE, BOXES,
)
add("tokens_with_separators", "SELECT language, tok, count(*) AS n FROM (SELECT language, unnest(string_split(norm, '')) AS tok FROM lines WHERE norm <> '') GROUP BY ALL", BASE)


def _ramp(v: str, stops) -> str:
    parts = []
    for (a, low), (b, high) in zip(stops, stops[1:], strict=False):
        rgb = " || ',' || ".join(f"CAST(round({float(x)} + ({v} - {a}) / {b - a} * {y - x}) AS INTEGER)" for x, y in zip(low, high, strict=True))
        parts.append(f"WHEN {v} <= {b} THEN {rgb}")
    return f"CASE {' '.join(parts)} END"


HEAT = ((0.0, (0, 0, 0)), (0.25, (40, 0, 80)), (1.0, (255, 240, 200)))
COLD = ((0.0, (0, 0, 0)), (1.0, (80, 160, 255)))
add(
    "glyph_colours",
    f"SELECT glyph, {_ramp('v', HEAT)} AS colour, CASE WHEN w < 0 THEN {_ramp('(-w)', COLD)} ELSE {_ramp('w', HEAT)} END AS diff_colour FROM shares2",
    BASE, G1,
    "\nsides AS (SELECT ngram AS glyph, coalesce(max(cnt) FILTER (language = 'en'), 0) AS en, coalesce(max(cnt) FILTER (language = 'de'), 0) AS de FROM grams GROUP BY ngram)",
    "\nshares2 AS (SELECT glyph, coalesce(en / nullif(max(en) OVER (), 0), 0.0) AS v, coalesce((en - de) / nullif(max(abs(en - de)) OVER (), 0), 0.0) AS w FROM sides)",
)
add(
    "url_state_formatted",
    "SELECT page_id, 'view=diff' || CASE WHEN url <> '' THEN '&page=' || replace(replace(replace(url_encode(url), '%20', '+'), '%2A', '*'), '~', '%7E') ELSE '' END || CASE WHEN page_id % 2 = 0 THEN '&log=1' ELSE '' END AS state FROM pages",
)
add("feed_transitions", O.ORACLE_SQL["conversation_transitions"])
