"""SQL of ``more_queries``."""

from __future__ import annotations

from ..functions.profiles import EVA_DISTINCT
from ..operators import groups as R
from ..operators.grids import TEXT_GRIDS
from . import oracle as O
from .oracle import AT, BASE, BOXES, G12, MEMBERS, PAGES, PLACED, PM, SM, TM, TRANS, WP, _defs, _grams, _hist, _positions, add

_folio = lambda s: s.replace("SELECT folio, folio,", "SELECT folio,")
_JOINED = "JOIN members USING (folio) GROUP BY ALL"
_cols, _rows = TEXT_GRIDS["coarse"]

LINES = """
occ2 AS (SELECT language, folio, length, pos, unnest(string_split(w, '')) AS glyph FROM (SELECT language, folio, CAST(least(len(ws), 12) AS INTEGER) AS length, CAST(p - 1 AS INTEGER) AS pos, ws[p] AS w FROM toks, unnest(range(1, least(len(ws), 12) + 1)) AS t(p)))"""
LPROF = "\nprof AS (SELECT language, glyph, length, pos, count(*) AS n FROM occ2 GROUP BY ALL)"
LDENSE = "\nplaces AS (SELECT CAST(l AS INTEGER) AS length, CAST(p AS INTEGER) AS pos FROM range(1, 13) AS a(l), range(0, 12) AS b(p) WHERE p < l),\ndense AS (SELECT t.language, t.glyph, length, pos, coalesce(n, 0) AS n, coalesce(n, 0) / total AS ratio FROM (SELECT language, glyph, sum(n) AS total FROM prof GROUP BY ALL) t CROSS JOIN places LEFT JOIN prof USING (language, glyph, length, pos))"
_s, _e = "sum(CASE WHEN pos = 0 THEN ratio ELSE 0 END) / 9", "sum(CASE WHEN pos = length - 1 THEN ratio ELSE 0 END) / 9"
LSCORE = f"\nscores AS (SELECT language, glyph, round({_s}, 6) AS start_score, round({_e}, 6) AS end_score, round({_s} - {_e}, 6) AS position_score FROM dense WHERE length BETWEEN 4 AND 12 GROUP BY ALL)"

add("ngram_grouped_rollup", f"SELECT agg, n, ngram, CAST(sum(cnt) AS BIGINT) AS cnt FROM grams {_JOINED}", BASE, _folio(_grams("[1, 2]", "folio")), PAGES, MEMBERS)
add("wordpos_grouped_rollup", "SELECT agg, glyph, " + ", ".join(f'CAST(sum("{p}") AS BIGINT) AS "{p}"' for p in ("start", "middle", "end", "only", "total")) + f" FROM wp {_JOINED}", BASE, AT, _positions("folio"), PAGES, MEMBERS)
add("charpos_grouped_rollup", f"SELECT agg, glyph, length, pos, count(*) AS n FROM (SELECT folio, glyph, length, pos FROM occ2) {_JOINED}", BASE, LINES, PAGES, MEMBERS)
add("pagepos_grouped_rollup", f"SELECT agg, glyph, col, row, CAST(sum(n) AS BIGINT) AS n FROM grid {_JOINED}", BASE, PLACED, _hist("x_page", "y_page", _cols, _rows, "folio"), PAGES, MEMBERS)

_freq = "\nf AS (SELECT language, ngram, cnt / sum(cnt) OVER (PARTITION BY language) AS freq FROM grams WHERE n = {n})"
_ab = "round(coalesce(a.{m}, 0), 6) AS {m}_a, round(coalesce(b.{m}, 0), 6) AS {m}_b, round(coalesce(a.{m}, 0) - coalesce(b.{m}, 0), 6) AS {m}_diff"
add("unigram_diff", "SELECT ngram AS glyph, " + _ab.format(m="freq") + " FROM (SELECT * FROM f WHERE language = 'en') a FULL JOIN (SELECT * FROM f WHERE language = 'de') b USING (ngram) WHERE abs(coalesce(a.freq, 0) - coalesce(b.freq, 0)) > 1e-4", BASE, G12, _freq.format(n=1))
add(
    "bigram_matrix_diff",
    "SELECT x.g AS a, y.g AS b, " + _ab.format(m="freq") + " FROM letters x CROSS JOIN letters y LEFT JOIN f a ON a.language = 'en' AND a.ngram = x.g || y.g LEFT JOIN f b ON b.language = 'de' AND b.ngram = x.g || y.g",
    BASE, G12, _freq.format(n=2), "\nletters AS (SELECT DISTINCT ngram AS g FROM grams WHERE n = 1 AND language IN ('en', 'de'))",
)
add(
    "markov_diff_dense",
    "SELECT x.tok AS from_tok, y.tok AS to_tok, " + _ab.format(m="prob") + " FROM toks2 x CROSS JOIN toks2 y LEFT JOIN probs a ON a.language = 'en' AND a.from_tok = x.tok AND a.to_tok = y.tok LEFT JOIN probs b ON b.language = 'de' AND b.from_tok = x.tok AND b.to_tok = y.tok",
    BASE, TRANS, O.PROBS, "\ntoks2 AS (SELECT from_tok AS tok FROM bylang WHERE language IN ('en', 'de') UNION SELECT to_tok FROM bylang WHERE language IN ('en', 'de'))",
)

_n = lambda order: f"CAST(row_number() OVER (PARTITION BY language ORDER BY {order}, glyph) AS INTEGER)"
add("wordpos_orders", "SELECT language, glyph, " + ", ".join(f"{_n(o)} AS by_{k}" for k, o in (("total", "total DESC"), ("start", "round(start_ratio, 9) DESC"), ("middle", "round(middle_ratio, 9) DESC"), ("end", "round(end_ratio, 9) DESC"), ("alpha", f"strpos('{EVA_DISTINCT.order}', glyph)"))) + " FROM wr", BASE, AT, WP)
add("charpos_line_ratios_dense", "SELECT language, glyph, length, pos, n, round(ratio, 6) AS ratio FROM dense", BASE, LINES, LPROF, LDENSE)
add("charpos_line_order_score", "SELECT * FROM scores", BASE, LINES, LPROF, LDENSE, LSCORE)
add("charpos_compare_order", "SELECT *, CAST(row_number() OVER (ORDER BY score DESC, glyph) AS INTEGER) AS rank FROM (SELECT glyph, count(*) FILTER (language = 'en') AS in_a, count(*) FILTER (language = 'de') AS in_b, coalesce(max(position_score) FILTER (language = 'en'), max(position_score)) AS score FROM scores WHERE language IN ('en', 'de') GROUP BY glyph)", BASE, LINES, LPROF, LDENSE, LSCORE)

add("charpos_enabled_glyphs", "SELECT * FROM prof WHERE glyph IN ('o', 'a', '7', 'zz')", BASE, AT, O.PROFILE)
add("glyph_selection", "SELECT b.ngram AS glyph, a.ngram IS NOT NULL AS known, a.ngram IS NULL OR b.ngram NOT IN ('o', 't') AS enabled FROM (SELECT ngram FROM grams WHERE language = 'fr') b LEFT JOIN (SELECT ngram FROM grams WHERE language = 'en') a USING (ngram)", BASE, O.G1)

add("page_word_counts", "SELECT folio, CAST(sum(len(ws)) AS BIGINT) AS word_count, count(*) FILTER (len(ws) > 0) AS line_count FROM toks GROUP BY folio", BASE)
add("charpos_total_chars", "SELECT folio, count(*) AS total_chars FROM occ WHERE pos < 9 GROUP BY folio", BASE, AT)
add("folio_metadata_left", "SELECT folio, count(*) AS glyphs, coalesce(any_value(CAST(quality AS VARCHAR)), '') AS quality, coalesce(any_value(CAST(toxic AS VARCHAR)), '') AS toxic FROM pix LEFT JOIN labels ON doc_id = folio GROUP BY folio", BASE, BOXES)
add("page_metrics_attributes", "SELECT m2.*, m3.* EXCLUDE (folio), m4.* EXCLUDE (folio), language, hand FROM m2 JOIN m3 USING (folio) JOIN m4 USING (folio) JOIN src USING (folio)", BASE, TRANS, TM, AT, PM, PLACED, SM)

_set = lambda c: f"array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} <> '')), ',') AS {c}"
add("run_metadata", "SELECT count(*) AS total_pages, " + ", ".join(_set(c) for c in ("language", "hand", "illustration")) + " FROM pages", PAGES)
GRIDS = "\ngrids AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {c}, {r}, false)" for k, (c, r) in TEXT_GRIDS.items()) + ") AS v(resolution, cols, rows, absolute) UNION ALL SELECT 'raw', CAST(g_width AS INTEGER), CAST(g_line AS INTEGER), true FROM whole)"
add("grid_manifest", "SELECT * FROM grids", BASE, PLACED, GRIDS)
add("grid_discovery", "SELECT resolution, mode, cols, rows FROM grids, (VALUES ('page'), ('manuscript')) AS m(mode) WHERE mode = 'manuscript' OR NOT absolute", BASE, PLACED, GRIDS)
add(
    "group_manifest_counts",
    f"SELECT d.agg, d.description, count(DISTINCT m.folio) AS page_count, CAST(coalesce(sum(len(solid)), 0) AS BIGINT) AS char_count FROM {_defs(R.DOCUMENTS)} LEFT JOIN members m ON m.agg = d.agg LEFT JOIN toks t ON t.folio = m.folio GROUP BY ALL",
    BASE, PAGES, MEMBERS,
)
