"""DuckDB SQL for the queries of ``queries``, put together from common table expressions."""

from __future__ import annotations

from ..functions import text as T
from ..functions.profiles import DIGRAPHS, EVA_COLLAPSED, EVA_DISTINCT, RUNS
from ..operators import groups as R
from ..operators.grids import PIXEL_GRIDS, TEXT_GRIDS, kernel

ORACLE_SQL: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(col: str, profile: str = "distinct") -> str:
    e = f"lower(regexp_replace({col}, '[^\\p{{L}}]+', '.', 'g'))"
    if profile == "identity":
        return f"regexp_replace({e}, '[^a-z.]', '', 'g')"
    for a, b in DIGRAPHS:
        e = f"replace({e}, '{a}', '{b}')"
    if profile == "distinct":
        for a, b in RUNS:
            e = f"replace({e}, '{a}', '{b}')"
        alphabet = EVA_DISTINCT.order
    else:
        for c in "ie":
            e = f"regexp_replace({e}, '{c}{{1,4}}', '{c.upper()}', 'g')"
        alphabet = EVA_COLLAPSED.order
    return f"regexp_replace({e}, '[^{alphabet}.]', '', 'g')"


def _base(source: str, profile: str = "distinct") -> str:
    """lines and toks (with ``ws``, words, and ``solid``, glyphs) of (folio, language, hand, body)."""
    return f"""
src AS ({source}),
cut AS (SELECT folio, language, hand, string_split(coalesce(body, ''), chr(10)) AS ls FROM src),
lines AS (
  SELECT folio, language, hand, CAST(i - 1 AS INTEGER) AS line_idx, CAST(i AS INTEGER) AS line_num, i = 1 AS para_start, i = len(ls) AS para_end,
    {_norm('ls[i]', profile)} AS norm
  FROM cut, unnest(range(1, len(ls) + 1)) AS t(i)),
toks AS (SELECT *, list_filter(string_split_regex(norm, '[.]+'), lambda w: w <> '') AS ws, replace(norm, '.', '') AS solid FROM lines)"""


DOCS = "SELECT doc_id AS folio, coalesce(lang, '') AS language, coalesce(source, '') AS hand, text AS body FROM documents"
BASE = _base(DOCS)
PAGES = """
pages AS (
  SELECT d.doc_id AS folio, coalesce(lang, '') AS language, coalesce(source, '') AS hand, chr(CAST(d.doc_id % 20 + 65 AS INTEGER)) AS quire,
    coalesce('q' || quality || 't' || toxic, '') AS illustration
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def add(name: str, body: str, *ctes: str) -> None:
    ORACLE_SQL[name] = ("WITH " + ",".join(ctes) if ctes else "") + "\n" + body.strip() + "\n"


def _grams(sizes: str, by: str) -> str:
    return f"""
words AS (SELECT {by}, folio, unnest(ws) AS w FROM toks),
grams AS (SELECT {by}, ngram, CAST(len(ngram) AS INTEGER) AS n, count(*) AS cnt FROM (
  SELECT {by}, substr(w, p, k) AS ngram FROM words, unnest({sizes}) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(p)) GROUP BY ALL)"""


G1, G2, G3, G12, G123 = (_grams(x, "language") for x in ("[1]", "[2]", "[3]", "[1, 2]", "[1, 2, 3]"))

add("glyph_unigrams", "SELECT language, ngram AS glyph, cnt FROM grams", BASE, G1)
add("glyph_unigrams_identity", "SELECT language, ngram AS glyph, cnt FROM grams", _base(DOCS, "identity"), G1)
add("word_bigrams", "SELECT language, ngram, cnt FROM grams", BASE, G2)
add("trigrams_topk", "SELECT language, ngram, cnt, CAST(row_number() OVER (PARTITION BY language ORDER BY cnt DESC, ngram) AS INTEGER) AS rank FROM grams QUALIFY rank <= 10", BASE, G3)
add("ngram_min_count", "SELECT language, n, ngram, cnt, CAST(total AS BIGINT) AS total, count(*) OVER (PARTITION BY language, n) AS uniq, round(cnt / total, 6) AS freq FROM (SELECT *, sum(cnt) OVER (PARTITION BY language, n) AS total FROM grams) WHERE cnt >= 5", BASE, G123)
add("ngram_frequencies", "SELECT hand, n, ngram, round(cnt / sum(cnt) OVER (PARTITION BY hand, n), 6) AS freq FROM grams", BASE, _grams("[1, 2]", "hand"))
add(
    "ngram_frequency_lookup",
    "SELECT l.language, w.ngram, round(coalesce(f.freq, 0.0), 6) AS freq FROM (SELECT DISTINCT language FROM src) l CROSS JOIN (SELECT unnest(['o', 'on', 'ont', 'qqq']) AS ngram) w LEFT JOIN (SELECT language, ngram, cnt / sum(cnt) OVER (PARTITION BY language, n) AS freq FROM grams) f ON f.language = l.language AND f.ngram = w.ngram",
    BASE, G123,
)
add("ngram_totals", "SELECT language, n, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS uniq FROM grams GROUP BY ALL", BASE, G123)
add(
    "bigram_matrix_dense",
    "SELECT x.language, x.ngram AS a, y.ngram AS b, coalesce(p.cnt, 0) AS cnt, round(coalesce(p.cnt, 0) / sum(coalesce(p.cnt, 0)) OVER (PARTITION BY x.language), 6) AS freq FROM (SELECT * FROM grams WHERE n = 1) x JOIN (SELECT * FROM grams WHERE n = 1) y ON x.language = y.language LEFT JOIN (SELECT * FROM grams WHERE n = 2) p ON p.language = x.language AND p.ngram = x.ngram || y.ngram",
    BASE, G12,
)
add(
    "ngram_diff_topk",
    """SELECT *, CAST(row_number() OVER (ORDER BY abs(freq_diff) DESC, ngram) AS INTEGER) AS rank FROM (
  SELECT ngram, round(coalesce(a.freq, 0), 6) AS freq_a, round(coalesce(b.freq, 0), 6) AS freq_b, round(coalesce(a.freq, 0) - coalesce(b.freq, 0), 6) AS freq_diff
  FROM (SELECT * FROM f WHERE language = 'en' AND cnt >= 5) a FULL JOIN (SELECT * FROM f WHERE language = 'de' AND cnt >= 5) b USING (ngram)
  WHERE abs(coalesce(a.freq, 0) - coalesce(b.freq, 0)) > 1e-5) QUALIFY rank <= 20""",
    BASE, G3, "\nf AS (SELECT language, ngram, cnt, cnt / sum(cnt) OVER (PARTITION BY language) AS freq FROM grams)",
)
_WEB = "SELECT page_id AS folio, '' AS language, '' AS hand, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages"
add("web_page_unigrams", "SELECT ngram AS glyph, CAST(sum(cnt) AS BIGINT) AS cnt FROM grams GROUP BY 1", _base(_WEB, "identity"), G1)

# transitions

TRANS = """
framed AS (SELECT folio, '^' || w || '$' AS f FROM (SELECT folio, unnest(ws) AS w FROM toks)),
ends AS (SELECT folio, left(solid, 1) AS a, right(solid, 1) AS z, para_start, para_end, line_idx FROM toks WHERE solid <> ''),
pairs AS (
  SELECT folio, f[p] AS from_tok, f[p + 1] AS to_tok FROM framed, unnest(range(1, len(f))) AS t(p)
  UNION ALL SELECT folio, '^^', a FROM ends UNION ALL SELECT folio, z, '$$' FROM ends
  UNION ALL SELECT folio, '^^^', a FROM ends WHERE para_start UNION ALL SELECT folio, z, '$$$' FROM ends WHERE para_end
  UNION ALL SELECT folio, '^^^^', arg_min(a, line_idx) FROM ends GROUP BY folio
  UNION ALL SELECT e.folio, e.z, '$$$$' FROM ends e JOIN (SELECT folio, max(line_idx) AS line_idx FROM toks GROUP BY folio) m USING (folio, line_idx)),
trans AS (SELECT folio, from_tok, to_tok, count(*) AS n FROM pairs GROUP BY ALL),
bylang AS (SELECT language, from_tok, to_tok, CAST(sum(n) AS BIGINT) AS n FROM trans JOIN src USING (folio) GROUP BY ALL)"""
PROBS = "\nprobs AS (SELECT *, n / sum(n) OVER (PARTITION BY language, from_tok) AS prob FROM bylang)"
_border = "('" + "', '".join(T.BORDERS) + "')"

add("markov_intraword", f"SELECT * FROM bylang WHERE from_tok NOT IN {_border} AND to_tok NOT IN {_border}", BASE, TRANS)
for _name, _k in (("word", 1), ("line", 2), ("para", 3), ("page", 4)):
    add(f"markov_{_name}_boundary", f"SELECT * FROM bylang WHERE from_tok = '{'^' * _k}' OR to_tok = '{'$' * _k}'", BASE, TRANS)
add("markov_probabilities", "SELECT language, from_tok, to_tok, n, round(prob, 6) AS prob FROM probs", BASE, TRANS, PROBS)
add("markov_charset", f"SELECT DISTINCT language, tok, tok IN {_border} AS border FROM (SELECT language, from_tok AS tok FROM bylang UNION SELECT language, to_tok FROM bylang)", BASE, TRANS)
_DIFF = "FROM (SELECT * FROM probs WHERE language = 'en') a FULL JOIN (SELECT * FROM probs WHERE language = 'de') b USING (from_tok, to_tok)"
add(
    "markov_diff",
    "SELECT from_tok, to_tok, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, coalesce(a.n, 0) - coalesce(b.n, 0) AS n_diff, round(coalesce(a.prob, 0), 6) AS prob_a, round(coalesce(b.prob, 0), 6) AS prob_b, round(coalesce(a.prob, 0) - coalesce(b.prob, 0), 6) AS prob_diff " + _DIFF,
    BASE, TRANS, PROBS,
)
add("markov_max_abs_diff", "SELECT round(max(abs(coalesce(a.prob, 0) - coalesce(b.prob, 0))), 6) AS max_abs_diff " + _DIFF, BASE, TRANS, PROBS)
add(
    "markov_scaled_view",
    f"SELECT language, from_tok, to_tok, round(n / most, 6) AS share, round(ln(1 + n) / ln(1 + most), 6) AS log_share FROM (SELECT *, max(n) OVER (PARTITION BY language) AS most FROM bylang WHERE from_tok NOT IN {_border} AND to_tok NOT IN {_border})",
    BASE, TRANS,
)
_TURNS = f"""
src AS (SELECT DISTINCT conv_id AS folio, '' AS language FROM conversations),
toks AS (
  SELECT *, list_filter(string_split_regex(norm, '[.]+'), lambda w: w <> '') AS ws, replace(norm, '.', '') AS solid FROM (
    SELECT conv_id AS folio, turn AS line_idx, turn = min(turn) OVER (PARTITION BY conv_id) AS para_start, turn = max(turn) OVER (PARTITION BY conv_id) AS para_end, {_norm("coalesce(text, '')")} AS norm FROM conversations))"""
add("conversation_transitions", "SELECT from_tok, to_tok, CAST(sum(n) AS BIGINT) AS n FROM trans GROUP BY ALL", _TURNS, TRANS)

# groups


def _matches(g: R.Group) -> str:
    tests = [f"quire = '{chr(64 + v)}'" if k == "quire" else f"{k} = {_q(str(v))}" for k, v in g.where.items()]
    return " AND ".join(tests) or "true"


MEMBERS = "\nmembers AS (SELECT *, unnest(list_filter([" + ", ".join(f"CASE WHEN {_matches(g)} THEN {_q(g.name)} END" for g in R.DOCUMENTS) + "], lambda x: x IS NOT NULL)) AS agg FROM pages)"


def _defs(groups) -> str:
    return "(VALUES " + ", ".join(f"({_q(g.name)}, {_q(g.description)})" for g in groups) + ") AS d(agg, description)"


add("markov_grouped_rollup", "SELECT agg, from_tok, to_tok, CAST(sum(n) AS BIGINT) AS n FROM trans JOIN members USING (folio) GROUP BY ALL", BASE, TRANS, PAGES, MEMBERS)
add("group_membership", "SELECT agg, folio FROM members", PAGES, MEMBERS)
for _name, _groups in (("group_manifest", R.DOCUMENTS), ("group_subset", R.select(R.DOCUMENTS, ["lang_fr", "nowhere", "en_toxic"]))):
    add(_name, f"SELECT d.agg, d.description, count(m.folio) AS page_count FROM {_defs(_groups)} LEFT JOIN members m ON m.agg = d.agg GROUP BY ALL", PAGES, MEMBERS)
_LONG = "\nlong AS (" + " UNION ALL ".join(f"SELECT agg, '{a}' AS attribute, {a} AS value FROM members" for a in ("language", "hand", "illustration")) + ")"
add("group_overlap_stats", "SELECT agg, attribute, value, count(*) AS pages, round(count(*) / any_value(total), 6) AS share FROM (SELECT *, count(*) OVER (PARTITION BY agg, attribute) AS total FROM long) GROUP BY agg, attribute, value", PAGES, MEMBERS, _LONG)
add("group_contents", "SELECT agg, quire, folio FROM members", PAGES, MEMBERS)
add("distinct_domains", "SELECT DISTINCT attribute, value FROM long WHERE value <> ''", PAGES, MEMBERS, _LONG)
add("metadata_match_rate", "SELECT count(DISTINCT d.doc_id) AS folios, count(DISTINCT l.doc_id) AS matched FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
add("quire_numbers", "SELECT folio, quire, CAST(ascii(quire) - 64 AS INTEGER) AS number FROM pages", PAGES)

add("markov_matrix_dense", "SELECT a.language, a.tok AS from_tok, b.tok AS to_tok, coalesce(n, 0) AS n FROM toks2 a JOIN toks2 b ON a.language = b.language LEFT JOIN bylang t ON t.language = a.language AND t.from_tok = a.tok AND t.to_tok = b.tok", BASE, TRANS, "\ntoks2 AS (SELECT language, from_tok AS tok FROM bylang UNION SELECT language, to_tok FROM bylang)")
add("charset_union", "SELECT tok, count(*) FILTER (language = 'en') AS in_en, count(*) FILTER (language = 'de') AS in_de FROM (SELECT language, from_tok AS tok FROM bylang UNION SELECT language, to_tok FROM bylang) WHERE language IN ('en', 'de') GROUP BY tok", BASE, TRANS)
add("top_ngrams_then_min_count", "SELECT * FROM (SELECT language, ngram, cnt, CAST(row_number() OVER (PARTITION BY language ORDER BY cnt DESC, ngram) AS INTEGER) AS rank FROM grams) WHERE rank <= 50 AND cnt >= 500", BASE, G2)
add("page_order", "SELECT CAST(ascii(quire) - 64 AS INTEGER) AS number, folio, CAST(row_number() OVER (PARTITION BY quire ORDER BY folio) AS INTEGER) AS place FROM pages", PAGES)
add("legend_colours", "SELECT language, CAST(row_number() OVER (ORDER BY min(folio), language) - 1 AS INTEGER) AS colour FROM pages GROUP BY language", PAGES)

# positions in words and lines

AT = """
occ AS (SELECT language, folio, w, len(w) AS len, CAST(p - 1 AS INTEGER) AS pos, w[p] AS glyph FROM (SELECT language, folio, unnest(ws) AS w FROM toks), unnest(range(1, len(w) + 1)) AS t(p))"""


def _positions(by: str, where: str = "true") -> str:
    return f"""
wp AS (SELECT {by}, glyph, count(*) FILTER (len > 1 AND pos = 0) AS start, count(*) FILTER (len > 1 AND pos > 0 AND pos < len - 1) AS middle, count(*) FILTER (len > 1 AND pos = len - 1) AS end, count(*) FILTER (len = 1) AS "only", count(*) AS total FROM occ WHERE {where} GROUP BY ALL),
wr AS (SELECT *, start / total AS start_ratio, middle / total AS middle_ratio, "end" / total AS end_ratio, "only" / total AS only_ratio FROM wp)""".replace(" AS end,", ' AS "end",')


WP = _positions("language")
_P = ("start", "middle", "end", "only")
add("wordpos_counts", "SELECT * FROM wp", BASE, AT, WP)
add("wordpos_counts_min_length", "SELECT * FROM wp", BASE, AT, _positions("language", "len >= 3"))
add("wordpos_ratios", "SELECT language, glyph, total, " + ", ".join(f"round({p}_ratio, 6) AS {p}_ratio" for p in _P) + " FROM wr", BASE, AT, WP)
add("wordpos_totals", "SELECT language, " + ", ".join(f'CAST(sum("{p}") AS BIGINT) AS "{p}"' for p in (*_P, "total")) + " FROM wp GROUP BY language", BASE, AT, WP)
add("wordpos_order_position", "SELECT *, CAST(row_number() OVER (PARTITION BY language ORDER BY score DESC, glyph) AS INTEGER) AS rank FROM (SELECT language, glyph, round(start_ratio - end_ratio, 6) AS score FROM wr)", BASE, AT, WP)
_d = lambda p: f"coalesce(a.{p}_ratio, 0) - coalesce(b.{p}_ratio, 0)"
add(
    "wordpos_diff",
    "SELECT glyph, " + ", ".join(f"round({_d(p)}, 6) AS {p}_ratio_diff" for p in _P) + f", CASE WHEN {_d('start')} > 0.001 THEN 'a' WHEN {_d('start')} < -0.001 THEN 'b' ELSE 'same' END AS tendency FROM (SELECT * FROM wr WHERE language = 'en') a FULL JOIN (SELECT * FROM wr WHERE language = 'de') b USING (glyph)",
    BASE, AT, WP,
)
_scores = lambda x: f"(SELECT glyph, total, round(start_ratio - end_ratio, 6) AS score FROM wr WHERE language = '{x}')"
add("wordpos_compare_order", f"SELECT b.glyph, b.total, b.score, CAST(row_number() OVER (ORDER BY a.rank NULLS LAST, b.glyph) AS INTEGER) AS rank FROM {_scores('de')} b LEFT JOIN (SELECT glyph, row_number() OVER (ORDER BY score DESC, glyph) AS rank FROM {_scores('en')}) a USING (glyph)", BASE, AT, WP)
add("wordpos_diff_order", f"SELECT *, CAST(row_number() OVER (ORDER BY score_a DESC, glyph) AS INTEGER) AS rank FROM (SELECT glyph, round(coalesce(a.score, 0), 6) AS score_a, round(coalesce(a.score, 0) - coalesce(b.score, 0), 6) AS score_diff FROM {_scores('en')} a FULL JOIN {_scores('de')} b USING (glyph))", BASE, AT, WP)
PROFILE = "\nprof AS (SELECT language, glyph, CAST(least(len, 9) AS INTEGER) AS length, pos, count(*) AS n FROM occ WHERE pos < 9 GROUP BY ALL)"
DENSE = "\nplaces AS (SELECT CAST(l AS INTEGER) AS length, CAST(p AS INTEGER) AS pos FROM range(1, 10) AS a(l), range(0, 9) AS b(p) WHERE p < l),\ndense AS (SELECT t.language, t.glyph, length, pos, coalesce(n, 0) AS n, coalesce(n, 0) / total AS ratio FROM (SELECT language, glyph, sum(n) AS total FROM prof GROUP BY ALL) t CROSS JOIN places LEFT JOIN prof USING (language, glyph, length, pos))"
add("charpos_word_profile", "SELECT * FROM prof", BASE, AT, PROFILE)
add(
    "charpos_line_profile",
    "SELECT language, glyph, length, pos, count(*) AS n FROM (SELECT language, length, pos, unnest(string_split(w, '')) AS glyph FROM (SELECT language, CAST(least(len(ws), 12) AS INTEGER) AS length, CAST(p - 1 AS INTEGER) AS pos, ws[p] AS w FROM toks, unnest(range(1, least(len(ws), 12) + 1)) AS t(p))) GROUP BY ALL",
    BASE,
)
add("charpos_ratios_dense", "SELECT language, glyph, length, pos, n, round(ratio, 6) AS ratio FROM dense", BASE, AT, PROFILE, DENSE)
_s, _e = "sum(CASE WHEN pos = 0 THEN ratio ELSE 0 END) / 7", "sum(CASE WHEN pos = length - 1 THEN ratio ELSE 0 END) / 7"
add("charpos_order_score", f"SELECT language, glyph, round({_s}, 6) AS start_score, round({_e}, 6) AS end_score, round({_s} - {_e}, 6) AS position_score FROM dense WHERE length BETWEEN 3 AND 9 GROUP BY ALL", BASE, AT, PROFILE, DENSE)
add("charpos_line_counts", "SELECT language, count(*) AS line_count, CAST(sum(len(ws)) AS BIGINT) AS word_count FROM toks WHERE len(ws) > 0 GROUP BY language", BASE)

# positions on pages

PLACED = """
ext AS (SELECT folio, min(line_num) AS min_line, max(line_num) AS max_line, CAST(max(len(solid)) AS INTEGER) AS max_width, count(*) AS line_count FROM toks GROUP BY folio),
whole AS (SELECT max(max_line) AS g_line, max(max_width) AS g_width FROM ext),
placed AS (
  SELECT language, folio, solid[p] AS glyph, line_num, p - 1 AS char_idx, g_line, g_width,
    CASE WHEN max_line > min_line THEN (line_num - min_line) / (max_line - min_line) ELSE 0.5 END AS y_page, (p - 1) / max_width AS x_page,
    CASE WHEN g_line > 1 THEN (line_num - 1) / g_line ELSE 0.5 END AS y_ms, (p - 1) / g_width AS x_ms
  FROM toks JOIN ext USING (folio), whole, unnest(range(1, len(solid) + 1)) AS t(p))"""


def _hist(x: str, y: str, cols: int, rows: int, by: str = "language", source: str = "placed") -> str:
    return f"\ngrid AS (SELECT {by}, glyph, CAST(least(floor({x} * {cols}), {cols - 1}) AS INTEGER) AS col, CAST(least(floor({y} * {rows}), {rows - 1}) AS INTEGER) AS row, count(*) AS n FROM {source} GROUP BY ALL)"


COARSE, FINE = (_hist("x_page", "y_page", *TEXT_GRIDS[k]) for k in ("coarse", "fine"))
SHARES = "\nshares AS (SELECT *, n / sum(n) OVER (PARTITION BY language, glyph) AS share FROM grid)"
add("page_extents", "SELECT * FROM ext", BASE, PLACED)
add("pagepos_grid_page_coarse", "SELECT * FROM grid", BASE, PLACED, COARSE)
add("pagepos_grid_page_fine", "SELECT * FROM grid", BASE, PLACED, FINE)
add("pagepos_grid_manuscript", "SELECT * FROM grid", BASE, PLACED, _hist("x_ms", "y_ms", *TEXT_GRIDS["coarse"]))
add("pagepos_raw_grid", "SELECT language, glyph, CAST(least(char_idx, g_width - 1) AS INTEGER) AS col, CAST(least(line_num - 1, g_line - 1) AS INTEGER) AS row, count(*) AS n FROM placed GROUP BY ALL", BASE, PLACED)
add("pagepos_total_grid", "SELECT language, col, row, CAST(sum(n) AS BIGINT) AS n FROM grid GROUP BY ALL", BASE, PLACED, COARSE)
add("pagepos_distribution", "SELECT language, glyph, col, row, n, round(share, 6) AS share FROM shares", BASE, PLACED, COARSE, SHARES)
_cols, _rows = TEXT_GRIDS["coarse"]
_cells = f"(SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row FROM range({_cols}) AS a(c), range({_rows}) AS b(r))"
add("pagepos_dense_grid", f"SELECT g.language, g.glyph, col, row, coalesce(n, 0) AS n FROM (SELECT DISTINCT language, glyph FROM grid) g CROSS JOIN {_cells} LEFT JOIN grid USING (language, glyph, col, row)", BASE, PLACED, COARSE)
_o = lambda x: f"(SELECT * FROM shares WHERE glyph = 'o' AND language = '{x}')"
add("pagepos_diff", f"SELECT col, row, round(coalesce(a.share, 0), 6) AS share_a, round(coalesce(b.share, 0), 6) AS share_b, round(coalesce(a.share, 0) - coalesce(b.share, 0), 6) AS share_diff FROM {_o('en')} a FULL JOIN {_o('de')} b USING (col, row)", BASE, PLACED, COARSE, SHARES)
KERNEL = "\nk AS (SELECT * FROM (VALUES " + ", ".join(f"({x - 1}, {y - 1}, CAST({v!r} AS DOUBLE))" for y, row in enumerate(kernel(3)) for x, v in enumerate(row)) + ") AS v(dx, dy, w))"
_inside = f"col BETWEEN 0 AND {_cols - 1} AND row BETWEEN 0 AND {_rows - 1}"
add("pagepos_blur", f"SELECT language, glyph, col, row, round(sum(share), 6) AS share FROM (SELECT language, glyph, CAST(col + dx AS INTEGER) AS col, CAST(row + dy AS INTEGER) AS row, share * w AS share FROM shares, k) WHERE {_inside} GROUP BY ALL", BASE, PLACED, COARSE, SHARES, KERNEL)
add(
    "pagepos_blur_diff",
    f"""SELECT glyph, col, row, round(coalesce(v / nullif(max(abs(v)) OVER (PARTITION BY glyph), 0), 0), 4) AS scaled FROM (
  SELECT glyph, col, row, sum(v) AS v FROM (
    SELECT glyph, CAST(col + dx AS INTEGER) AS col, CAST(row + dy AS INTEGER) AS row, v * w AS v FROM (
      SELECT glyph, col, row, coalesce(a.share, 0) - coalesce(b.share, 0) AS v FROM (SELECT * FROM shares WHERE language = 'en') a FULL JOIN (SELECT * FROM shares WHERE language = 'de') b USING (glyph, col, row)), k)
  WHERE {_inside} GROUP BY ALL)""",
    BASE, PLACED, COARSE, SHARES, KERNEL,
)
add("pagepos_clip", "SELECT * FROM grid WHERE col < 5 AND row < 5", BASE, PLACED, FINE)
_fc, _fr = TEXT_GRIDS["fine"]


def _fifth(v: str, names: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= {b} THEN '{n}'" for b, n in zip((0.2, 0.4, 0.6, 0.8), names, strict=False)) + f" ELSE '{names[-1]}' END"


_label = _fifth(f"row / {_fr - 1}", ("Top", "Upper", "Middle", "Lower", "Bottom")) + " || ', ' || " + _fifth(f"col / {_fc - 1}", ("Left", "Center-Left", "Center", "Center-Right", "Right"))
add("pagepos_region_label", f"SELECT language, {_label} AS region, CAST(sum(n) AS BIGINT) AS n FROM grid GROUP BY ALL", BASE, PLACED, FINE)

# pixel positions

BOXES = """
boxes AS (SELECT language, folio, w, 12 * (k + before) AS x, 40 * line_idx AS y FROM (
  SELECT language, folio, line_idx, k, w, CAST(coalesce(sum(len(w)) OVER (PARTITION BY folio, line_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT language, folio, line_idx, p - 1 AS k, ws[p] AS w FROM toks, unnest(range(1, len(ws) + 1)) AS t(p)))),
sizes AS (SELECT folio, max(x + 12 * len(w)) AS page_width, max(y) + 40 AS page_height FROM boxes GROUP BY folio),
largest AS (SELECT max(page_width) AS g_width, max(page_height) AS g_height FROM sizes),
pix AS (SELECT language, folio, page_width, page_height, g_width, g_height, w[i] AS glyph, x + (i - 0.5) * ((12 * len(w)) / len(w)) AS x, y + 15.0 AS y FROM boxes JOIN sizes USING (folio), largest, unnest(range(1, len(w) + 1)) AS t(i)),
pixplaced AS (SELECT *, least(greatest(x / page_width, 0), 1) AS x_page, least(greatest(y / page_height, 0), 1) AS y_page, least(greatest(x / g_width, 0), 1) AS x_ms, least(greatest(y / g_height, 0), 1) AS y_ms FROM pix)"""
add("physpos_interpolate", "SELECT folio, glyph, count(*) AS n, round(CAST(sum(x) AS DOUBLE), 6) AS sum_x, round(CAST(sum(y) AS DOUBLE), 6) AS sum_y, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(x) AS DOUBLE) AS max_x FROM pix GROUP BY ALL", BASE, BOXES)
add("physpos_grid_page", "SELECT * FROM grid", BASE, BOXES, _hist("x_page", "y_page", *PIXEL_GRIDS["coarse"], source="pixplaced"))
add("physpos_grid_manuscript", "SELECT * FROM grid", BASE, BOXES, _hist("x_ms", "y_ms", *PIXEL_GRIDS["fine"], source="pixplaced"))
_pc, _pr = PIXEL_GRIDS["raw"]
add("physpos_raw_grid", f"SELECT language, glyph, CAST(least(floor(trunc(x) / g_width * {_pc}), {_pc - 1}) AS INTEGER) AS col, CAST(least(floor(trunc(y) / g_height * {_pr}), {_pr - 1}) AS INTEGER) AS row, count(*) AS n FROM pix GROUP BY ALL", BASE, BOXES)

# page metrics

_bits = lambda p: f"CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0 END"
NM = f"""
nt AS (SELECT folio, n, sum(cnt) AS total, count(*) FILTER (cnt >= 5) AS uniq FROM grams GROUP BY ALL),
ne AS (SELECT folio, n, any_value(t.total) AS total, any_value(t.uniq) AS uniq, coalesce(sum(CASE WHEN cnt >= 5 THEN {_bits('cnt / t.total')} END), 0) AS entropy FROM grams JOIN nt t USING (folio, n) GROUP BY folio, n),
np AS (SELECT folio, max(entropy) FILTER (n = 1) AS e1, max(entropy) FILTER (n = 2) AS e2, max(uniq) FILTER (n = 1) AS u, max(total) FILTER (n = 1) AS t1, max(total) FILTER (n = 2) AS t2, max(total) FILTER (n = 3) AS t3 FROM ne GROUP BY folio),
m1 AS (SELECT folio, round(e1, 6) AS unigram_entropy, round(e2, 6) AS bigram_entropy, round(u / t1, 6) AS token_diversity, round(t2 / t1, 6) AS bigram_ratio, round(t3 / t1, 6) AS trigram_ratio FROM np)"""
TM = f"""
m2 AS (SELECT folio, round(sum({_bits('n / total')}), 6) AS transition_entropy, count(*) AS unique_transitions, round(count(*) / any_value(total), 6) AS transition_diversity FROM (SELECT *, sum(n) OVER (PARTITION BY folio) AS total FROM trans) GROUP BY folio)"""
PM = _positions("folio") + ",\nm3 AS (SELECT folio, round(avg(" + " + ".join(_bits(f"{p}_ratio") for p in _P) + "), 6) AS wordpos_entropy, round(avg(start_ratio), 6) AS start_bias, round(avg(end_ratio), 6) AS end_bias FROM wr GROUP BY folio)"
SM = _hist("x_page", "y_page", _cols, _rows, "folio") + f""",
gm AS (SELECT folio, CAST(sum(n) AS DOUBLE) AS m, CAST(sum(col * n) AS DOUBLE) AS c, CAST(sum(row * n) AS DOUBLE) AS r, CAST(sum(col * col * n) AS DOUBLE) AS cc, CAST(sum(row * row * n) AS DOUBLE) AS rr FROM grid GROUP BY folio),
m4 AS (SELECT folio, round(c / m / {_cols - 1}, 6) AS page_center_x, round(r / m / {_rows - 1}, 6) AS page_center_y, round(sqrt(greatest(0, cc / m - (c / m) * (c / m)) + greatest(0, rr / m - (r / m) * (r / m))), 6) AS page_spread FROM gm)"""
PG = _grams("[1, 2, 3]", "folio").replace("SELECT folio, folio,", "SELECT folio,")
add("page_metrics_entropy", "SELECT * FROM m1", BASE, PG, NM)
add("page_metrics_transition", "SELECT * FROM m2", BASE, TRANS, TM)
add("page_metrics_wordpos", "SELECT * FROM m3", BASE, AT, PM)
add("page_metrics_spatial", "SELECT * FROM m4", BASE, PLACED, SM)
add("page_metrics_full_join", "SELECT * FROM m1 FULL JOIN m2 USING (folio) FULL JOIN m3 USING (folio) FULL JOIN m4 USING (folio)", BASE, PG, NM, TRANS, TM, AT, PM, PLACED, SM)
TX = TM.replace(f"round(sum({_bits('n / total')}), 6)", f"sum({_bits('n / total')})")
add("metric_axis_extent", "SELECT round(lo - pad, 6) AS low, round(hi + pad, 6) AS high FROM (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) * 0.05 ELSE 0.05 END AS pad FROM (SELECT min(transition_entropy) AS lo, max(transition_entropy) AS hi FROM m2))", BASE, TRANS, TX)
SX = SM.replace("round(c / m / 4, 6)", "c / m / 4").replace("round(r / m / 9, 6)", "r / m / 9")
add("nearest_point", "SELECT folio, round(distance, 6) AS distance FROM (SELECT folio, sqrt((page_center_x - 0.45) * (page_center_x - 0.45) + (page_center_y - 0.45) * (page_center_y - 0.45)) AS distance FROM m4) WHERE distance <= 0.5 ORDER BY distance, folio LIMIT 1", BASE, PLACED, SX)

# scalar functions

add("normalize_distinct", "SELECT folio, line_idx, norm FROM lines", BASE)
add("normalize_collapsed", "SELECT folio, line_idx, norm FROM lines", _base(DOCS, "collapsed"))
_shown = "array_to_string(list_transform(string_split(ngram, ''), lambda g: CASE g " + " ".join(f"WHEN '{b}' THEN '{a}'" for a, b in DIGRAPHS + RUNS) + " ELSE g END), '')"
add("display_expand", f"SELECT DISTINCT ngram, {_shown} AS shown FROM grams", BASE, G3)
add("border_names", "SELECT * FROM (VALUES " + ", ".join(f"({_q(k)}, {_q(a)}, {_q(b)})" for k, (a, b) in T.BORDERS.items()) + ") AS v(tok, name, label) WHERE tok IN (SELECT from_tok FROM trans UNION SELECT to_tok FROM trans)", BASE, TRANS)
add("ligature_clean", "SELECT doc_id, md5(replace(replace(text, 'ou', '{o''u}'), '{o''u}', 'ou')) AS digest FROM documents")
_u = "replace(replace(replace(text, 'e', '[e:o]'), 'th', '[?:th]'), 'an', '[???:?]')"
add("uncertain_resolve", f"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_u}, '\\[(?:\\?|\\?\\?\\?):(?:\\?|\\?\\?\\?)\\]', '', 'g'), '\\[(?:\\?|\\?\\?\\?):([^\\]]+)\\]', '\\1', 'g'), '\\[([^:\\]]+):[^\\]]+\\]', '\\1', 'g')) AS digest FROM documents")
_m = "replace(replace(replace(text, 'of', '<!note>of<->'), 'en', '@254;en'), 'in', '<%>in<$>-/')"
add("markup_clean", f"SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace({_m}, '<!.*?>', '', 'g'), '@[0-9]+;?', '', 'g'), '<%>', ''), '<$>', ''), '<->', '.'), '-/', '/'), '<[^>]*>', '', 'g'))) AS digest FROM documents")
add("joined_page_text", "SELECT doc_id AS folio, md5(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[^\\p{L}]+', '.', 'g')), ' ')) AS digest FROM documents")
add("canonical_order", f"SELECT DISTINCT tok, CAST(CASE WHEN len(tok) = 1 AND strpos('{EVA_DISTINCT.order}', tok) > 0 THEN strpos('{EVA_DISTINCT.order}', tok) - 1 ELSE 999 END AS INTEGER) AS ord FROM (SELECT from_tok AS tok FROM trans UNION SELECT to_tok FROM trans)", BASE, TRANS)
add("log_scale", "SELECT language, ngram AS glyph, round(ln(1 + cnt) / ln(1 + max(cnt) OVER (PARTITION BY language)), 6) AS scaled FROM grams", BASE, G1)
add("ratio_scaling", "SELECT language, glyph, round(start_ratio, 6) AS linear, round(sqrt(start_ratio), 6) AS sqrt, round(CASE WHEN start_ratio <= 0 THEN 0 ELSE greatest((log10(greatest(start_ratio, 0.0001)) + 4) / 4, 0) END, 6) AS log FROM wr", BASE, AT, WP)
add("url_state", "SELECT page_id, 'diff' AS view, url AS a, true AS log, false AS b FROM pages")
