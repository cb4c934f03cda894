"""SQL of ``source_queries``."""

from __future__ import annotations

from ..operators.counts import POSITIONS
from ..sources.boxes import MALFORMED
from .oracle import AT, BASE, COARSE, G12, PLACED, TRANS, WP, add

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOCI = f"""
cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
loci AS (SELECT doc_id, i, len(ls) AS n, regexp_replace({_LOWER.format('ls[i]')}, '[^a-z]+', '.', 'g') AS text FROM cut, unnest(range(1, len(ls) + 1)) AS t(i))"""
XML = f"""
parts AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[^a-z]+'), lambda w: w <> '') AS ws FROM documents),
boxes AS (
  SELECT 'f' || doc_id || 'r' AS folio, 1000 AS page_width, 0 AS page_height, CAST(i - 1 AS INTEGER) AS word_idx, CAST((i - 1) % 10 * 100 AS INTEGER) AS x,
    CAST((i - 1) // 10 * 30 AS INTEGER) AS y, CAST(len(ws[i]) * 10 AS INTEGER) AS width, 20 AS height, ws[i] AS text
  FROM parts, unnest(range(1, len(ws) + 1)) AS t(i))"""

add(
    "transcription_pages",
    "SELECT 'f' || doc_id || 'r' AS folio, chr(CAST(doc_id % 20 + 65 AS INTEGER)) AS quire, '' AS page_in_quire, '' AS illustration, CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE coalesce(lang, '') END AS language, CASE WHEN doc_id % 3 = 0 THEN '2' ELSE coalesce(source, '') END AS hand, '' AS bifolio FROM documents",
)
_LINES = (
    "SELECT 'f' || doc_id || 'r' AS folio, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS line_idx, CAST(i AS INTEGER) AS line_num, CASE (i - 1) % 4 WHEN 1 THEN 'Pb' ELSE 'P0' END AS locus_type, (i - 1) % 5 = 0 AS para_start, i = n AS para_end, text FROM loci WHERE (i - 1) % 4 <> 2 AND text <> ''"
)
add("transcription_lines", _LINES, LOCI)
add("transcription_files", _LINES, LOCI)
add("transcription_find", "SELECT CASE WHEN a.doc_id % 2 = 0 THEN 'f' ELSE '' END || (a.doc_id + 1) || 'r' AS name, 'f' || b.doc_id || 'r' AS folio, chr(CAST(b.doc_id % 20 + 65 AS INTEGER)) AS quire FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1")
add("xml_word_boxes", "SELECT * FROM boxes", XML)
add("archive_word_boxes", "SELECT * FROM boxes", XML)
add(
    "xml_unreadable",
    f"""SELECT folio || '.xml' AS file, count(*) AS words, '' AS error FROM boxes JOIN documents ON folio = 'f' || doc_id || 'r' WHERE doc_id % 7 > 2 GROUP BY ALL
UNION ALL SELECT 'f' || doc_id || 'r.xml', 0, '{MALFORMED}' FROM documents WHERE doc_id % 7 <= 2""",
    XML,
)
add("xml_box_extents", "SELECT folio, CAST(sum(len(text)) AS BIGINT) AS glyphs, round(min(x) + 5.0, 6)::DOUBLE AS min_x, round(max(x + width) - 5.0, 6)::DOUBLE AS max_x, round(max(y) + 10.0, 6)::DOUBLE AS max_y FROM boxes GROUP BY folio", XML)
# borders of words are one character long, as glyphs are
add("transitions_nested_and_back", "SELECT * FROM bylang WHERE length(from_tok) = 1 AND length(to_tok) = 1", BASE, TRANS)
add("grid_nested_and_back", "SELECT * FROM grid", BASE, PLACED, COARSE)
add("ngrams_nested", "SELECT language, n, CAST(sum(cnt) OVER w AS BIGINT) AS total, count(*) OVER w AS uniq, ngram, cnt, round(cnt / sum(cnt) OVER w, 6) AS freq FROM grams WINDOW w AS (PARTITION BY language, n)", BASE, G12)
add("positions_nested", "SELECT language, glyph, total, " + ", ".join(f"round({p}_ratio, 6) AS {p}_ratio" for p in POSITIONS) + " FROM wr", BASE, AT, WP)
