"""Text functions, Column to Column: cleaning of transcribed lines, normalisation, words and glyphs."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profiles import EVA_DISTINCT, SEPARATORS, Profile

# Tokens of the borders of words, lines, paragraphs and pages, with names and labels.
WORD_START, WORD_END = "^", "$"
LINE_START, LINE_END = "^^", "$$"
PARA_START, PARA_END = "^^^", "$$$"
PAGE_START, PAGE_END = "^^^^", "$$$$"
BORDERS = {
    WORD_START: ("Word Start", "WORD▸"), WORD_END: ("Word End", "◂WORD"),
    LINE_START: ("Line Start", "LINE▸"), LINE_END: ("Line End", "◂LINE"),
    PARA_START: ("Paragraph Start", "PARA▸"), PARA_END: ("Paragraph End", "◂PARA"),
    PAGE_START: ("Page Start", "PAGE▸"), PAGE_END: ("Page End", "◂PAGE"),
}


def _lookup(col: Column, table: dict[str, str]) -> Column:
    """The table's entry, or the value itself."""
    if not table:
        return col
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), col), col)


def strip_comments(col: Column) -> Column:
    return F.regexp_replace(col, r"<!.*?>", "")


def strip_references(col: Column) -> Column:
    return F.regexp_replace(col, r"@\d+;?", "")


def resolve_alternatives(col: Column) -> Column:
    """``[a:b]`` becomes the first reading that isn't unknown; with none it goes."""
    unknown = r"(?:\?|\?\?\?)"
    col = F.regexp_replace(col, rf"\[{unknown}:{unknown}\]", "")
    col = F.regexp_replace(col, rf"\[{unknown}:([^\]]+)\]", "$1")
    return F.regexp_replace(col, r"\[([^:\]]+):[^\]]+\]", "$1")


def resolve_ligatures(col: Column) -> Column:
    """``{c'y}`` loses braces and, inside them only, apostrophes."""
    return F.regexp_replace(F.regexp_replace(col, r"'(?=[^{}]*\})", ""), r"\{([^}]+)\}", "$1")


def strip_markup(col: Column) -> Column:
    col = F.replace(F.replace(col, F.lit("<%>"), F.lit("")), F.lit("<$>"), F.lit(""))
    col = F.replace(F.replace(col, F.lit("<->"), F.lit(".")), F.lit("-/"), F.lit("/"))
    return F.trim(F.regexp_replace(col, r"<[^>]*>", ""))


def clean_line(col: Column) -> Column:
    """All cleaning steps of a transcribed line, in their order."""
    return strip_markup(resolve_ligatures(resolve_alternatives(strip_references(strip_comments(col)))))


def part_letters(col: Column, lines: bool = False) -> Column:
    """Prose to transcription form: whatever isn't a letter parts words; with ``lines``, line ends stay."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}\n]+" if lines else r"[^\p{L}]+", ".")


def rewrite(col: Column, profile: Profile = EVA_DISTINCT) -> Column:
    """Lower case, then the profile's rewrites in order."""
    col = F.lower(col)
    for what, by, pattern in profile.rewrites:
        col = F.regexp_replace(col, what, by) if pattern else F.replace(col, F.lit(what), F.lit(by))
    return col


def keep_alphabet(col: Column, profile: Profile = EVA_DISTINCT, separators: bool = True, lines: bool = False) -> Column:
    """Drop characters outside the alphabet; their neighbours become adjacent. With ``lines``, line ends stay."""
    allowed = profile.order + (SEPARATORS if separators else "") + ("\n" if lines else "")
    return F.regexp_replace(col, "[^" + re.escape(allowed) + "]+", "")


def normalise(col: Column, profile: Profile = EVA_DISTINCT, separators: bool = True, lines: bool = False) -> Column:
    return keep_alphabet(rewrite(col, profile), profile, separators, lines)


def split_words(normalised: Column) -> Column:
    inner = F.btrim(normalised, F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[.,/\\]+"))


def solid(normalised: Column) -> Column:
    """Without what parts words and lines."""
    return F.translate(normalised, SEPARATORS + "\n", "")


def glyphs(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda g: g != "")


def tokens(col: Column, profile: Profile = EVA_DISTINCT) -> Column:
    """Glyphs and separators of a line, in order."""
    return glyphs(normalise(col, profile))


def expand(token: Column, profile: Profile = EVA_DISTINCT) -> Column:
    """A glyph as it is written."""
    return _lookup(token, profile.display)


def expand_word(word: Column, profile: Profile = EVA_DISTINCT) -> Column:
    return F.array_join(F.transform(glyphs(word), lambda g: expand(g, profile)), "")


def border_name(token: Column) -> Column:
    return _lookup(token, {k: v[0] for k, v in BORDERS.items()})


def border_label(token: Column) -> Column:
    return _lookup(token, {k: v[1] for k, v in BORDERS.items()})


def quire_number(letter: Column) -> Column:
    """A is 1 to T is 20; others null."""
    return F.when(letter.rlike("^[A-T]$"), F.ascii(letter) - 64)


def folio_base(folio: Column, sides: str = "suffix") -> Column:
    """The leaf of a page: ``suffix`` drops r or v with what follows it, ``trailing`` only r and v at the very end."""
    return F.regexp_replace(folio, r"[rv]\d*$" if sides == "suffix" else r"[rv]+$", "")


def folio_number(folio: Column) -> Column:
    """The number of a page's leaf: its digits, 0 without any."""
    digits = F.regexp_replace(folio_base(folio), "[^0-9]", "")
    return F.coalesce(F.try_to_number(digits, F.lit("9" * 18)), F.lit(0)).cast("long")


def in_locale(name: Column) -> Column:
    """Sorts as people read: letters of both cases together, the small one first."""
    return F.collate(name, "UNICODE")


def natural_key(folio: Column) -> Column:
    """Sorts pages by the number of their leaf, then by name: f2r, f2v, f10r, f85r1, f85r2."""
    return F.struct(folio_number(folio).alias("number"), in_locale(folio).alias("name"))


def join_lines(text: Column, order: Column, by: str = " ") -> Column:
    """Aggregate: the lines of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("order"), text.alias("text")))), lambda s: s["text"]), by)


def parse_state(hash_: Column) -> Column:
    """``#a=1&b=x%20y`` as a map of decoded strings."""
    body = F.regexp_replace(hash_, "^#", "")
    pairs = F.filter(F.split(body, "&"), lambda p: p != "")
    key = lambda p: F.url_decode(F.regexp_extract(p, "^([^=]*)", 1))
    value = lambda p: F.url_decode(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(key(p), value(p))))


def format_state(state: Column) -> Column:
    """A map as ``a=1&b=x+y``, in the map's order; empty values are left out."""
    entries = F.filter(F.map_entries(state), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def state_flag(value: Column, default: bool = False) -> Column:
    return F.when(value.isNull(), F.lit(default)).otherwise(value.isin("1", "true"))
