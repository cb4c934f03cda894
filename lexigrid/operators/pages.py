"""What stands on a page, counted a batch of pages at a time: the counts that all metrics of pages are sums over.

A page's text is one row, so its pairs, glyphs by place and cells are counted within it, with arrays of codes in
place of a row for each glyph; what leaves is a row for each kind of item that the page has, some hundred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions import text as T
from ..functions.profiles import SEPARATORS, Profile

#: Kinds of items: pairs of tokens, glyphs with their places in words (n0 to n3: start, middle, end, only), all trigrams,
#: glyphs within the first nine of their word, cells of the grid (a: column, b: row).
PAIR, GLYPH, TRIGRAMS, NEAR, CELL = "t", "p", "3", "9", "g"
SCHEMA = "folio {}, kind string, a string, b string, n long, n0 long, n1 long, n2 long, n3 long"
#: Sums over a page's items: the total (t), of frequent ones the total (f), the sum of n log n (b) and the number (u), for
#: glyphs (1), pairs within words (2), trigrams (3) and all pairs (t, frequent or not); means over glyphs; moments of cells.
SUMS = ("t1", "f1", "b1", "u1", "t2", "f2", "b2", "t3", "tt", "bt", "ut", "wordpos_entropy", "start_bias", "end_bias", "m", "c", "r", "cc", "rr")
WHOLE = ("u1", "ut")
#: So many characters and pages are counted at once at most, besides a page that is longer.
CHARS, PAGES = 1 << 18, 200
_STARTS = (T.WORD_START, T.LINE_START, T.PARA_START, T.PAGE_START)
_ENDS = (T.WORD_END, T.LINE_END, T.PARA_END, T.PAGE_END)


def _pages(codes: np.ndarray, ends: np.ndarray, owner: np.ndarray, cols: int, rows: int, glyphs: int) -> tuple[np.ndarray, ...]:
    """Counts of pairs (a square of all tokens), glyphs by place, trigrams, near glyphs, and cells, a row of each for a page.

    ``codes`` are glyphs' numbers, -1 for what parts words, -2 for the end of a line; the last line of each text has one too,
    at ``ends``. ``owner`` is the page of a text, from 0 and in order.
    """
    pages, size = int(owner[-1]) + 1, glyphs + len(_STARTS) + len(_ENDS)
    begin, end = glyphs, glyphs + len(_STARTS)
    at, breaks = np.flatnonzero(codes >= 0), np.flatnonzero(codes == -2)
    glyph = codes[at].astype(np.int64)

    # of lines: their text, page, place in the text, and glyphs, from start to stop
    stop = np.searchsorted(at, breaks)
    start = np.concatenate([[0], stop[:-1]])
    n = stop - start
    lines = np.diff(np.searchsorted(breaks, ends, "right"), prepend=0)  # of each text
    text = np.repeat(np.arange(len(ends)), lines)
    page, down, of = owner[text], np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines), lines[text]
    width = np.maximum(np.maximum.reduceat(n, np.cumsum(lines) - lines), 1)[text]  # of their text
    row = np.minimum(np.floor(np.where(of > 1, down / np.maximum(of - 1, 1), 0.5) * rows), rows - 1).astype(np.int64)
    full = n > 0
    opening = np.flatnonzero(full)[np.flatnonzero(np.diff(text[full], prepend=-1))]  # the first with glyphs of each text

    # of words: their first and last glyph, and their line
    edge = np.ones(len(at) + 1, bool)
    edge[1:-1] = np.diff(at) > 1
    heads, tails = np.flatnonzero(edge[:-1]), np.flatnonzero(edge[1:])
    in_page = page[np.searchsorted(stop, heads, "right")]
    length = tails - heads + 1
    one = length == 1

    to = page * size * size
    inner = (np.repeat(to, n) + glyph * size)[:-1]
    inner += glyph[1:]
    border = lambda of, found, k: of + (begin + k) * size + glyph[found]
    after = lambda of, found, k: of + glyph[found] * size + end + k
    top, bottom = full & (down == 0), full & (down == of - 1)
    parts = [inner[~edge[1:-1]], border(in_page * size * size, heads, 0), after(in_page * size * size, tails, 0)]
    parts += [border(to[x], start[x], k) for k, x in ((1, full), (2, top), (3, opening))]
    parts += [after(to[x], stop[x] - 1, k) for k, x in ((1, full), (2, bottom), (3, bottom))]
    square = np.bincount(np.concatenate(parts), minlength=pages * size * size).reshape(pages, size, size)

    # a glyph is the first of as many pairs in words as it isn't the last of a word
    only = np.bincount(in_page[one] * glyphs + glyph[heads[one]], minlength=pages * glyphs).reshape(pages, glyphs)
    begins, stops, goes = square[:, begin, :glyphs], square[:, :glyphs, end], square[:, :glyphs, :glyphs].sum(axis=2)
    places = np.stack([begins - only, goes - begins + only, stops - only, only], axis=2)
    count = places.sum(axis=(1, 2))
    trigrams = count - 2 * begins.sum(axis=1) + only.sum(axis=1)
    long = length > 9
    near = count - np.bincount(in_page[long], length[long] - 9, pages).astype(np.int64)

    index = np.arange(len(at)) - np.repeat(start, n)
    cell = np.minimum((index / np.repeat(width, n) * cols).astype(np.int64), cols - 1) * rows
    cell += np.repeat(page * cols * rows + row, n)
    return square.reshape(pages, -1), places, trigrams, near, np.bincount(cell, minlength=pages * cols * rows).reshape(pages, -1)


def _items(profile: Profile, cols: int, rows: int, kind: pa.DataType) -> Callable[[list, tuple[np.ndarray, ...]], pa.RecordBatch]:
    """Makes a row for each item of some pages."""
    glyphs = len(profile.order)
    tokens = np.array([*profile.order, *_STARTS, *_ENDS], object)
    size = len(tokens)
    schema = pa.schema([("folio", kind), *((c, pa.string()) for c in ("kind", "a", "b")), *((c, pa.int64()) for c in ("n", "n0", "n1", "n2", "n3"))])
    a, b = np.repeat(tokens, size), np.tile(tokens, size)
    # all items of a page in one vector of counts
    square, cells = size * size, cols * rows
    kinds = np.array([PAIR] * square + [GLYPH] * glyphs + [TRIGRAMS, NEAR] + [CELL] * cells, object)
    firsts = pa.array([*a, *profile.order, "", "", *(str(k // rows) for k in range(cells))], pa.string())
    seconds = pa.array([*b, *[""] * (glyphs + 2), *(str(k % rows) for k in range(cells))], pa.string())
    kinds = pa.array(kinds, pa.string())

    def rows_of(folios: list, counts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        pairs, places, trigrams, near, grid = counts
        every = np.concatenate([pairs, places.sum(axis=2), trigrams[:, None], near[:, None], grid], axis=1)
        page, item = np.nonzero(every)
        wide = np.zeros((4, len(item)), np.int64)
        is_glyph = (item >= square) & (item < square + glyphs)
        wide[:, is_glyph] = places[page[is_glyph], item[is_glyph] - square].T
        of, found = pa.array(folios, kind).take(pa.array(page)), pa.array(item)
        return pa.RecordBatch.from_arrays([of, kinds.take(found), firsts.take(found), seconds.take(found), pa.array(every[page, item]), *map(pa.array, wide)], schema=schema)

    return rows_of


def _sums(profile: Profile, cols: int, rows: int, kind: pa.DataType, least: int) -> Callable[[list, tuple[np.ndarray, ...]], pa.RecordBatch]:
    """Makes a row of ``SUMS`` for each of some pages that have glyphs."""
    glyphs = len(profile.order)
    size = glyphs + len(_STARTS) + len(_ENDS)
    col, row = np.repeat(np.arange(cols), rows), np.tile(np.arange(rows), cols)
    schema = pa.schema([("folio", kind), *((c, pa.int64() if c in WHOLE else pa.float64()) for c in SUMS)])
    per = lambda v: v.reshape(len(v), -1).sum(axis=1)
    bits = lambda n: n * np.log2(np.maximum(n, 1))

    def rows_of(folios: list, counts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        pairs, places, trigrams, _, cells = (x.astype(float) for x in counts)
        inner = pairs.reshape(-1, size, size)[:, :glyphs, :glyphs]
        n = places.sum(axis=2)
        has = n > 0
        kinds = np.maximum(has.sum(axis=1), 1)
        ratios = places / np.maximum(n, 1)[:, :, None]
        spread = -ratios * np.log2(np.where(ratios > 0, ratios, 1))
        often, often2 = np.where(n >= least, n, 0), np.where(inner >= least, inner, 0)
        found = {
            "t1": per(n), "f1": per(often), "b1": per(bits(often)), "u1": (n >= least).sum(axis=1),
            "t2": per(inner), "f2": per(often2), "b2": per(bits(often2)), "t3": trigrams,
            "tt": per(pairs), "bt": per(bits(pairs)), "ut": (pairs > 0).sum(axis=1),
            "wordpos_entropy": per(spread) / kinds, "start_bias": ratios[:, :, 0].sum(axis=1) / kinds, "end_bias": ratios[:, :, 2].sum(axis=1) / kinds,
            "m": per(cells), "c": cells @ col, "r": cells @ row, "cc": cells @ (col * col), "rr": cells @ (row * row),
        }
        none = {c: found[c] == 0 for c in ("t2", "t3")}  # no pair or trigram is no sum
        batch = pa.RecordBatch.from_arrays([pa.array(folios, kind), *(pa.array(found[c], schema.field(c).type, mask=none.get(c)) for c in SUMS)], schema=schema)
        return batch.filter(pa.array(has.any(axis=1)))

    return rows_of


def _counter(profile: Profile, cols: int, rows: int, rows_of: Callable[[list, tuple[np.ndarray, ...]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    assert profile.order.isascii() and not set(SEPARATORS) & profile.alphabet
    table = np.full(256, -1, np.int8)
    table[ord("\n")] = -2
    table[[ord(c) for c in profile.order]] = np.arange(len(profile.order))
    wide = pa.large_string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], ()  # the last page and its counts: rows of one page stand together, and more may follow
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = pc.binary_join_element_wise(batch.column("all").cast(wide).fill_null(""), pa.scalar("", wide), pa.scalar("\n", wide))
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            codes, ids = table[np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]], batch.column("folio").to_pylist()
            start = 0
            while start < len(ids):
                far = int(np.searchsorted(offsets, offsets[start] + CHARS, "right")) - 1
                stop = min(max(far, start + 1), start + PAGES, len(ids))
                own = ids[start:stop]
                owner = np.cumsum([False, *(a != b for a, b in pairwise(own))])
                counts = _pages(codes[offsets[start] : offsets[stop]], offsets[start + 1 : stop + 1] - offsets[start] - 1, owner, cols, rows, len(profile.order))
                folios = [own[k] for k in np.flatnonzero(np.diff(owner, prepend=-1))]
                if held and held[0] == folios[0]:
                    for x, y in zip(counts, kept, strict=True):
                        x[0] += y[0]
                elif held:
                    folios, counts = held + folios, tuple(np.concatenate([y, x]) for x, y in zip(counts, kept, strict=True))
                held, kept = folios[-1:], tuple(x[-1:].copy() for x in counts)
                if len(folios) > 1:
                    yield rows_of(folios[:-1], tuple(x[:-1] for x in counts))
                start = stop
        if held:
            yield rows_of(held, kept)

    return run


def _by_page(texts: DataFrame, dealt: bool) -> tuple[DataFrame, str, pa.DataType]:
    """Rows of one folio are brought together, so that a page's items come once; the folio's type, for Spark and for Arrow."""
    kind = texts.schema["folio"].dataType.simpleString()
    texts = texts.select("folio", "all")
    together = (texts if dealt else texts.repartition("folio")).sortWithinPartitions("folio")
    return together, kind, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def page_items(texts: DataFrame, profile: Profile, cols: int, rows: int, dealt: bool = False) -> DataFrame:
    """(folio, kind, a, b, n, n0, n1, n2, n3) of ``Corpus.normalised`` texts; pages without glyphs have no rows.

    ``dealt``: the texts are of ``Corpus.by_page``, so those of one folio are in one partition.
    """
    together, kind, arrow = _by_page(texts, dealt)
    return together.mapInArrow(_counter(profile, cols, rows, _items(profile, cols, rows, arrow)), SCHEMA.format(kind))


def page_sums(texts: DataFrame, profile: Profile, cols: int, rows: int, min_count: int = 5, dealt: bool = False) -> DataFrame:
    """(folio, *SUMS): what all metrics of a page follow from, one row a page, of ``Corpus.normalised`` texts; pages without glyphs have no row.

    Items are summed where they are counted, so no row is made for an item of a page. ``dealt`` is as in ``page_items``.
    """
    together, kind, arrow = _by_page(texts, dealt)
    schema = ", ".join((f"folio {kind}", *(f"{c} {'long' if c in WHOLE else 'double'}" for c in SUMS)))
    return together.mapInArrow(_counter(profile, cols, rows, _sums(profile, cols, rows, arrow, min_count)), schema)
