"""Transitions of pages whose lines arrive one by one, out of order, late, or twice.

Inside a line nothing waits: its transitions leave as soon as it comes. The first and last glyph of a page
are known when the page is closed, which the watermark does: a page's lines are one session of the feed, and
a session that has been quiet for ``gap`` is closed once the watermark, ``delay`` behind the latest line,
has passed its end. State is a line's key for ``delay``, and two glyphs with their places for each open
page, however long the page.

Lines have folio, at (timestamp), line_idx, para_start, para_end, text, and further attributes of the page.
Lines that come after the watermark has passed them are dropped, as are repetitions of a (folio, line_idx)
within ``delay``. A page that is quiet for longer than ``gap`` and goes on counts as two for its borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import EVA_DISTINCT, Profile
from ..operators import counts as C


def prepared(lines: DataFrame, profile: Profile = EVA_DISTINCT) -> DataFrame:
    """Lines with norm and words in place of their text."""
    rows = lines.withColumn("norm", T.normalise(T.part_letters(F.col("text")), profile)).drop("text")
    return rows.withColumn("words", T.split_words(F.col("norm")))


def page_ends(lines: DataFrame, by: tuple[str, ...], gap: str) -> DataFrame:
    """(*by, w, m): the borders of pages as items, once a page is closed. ``lines`` are ``prepared`` and have a watermark."""
    solid = T.solid(F.col("norm"))
    full = F.size("words") > 0
    first = F.min_by(F.when(full, F.left(solid, F.lit(1))), F.when(full, F.col("line_idx"))).alias("first")
    last = F.max_by(F.right(solid, F.lit(1)), "line_idx").alias("last")
    pages = lines.groupBy(F.session_window("at", gap).alias("open"), *dict.fromkeys(("folio", *by))).agg(first, last)
    ends = F.array(F.when(F.col("first") != "", C.border(F.lit(T.PAGE_START), F.col("first"))), F.when(F.col("last") != "", C.border(F.col("last"), F.lit(T.PAGE_END))))
    return pages.select(*by, F.explode(ends).alias("w")).where("w is not null").withColumn("m", F.lit(1).cast("long"))


def running_items(lines: DataFrame, by: tuple[str, ...] = ("folio",), *, delay: str, gap: str, profile: Profile = EVA_DISTINCT) -> DataFrame:
    """(*by, w, m) of a streaming DataFrame of lines, for append mode: items as in ``item_counts``, one for each occurrence.

    Their sums are those of the whole corpus when all pages are closed, and give all statistics of glyphs.
    """
    once = prepared(lines.withWatermark("at", delay).dropDuplicatesWithinWatermark(["folio", "line_idx"]), profile)
    inner = C.item_counts(once, by, page=False, summed=False)
    return inner.unionByName(page_ends(once, by, gap))
