"""Two-dimensional histograms of glyph positions, in text and in pixel coordinates.

Points are binned by page before any roll-up: a cell depends on the page's and the corpus's
extents alone, never on the group, so groups are sums of small histograms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import EVA_DISTINCT, Profile
from ..functions.scale import clamp

# Columns and rows of the grids.
TEXT_GRIDS = {"coarse": (5, 10), "fine": (10, 20)}
PIXEL_GRIDS = {"coarse": (10, 15), "fine": (20, 30), "raw": (100, 150)}


def _solid(col: str = "norm") -> Column:
    return T.solid(F.col(col))


def extents(words: DataFrame) -> DataFrame:
    """(folio, min_line, max_line, max_width, line_count) over all lines, those without glyphs too."""
    if "max_width" in words.columns:
        return words.where("line_idx = 0").select("folio", "min_line", "max_line", "max_width", F.col("max_line").cast("long").alias("line_count"))
    return words.groupBy("folio").agg(F.min("line_num").alias("min_line"), F.max("line_num").alias("max_line"), F.max(F.length(_solid())).alias("max_width"), F.count("*").alias("line_count"))


def points(words: DataFrame) -> DataFrame:
    """(folio, glyph, line_num, char_idx) of every glyph; places count glyphs only."""
    return words.select("folio", "line_num", F.posexplode(T.glyphs(_solid())).alias("char_idx", "glyph"))


def place(words: DataFrame, corpus_wide: bool = True) -> DataFrame:
    """Points with x and y in the page (x_page, y_page) and, if asked for, in the corpus (x_ms, y_ms); the lines' other columns stay.

    Extents are attached to lines, before glyphs are exploded: lines carry them where pages are rows;
    else it takes one shuffle of lines by page, which counts by page use again. Extents of the corpus are
    one row, and cost a pass of their own.
    """
    page = Window.partitionBy("folio")
    lines = words.withColumn("solid", _solid()).drop("norm", "words", "line_idx", "para_start", "para_end", "page_first", "page_last")
    if "max_width" not in words.columns:
        lines = lines.withColumns({"min_line": F.min("line_num").over(page), "max_line": F.max("line_num").over(page), "max_width": F.max(F.length("solid")).over(page)})
    rows = lines.select(*[c for c in lines.columns if c != "solid"], F.posexplode_outer(T.glyphs(F.col("solid"))).alias("char_idx", "glyph")).where("glyph is not null")
    share = lambda v, most: v / F.nullif(most, F.lit(0))
    half, idx, line = F.lit(0.5), F.col("char_idx"), F.col("line_num")
    rows = rows.withColumns({
        "y_page": F.when(F.col("max_line") > F.col("min_line"), share(line - F.col("min_line"), F.col("max_line") - F.col("min_line"))).otherwise(half),
        "x_page": F.when(F.col("max_width") > 0, share(idx, F.col("max_width"))).otherwise(half),
    })
    if not corpus_wide:
        return rows
    wide = F.col("max_width") if "max_width" in words.columns else F.length(_solid())
    whole = words.agg(F.max("line_num").alias("g_line"), F.max(wide).alias("g_width"))
    return rows.join(F.broadcast(whole)).withColumns({
        "y_ms": F.when(F.col("g_line") > 1, share(line - 1, F.col("g_line"))).otherwise(half),
        "x_ms": F.when(F.col("g_width") > 0, share(idx, F.col("g_width"))).otherwise(half),
    })


def cell(v: Column, n: int) -> Column:
    return F.least(F.floor(v * n), F.lit(n - 1)).cast("int")


def histogram(placed: DataFrame, x: str, y: str, cols: int, rows: int, by: tuple[str, ...] = ("folio",)) -> DataFrame:
    """(*by, glyph, col, row, n)."""
    cells = placed.select(*by, "glyph", cell(F.col(x), cols).alias("col"), cell(F.col(y), rows).alias("row"))
    return cells.groupBy(*by, "glyph", "col", "row").agg(F.count("*").alias("n"))


def raw_text_grid(placed: DataFrame, by: tuple[str, ...] = ("folio",)) -> DataFrame:
    """One column for each place and one row for each line number, as many as the corpus has."""
    cells = placed.select(*by, "glyph", F.least("char_idx", F.col("g_width") - 1).cast("int").alias("col"), F.least(F.col("line_num") - 1, F.col("g_line") - 1).cast("int").alias("row"))
    return cells.groupBy(*by, "glyph", "col", "row").agg(F.count("*").alias("n"))


def total_grid(grid: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return grid.groupBy(*by, "col", "row").agg(F.sum("n").cast("long").alias("n"))


def shares(grid: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Cells over the sum of their grid."""
    return grid.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def clip(grid: DataFrame, cols: int, rows: int) -> DataFrame:
    return grid.where((F.col("col") < cols) & (F.col("row") < rows))


def dense(grid: DataFrame, cols: int, rows: int, by: tuple[str, ...], value: str = "n") -> DataFrame:
    """All cells of every grid, zeros included; cells outside are dropped."""
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.struct(c.cast("int").alias("col"), r.cast("int").alias("row")))))
    cells = grid.select(*by).distinct().withColumn("c", F.explode(every)).select(*by, "c.*")
    return cells.join(grid.select(*by, "col", "row", value), [*by, "col", "row"], "left").fillna(0, [value])


def kernel(size: int) -> list[list[float]]:
    """A Gaussian of odd size with sigma size / 2.5 and sum 1."""
    sigma, mid = size / 2.5, size // 2
    raw = [[math.exp(-((x - mid) ** 2 + (y - mid) ** 2) / (2 * sigma * sigma)) for x in range(size)] for y in range(size)]
    total = sum(map(sum, raw))
    return [[v / total for v in row] for row in raw]


def blur(grid: DataFrame, cols: int, rows: int, by: tuple[str, ...], value: str = "share", size: int = 3) -> DataFrame:
    """Each cell is spread over its neighbours; what falls off the edge is lost. Clip first."""
    mid = size // 2
    spread = F.array(*(F.struct(F.lit(x - mid).alias("dx"), F.lit(y - mid).alias("dy"), F.lit(v).alias("w")) for y, row in enumerate(kernel(size)) for x, v in enumerate(row)))
    rows_ = clip(grid, cols, rows).withColumn("k", F.explode(spread)).select(*by, (F.col("col") + F.col("k.dx")).alias("col"), (F.col("row") + F.col("k.dy")).alias("row"), (F.col(value) * F.col("k.w")).alias(value))
    inside = F.col("col").between(0, cols - 1) & F.col("row").between(0, rows - 1)
    return rows_.where(inside).groupBy(*by, "col", "row").agg(F.sum(value).alias(value))


def scaled_to_most(grid: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Values over the greatest absolute one of their grid."""
    most = F.max(F.abs(F.col(value))).over(Window.partitionBy(*by))
    return grid.withColumn("scaled", F.coalesce(F.col(value) / F.nullif(most, F.lit(0.0)), F.lit(0.0)))


# pixel coordinates


def glyph_boxes(boxes: DataFrame, profile: Profile | None = EVA_DISTINCT) -> DataFrame:
    """(folio, page_width, page_height, glyph, x, y) and the boxes' other columns: glyphs share their word's width evenly and stand at its mid height.

    Without a profile the words count as normalised.
    """
    rows = _with_glyphs(boxes, profile)
    other = _further(boxes)
    rows = rows.select("folio", "page_width", "page_height", *other, "x", "y", "width", "height", F.length("g").alias("k"), F.posexplode(T.glyphs(F.col("g"))).alias("i", "glyph"))
    return rows.select("folio", "page_width", "page_height", *other, "glyph", _glyph_x(F.col("i"), F.col("k")).alias("x"), _mid_height().alias("y"))


def _with_glyphs(boxes: DataFrame, profile: Profile | None) -> DataFrame:
    text = F.col("text") if profile is None else T.normalise(F.col("text"), profile, separators=False)
    return boxes.withColumn("g", text).where("g <> ''")


def _further(boxes: DataFrame) -> list[str]:
    return [c for c in boxes.columns if c not in ("folio", "page_width", "page_height", "word_idx", "x", "y", "width", "height", "text")]


def _glyph_x(i: Column, k: Column) -> Column:
    return F.col("x") + (i + 0.5) * (F.col("width") / k)


def _mid_height() -> Column:
    return F.col("y") + F.col("height") / 2


def glyph_extents(boxes: DataFrame, profile: Profile | None = EVA_DISTINCT) -> DataFrame:
    """(folio, page_width, page_height, glyphs, min_x, max_x, y) and the boxes' other columns: a row for each box that ``glyph_boxes``
    has glyphs of, with their number and extents, which are those of its first and last glyph."""
    k = F.length("g")
    first, last = _glyph_x(F.lit(0), k), _glyph_x(k - 1, k)
    return _with_glyphs(boxes, profile).select("folio", "page_width", "page_height", *_further(boxes), k.cast("long").alias("glyphs"), F.least(first, last).alias("min_x"), F.greatest(first, last).alias("max_x"), _mid_height().alias("y"))


def place_boxes(glyphs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixel points in shares of their page and of the largest page, from 0 to 1; ``sizes`` are boxes or pages that have any."""
    whole = sizes.agg(F.max("page_width").alias("g_width"), F.max("page_height").alias("g_height"))
    share = lambda v, most: clamp(F.when(F.col(most) > 0, F.col(v) / F.nullif(F.col(most), F.lit(0))).otherwise(0.5))
    rows = glyphs.join(F.broadcast(whole))
    return rows.withColumns({"x_page": share("x", "page_width"), "y_page": share("y", "page_height"), "x_ms": share("x", "g_width"), "y_ms": share("y", "g_height")})


def raw_pixel_grid(placed: DataFrame, by: tuple[str, ...] = ("folio",), cols: int = 100, rows: int = 150) -> DataFrame:
    """Whole pixels in a fixed grid over the largest page."""
    at = lambda v, most, n: F.when(F.col(most) > 0, F.least(F.floor(F.col(v).cast("int") / F.nullif(F.col(most), F.lit(0)) * n), F.lit(n - 1))).otherwise(0).cast("int")
    cells = placed.select(*by, "glyph", at("x", "g_width", cols).alias("col"), at("y", "g_height", rows).alias("row"))
    return cells.groupBy(*by, "glyph", "col", "row").agg(F.count("*").alias("n"))


def match_rate(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(folios, matched): pages with boxes, and those of them with attributes."""
    folios = boxes.select("folio").distinct()
    known = pages.select("folio").distinct().withColumn("known", F.lit(1))
    return folios.join(known, "folio", "left").agg(F.count("*").alias("folios"), F.count("known").alias("matched"))
