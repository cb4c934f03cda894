"""Further queries: roll-ups of all kinds of counts, other differences and orders, manifests and run metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profiles import EVA_DISTINCT
from ..operators import compare as D
from ..operators import counts as C
from ..operators import grids as G
from ..operators import groups as R
from . import queries as Q
from .queries import GLYPH, LANG, _corpus, _r, _rounded, _table, _transitions, _words, query

ATTRIBUTES = R.attributes(R.DOCUMENTS)


def _labelled(spark, d) -> DataFrame:
    return _corpus(spark, d, labels=True).words()


# roll-ups by group


@query
def ngram_grouped_rollup(spark, d):
    return R.roll_up_attributes(C.ngrams(_labelled(spark, d), (1, 2), ATTRIBUTES), R.DOCUMENTS, ["n", "ngram"], ["cnt"])


@query
def wordpos_grouped_rollup(spark, d):
    return R.roll_up_attributes(C.word_positions(_labelled(spark, d), ATTRIBUTES), R.DOCUMENTS, ["glyph"], [*C.POSITIONS, "total"])


@query
def charpos_grouped_rollup(spark, d):
    return R.roll_up_attributes(C.length_profile(_labelled(spark, d), "line", 12, ATTRIBUTES), R.DOCUMENTS, ["glyph", "length", "pos"], ["n"])


@query
def pagepos_grouped_rollup(spark, d):
    cols, rows = G.TEXT_GRIDS["coarse"]
    grid = G.histogram(G.place(_labelled(spark, d), False), "x_page", "y_page", cols, rows, ATTRIBUTES)
    return R.roll_up_attributes(grid, R.DOCUMENTS, ["glyph", "col", "row"], ["n"])


# differences


@query
def unigram_diff(spark, d):
    rows = C.frequencies(C.ngrams(_words(spark, d).where("language in ('en', 'de')"), (1,), LANG), LANG)
    out = D.beyond(D.diff_of(rows, *Q.SIDES, ["ngram"], ["freq"]), "freq", 1e-4)
    return out.select(F.col("ngram").alias("glyph"), *(_r(f"freq_{x}") for x in ("a", "b", "diff")))


@query
def bigram_matrix_diff(spark, d):
    rows = C.ngrams(_words(spark, d).where("language in ('en', 'de')"), (1, 2), LANG)
    return D.dense_diff(C.frequencies(rows.where("n = 2"), LANG).select("language", F.substring("ngram", 1, 1).alias("a"), F.substring("ngram", 2, 1).alias("b"), "freq"), rows.where("n = 1").select("ngram").distinct(), "ngram", ("a", "b"), "freq", ("en", "de")).select("a", "b", *(_r(f"freq_{x}") for x in ("a", "b", "diff")))


@query
def markov_diff_dense(spark, d):
    rows = C.probabilities(_transitions(spark, d, word=True, line=True, para=True, page=True).where("language in ('en', 'de')"), LANG)
    tokens = C.charset(rows, ()).select("tok")
    return D.dense_diff(rows, tokens, "tok", ("from_tok", "to_tok"), "prob", ("en", "de")).select("from_tok", "to_tok", *(_r(f"prob_{x}") for x in ("a", "b", "diff")))


# orders


def _place(by: tuple[str, ...], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


@query
def wordpos_orders(spark, d):
    rows = C.position_ratios(C.word_positions(_words(spark, d), LANG))
    rows = D.canonical_order(rows, "glyph", EVA_DISTINCT)
    rows = rows.withColumns({f"{p}_ratio": F.round(f"{p}_ratio", 9) for p in C.POSITIONS})
    by = {"total": F.desc("total"), "start": F.desc("start_ratio"), "middle": F.desc("middle_ratio"), "end": F.desc("end_ratio"), "alpha": F.col("ord")}
    return rows.select("language", "glyph", *(_place(LANG, order, F.col("glyph")).alias(f"by_{k}") for k, order in by.items()))


@query
def charpos_line_ratios_dense(spark, d):
    rows = C.dense_profile(C.length_profile(_words(spark, d), "line", 12, LANG), 12, LANG)
    return rows.select("language", "glyph", "length", "pos", "n", _r("ratio"))


def _line_scores(spark, d) -> DataFrame:
    rows = C.profile_order(C.dense_profile(C.length_profile(_words(spark, d), "line", 12, LANG), 12, LANG), (4, 12), LANG)
    return rows.select("language", "glyph", *(_r(f"{x}_score") for x in ("start", "end", "position")))


@query
def charpos_line_order_score(spark, d):
    return _line_scores(spark, d)


@query
def charpos_compare_order(spark, d):
    rows = _line_scores(spark, d).where("language in ('en', 'de')")
    first = F.min(F.struct(F.col("language") != "en", "position_score"))["position_score"].alias("score")
    return rows.groupBy("glyph").agg(F.count_if(F.col("language") == "en").alias("in_a"), F.count_if(F.col("language") == "de").alias("in_b"), first).withColumn("rank", _place((), F.desc("score"), F.col("glyph")))


# selections


@query
def charpos_enabled_glyphs(spark, d):
    """Profiles of the glyphs that are switched on, and occur."""
    enabled = spark.createDataFrame([("o",), ("a",), ("7",), ("zz",)], "glyph string")
    rows = C.length_profile(_words(spark, d), "word", 9, LANG)
    return rows.join(F.broadcast(enabled), "glyph", "left_semi").select(*GLYPH, "length", "pos", "n")


@query
def glyph_selection(spark, d):
    """A selection that moves from one charset to another keeps its state; glyphs that are new are switched on."""
    rows = C.ngrams(_words(spark, d).where("language in ('en', 'fr')"), (1,), LANG)
    off = ("o", "t")
    return D.carry_selection(*(rows.where(F.col("language") == x).select(F.col("ngram").alias("glyph")) for x in ("en", "fr")), "glyph", off)


# pages


@query
def page_word_counts(spark, d):
    rows = _words(spark, d)
    return rows.groupBy("folio").agg(F.sum(F.size("words")).alias("word_count"), F.count_if(F.size("words") > 0).alias("line_count"))


@query
def charpos_total_chars(spark, d):
    """Glyphs of each page that stand within the first nine of their word."""
    return Q._page_items(spark, d).where(F.col("kind") == Q.P.NEAR).groupBy("folio").agg(F.sum("n").alias("total_chars"))


@query
def folio_metadata_left(spark, d):
    """Glyphs with pixel positions by page, with the attributes of pages that have any, "" for others."""
    glyphs, _ = Q._pixels(spark, d)
    counts = glyphs.groupBy("folio").agg(F.count("*").alias("glyphs"))
    known = _table(spark, d, "labels").select(F.col("doc_id").alias("folio"), F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return counts.join(known, "folio", "left").fillna("", ["quality", "toxic"])


@query
def page_metrics_attributes(spark, d):
    """All metrics of a page in one row, with the attributes that any of the joined tables has."""
    own = _corpus(spark, d).pages.select("folio", "language", "hand")
    tables = [t.join(own, "folio") for kind, t in Q.metric_tables(spark, d).items() if kind != "ngram"]
    return _rounded(Q.M.join_first(tables, ("language", "hand")))


# what a run leaves behind


@query
def run_metadata(spark, d):
    """One row: pages, and the values of their attributes in order."""
    pages = _corpus(spark, d, labels=True).pages
    values = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ",").alias(c)
    return pages.agg(F.count("*").alias("total_pages"), *(values(c) for c in ("language", "hand", "illustration")))


def _grid_manifest(spark, d) -> DataFrame:
    whole = G.extents(_words(spark, d)).agg(F.max("max_width").alias("g_width"), F.max("max_line").alias("g_line"))
    fixed = [(k, c, r) for k, (c, r) in G.TEXT_GRIDS.items()]
    names = spark.createDataFrame([*fixed, ("raw", None, None)], "resolution string, cols int, rows int")
    rows = names.join(F.broadcast(whole))
    return rows.select("resolution", F.coalesce("cols", "g_width").cast("int").alias("cols"), F.coalesce("rows", "g_line").cast("int").alias("rows"), F.col("cols").isNull().alias("absolute"))


@query
def grid_manifest(spark, d):
    """The grids' sizes; the raw one is as large as the corpus's longest line and page."""
    return _grid_manifest(spark, d)


@query
def grid_discovery(spark, d):
    """The resolutions and normalisations that can be shown: raw positions are absolute, so they have no page-relative form."""
    modes = spark.createDataFrame([("page",), ("manuscript",)], "mode string")
    rows = _grid_manifest(spark, d).join(F.broadcast(modes))
    return rows.where("mode = 'manuscript' or not absolute").select("resolution", "mode", "cols", "rows")


@query
def group_manifest_counts(spark, d):
    """Every group with its pages and glyphs, groups without pages included."""
    by = _labelled(spark, d).groupBy(*ATTRIBUTES).agg(F.count_if(F.col("line_idx") == 0).alias("page_count"), F.sum(F.length(F.array_join("words", ""))).alias("char_count"))
    found = R.roll_up_attributes(by, R.DOCUMENTS, [], ["page_count", "char_count"])
    rows = R.definitions(spark, R.DOCUMENTS).join(F.broadcast(found), "agg", "left")
    return rows.select("agg", "description", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("page_count", "char_count")))
