"""Queries of every operator over the document tables; ``oracle`` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scale as S
from ..functions import text as T
from ..functions.profiles import EVA_COLLAPSED, EVA_DISTINCT, IDENTITY
from ..operators import compare as D
from ..operators import counts as C
from ..operators import grids as G
from ..operators import groups as R
from ..operators import metrics as M
from ..operators import pages as P
from ..sources import corpus as K
from ..sources.shared import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LANG = ("language",)
GLYPH = ("language", "glyph")
#: The two sides that differences compare.
SIDES = ("language", ("en", "de"))


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str, labels: bool = False) -> K.Corpus:
    return K.from_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels") if labels else None)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).words()


def _r(c: str | Column, name: str | None = None) -> Column:
    return F.round(c, 6).alias(name or c)


# glyphs and n-grams


@query
def glyph_unigrams(spark, d):
    return C.ngrams(_words(spark, d), (1,), LANG).select("language", F.col("ngram").alias("glyph"), "cnt")


@query
def glyph_unigrams_identity(spark, d):
    return C.ngrams(_corpus(spark, d).words(IDENTITY), (1,), LANG).select("language", F.col("ngram").alias("glyph"), "cnt")


@query
def word_bigrams(spark, d):
    return C.ngrams(_words(spark, d), (2,), LANG).select("language", "ngram", "cnt")


@query
def trigrams_topk(spark, d):
    rows = C.ngrams(_words(spark, d), (3,), LANG)
    return C.top(rows, LANG, F.desc("cnt"), "ngram", 10).select("language", "ngram", "cnt", "rank")


@query
def ngram_min_count(spark, d):
    rows = C.frequencies(C.ngrams(_words(spark, d), by=LANG), LANG, 5)
    return rows.select("language", "n", "ngram", "cnt", "total", "uniq", _r("freq"))


@query
def ngram_frequencies(spark, d):
    rows = C.frequencies(C.ngrams(_words(spark, d), (1, 2), ("hand",)), ("hand",))
    return rows.select("hand", "n", "ngram", _r("freq"))


@query
def ngram_frequency_lookup(spark, d):
    rows = C.frequencies(C.ngrams(_words(spark, d), (1, 2, 3), LANG), LANG)
    wanted = spark.createDataFrame([("o",), ("on",), ("ont",), ("qqq",)], "ngram string").join(_corpus(spark, d).pages.select("language").distinct())
    return wanted.join(rows, ["language", "ngram"], "left").select("language", "ngram", F.round(F.coalesce("freq", F.lit(0.0)), 6).alias("freq"))


@query
def ngram_totals(spark, d):
    rows = C.ngrams(_words(spark, d), by=LANG)
    return rows.groupBy("language", "n").agg(F.sum("cnt").alias("total"), F.count("*").alias("uniq"))


@query
def bigram_matrix_dense(spark, d):
    return C.dense_bigrams(C.ngrams(_words(spark, d), (1, 2), LANG), LANG).select("language", "a", "b", "cnt", _r("freq"))


@query
def ngram_diff_topk(spark, d):
    rows = C.frequencies(C.ngrams(_words(spark, d).where("language in ('en', 'de')"), (3,), LANG), LANG, 5)
    out = D.beyond(D.diff_of(rows, *SIDES, ["ngram"], ["freq"]), "freq", 1e-5)
    out = out.select("ngram", *(_r(f"freq_{x}") for x in ("a", "b", "diff")))
    return C.top(out.withColumn("one", F.lit(1)), ("one",), F.desc(F.abs("freq_diff")), "ngram", 20).drop("one")


@query
def top_ngrams_then_min_count(spark, d):
    rows = C.ngrams(_words(spark, d), (2,), LANG)
    return C.top(rows, LANG, F.desc("cnt"), "ngram", 50).where("cnt >= 500").select("language", "ngram", "cnt", "rank")


@query
def web_page_unigrams(spark, d):
    return C.ngrams(K.from_web_pages(_table(spark, d, "pages")).words(IDENTITY), (1,), ()).select(F.col("ngram").alias("glyph"), "cnt")


# transitions


def _transitions(spark, d, **which) -> DataFrame:
    off = {"word": False, "line": False, "para": False, "page": False}
    return C.transitions(_words(spark, d), by=LANG, **(off | which))


def _borders(start: str, end: str) -> Column:
    return (F.col("from_tok") == start) | (F.col("to_tok") == end)


@query
def markov_intraword(spark, d):
    return _transitions(spark, d)


@query
def markov_word_boundary(spark, d):
    return _transitions(spark, d, word=True).where(_borders(T.WORD_START, T.WORD_END))


@query
def markov_line_boundary(spark, d):
    return _transitions(spark, d, line=True).where(_borders(T.LINE_START, T.LINE_END))


@query
def markov_para_boundary(spark, d):
    return _transitions(spark, d, para=True).where(_borders(T.PARA_START, T.PARA_END))


@query
def markov_page_boundary(spark, d):
    return _transitions(spark, d, page=True).where(_borders(T.PAGE_START, T.PAGE_END))


@query
def markov_probabilities(spark, d):
    rows = C.probabilities(_transitions(spark, d, word=True, line=True, para=True, page=True), LANG)
    return rows.select("language", "from_tok", "to_tok", "n", _r("prob"))


@query
def markov_charset(spark, d):
    return C.charset(_transitions(spark, d, word=True, line=True, para=True, page=True), LANG)


@query
def markov_grouped_rollup(spark, d):
    by = R.attributes(R.DOCUMENTS)
    return R.roll_up_attributes(C.transitions(_corpus(spark, d, labels=True).words(), by=by), R.DOCUMENTS, ["from_tok", "to_tok"], ["n"])


@query
def markov_diff(spark, d):
    rows = C.probabilities(_transitions(spark, d, word=True, line=True, para=True, page=True).where("language in ('en', 'de')"), LANG)
    out = D.diff_of(rows, *SIDES, ["from_tok", "to_tok"], ["n", "prob"])
    return out.select("from_tok", "to_tok", "n_a", "n_b", "n_diff", *(_r(f"prob_{x}") for x in ("a", "b", "diff")))


@query
def markov_max_abs_diff(spark, d):
    rows = C.probabilities(_transitions(spark, d, word=True, line=True, para=True, page=True).where("language in ('en', 'de')"), LANG)
    return D.greatest_difference(D.diff_of(rows, *SIDES, ["from_tok", "to_tok"], ["prob"]), "prob", 0.3).select(_r("max_abs_diff"))


@query
def markov_scaled_view(spark, d):
    rows = _transitions(spark, d, word=True).where(~F.col("from_tok").isin(*T.BORDERS) & ~F.col("to_tok").isin(*T.BORDERS))
    most = rows.groupBy("language").agg(F.max("n").alias("most"))
    rows = rows.join(most, "language")
    return rows.select("language", "from_tok", "to_tok", _r(F.col("n") / F.col("most"), "share"), _r(S.log_scale(F.col("n"), F.col("most")), "log_share"))


@query
def conversation_transitions(spark, d):
    return C.transitions(K.from_conversations(_table(spark, d, "conversations")).words(), by=())


@query
def markov_matrix_dense(spark, d):
    return C.dense_transitions(_transitions(spark, d, word=True, line=True, para=True, page=True), LANG)


@query
def charset_union(spark, d):
    rows = C.charset(_transitions(spark, d, word=True, line=True, para=True, page=True), LANG)
    return rows.groupBy("tok").agg(F.count_if(F.col("language") == "en").alias("in_en"), F.count_if(F.col("language") == "de").alias("in_de")).where("in_en + in_de > 0")


# positions in words and lines


@query
def wordpos_counts(spark, d):
    return C.word_positions(_words(spark, d), LANG)


@query
def wordpos_counts_min_length(spark, d):
    return C.word_positions(_words(spark, d), LANG, 3)


@query
def wordpos_ratios(spark, d):
    return C.position_ratios(C.word_positions(_words(spark, d), LANG)).select("language", "glyph", "total", *(_r(f"{p}_ratio") for p in C.POSITIONS))


@query
def wordpos_totals(spark, d):
    rows = C.word_positions(_words(spark, d), LANG)
    return rows.groupBy("language").agg(*(F.sum(p).alias(p) for p in (*C.POSITIONS, "total")))


@query
def wordpos_order_position(spark, d):
    rows = C.position_ratios(C.word_positions(_words(spark, d), LANG))
    rows = rows.select("language", "glyph", _r(F.col("start_ratio") - F.col("end_ratio"), "score"))
    return D.order_of(rows, ["language"], "score", "glyph")


@query
def wordpos_diff(spark, d):
    rows = C.position_ratios(C.word_positions(_words(spark, d).where("language in ('en', 'de')"), LANG))
    names = [f"{p}_ratio" for p in C.POSITIONS]
    out = D.tendency(D.diff_of(rows, *SIDES, ["glyph"], names), "start_ratio", 0.001)
    return out.select("glyph", *(_r(f"{m}_diff") for m in names), "tendency")


def _start_scores(spark, d) -> DataFrame:
    rows = C.position_ratios(C.word_positions(_words(spark, d), LANG))
    return rows.select("language", "glyph", "total", _r(F.col("start_ratio") - F.col("end_ratio"), "score"))


@query
def wordpos_compare_order(spark, d):
    rows = _start_scores(spark, d)
    side = lambda x: rows.where(F.col("language") == x).drop("language")
    return D.keep_order(side("de"), D.order_of(side("en"), [], "score", "glyph"), "glyph")


@query
def wordpos_diff_order(spark, d):
    rows = _start_scores(spark, d)
    return D.order_of(D.diff_of(rows, *SIDES, ["glyph"], ["score"]).select("glyph", _r("score_a"), _r("score_diff")), [], "score_a", "glyph")


@query
def charpos_word_profile(spark, d):
    return C.length_profile(_words(spark, d), "word", 9, LANG)


@query
def charpos_line_profile(spark, d):
    return C.length_profile(_words(spark, d), "line", 12, LANG)


@query
def charpos_ratios_dense(spark, d):
    rows = C.dense_profile(C.length_profile(_words(spark, d), "word", 9, LANG), 9, LANG)
    return rows.select("language", "glyph", "length", "pos", "n", _r("ratio"))


@query
def charpos_order_score(spark, d):
    rows = C.profile_order(C.dense_profile(C.length_profile(_words(spark, d), "word", 9, LANG), 9, LANG), (3, 9), LANG)
    return rows.select("language", "glyph", *(_r(f"{x}_score") for x in ("start", "end", "position")))


@query
def charpos_line_counts(spark, d):
    rows = _words(spark, d).where(F.size("words") > 0)
    return rows.groupBy("language").agg(F.count("*").alias("line_count"), F.sum(F.size("words")).alias("word_count"))


# positions on pages


def _placed(spark, d, corpus_wide: bool = False) -> DataFrame:
    return G.place(_words(spark, d), corpus_wide)


def _grid(spark, d, x: str, y: str, cols: int, rows: int) -> DataFrame:
    return G.histogram(_placed(spark, d, x == "x_ms"), x, y, cols, rows, LANG)


def _coarse(spark, d) -> DataFrame:
    return _grid(spark, d, "x_page", "y_page", *G.TEXT_GRIDS["coarse"])


@query
def page_extents(spark, d):
    return G.extents(_words(spark, d))


@query
def pagepos_grid_page_coarse(spark, d):
    return _coarse(spark, d)


@query
def pagepos_grid_page_fine(spark, d):
    return _grid(spark, d, "x_page", "y_page", *G.TEXT_GRIDS["fine"])


@query
def pagepos_grid_manuscript(spark, d):
    return _grid(spark, d, "x_ms", "y_ms", *G.TEXT_GRIDS["coarse"])


@query
def pagepos_raw_grid(spark, d):
    return G.raw_text_grid(_placed(spark, d, True), LANG)


@query
def pagepos_total_grid(spark, d):
    return G.total_grid(_coarse(spark, d), LANG)


@query
def pagepos_distribution(spark, d):
    return G.shares(_coarse(spark, d), GLYPH).select("language", "glyph", "col", "row", "n", _r("share"))


@query
def pagepos_dense_grid(spark, d):
    return G.dense(_coarse(spark, d), *G.TEXT_GRIDS["coarse"], GLYPH)


@query
def pagepos_diff(spark, d):
    rows = G.shares(_coarse(spark, d).where("glyph = 'o' and language in ('en', 'de')"), GLYPH)
    return D.diff_of(rows, *SIDES, ["col", "row"], ["share"]).select("col", "row", *(_r(f"share_{x}") for x in ("a", "b", "diff")))


@query
def pagepos_blur(spark, d):
    rows = G.blur(G.shares(_coarse(spark, d), GLYPH), *G.TEXT_GRIDS["coarse"], GLYPH)
    return rows.select("language", "glyph", "col", "row", _r("share"))


@query
def pagepos_blur_diff(spark, d):
    rows = G.shares(_coarse(spark, d).where("language in ('en', 'de')"), GLYPH)
    diff = D.diff_of(rows, *SIDES, ["glyph", "col", "row"], ["share"])
    rows = G.scaled_to_most(G.blur(diff, *G.TEXT_GRIDS["coarse"], ("glyph",), "share_diff"), ("glyph",), "share_diff")
    return rows.select("glyph", "col", "row", F.round("scaled", 4).alias("scaled"))


@query
def pagepos_clip(spark, d):
    return G.clip(_grid(spark, d, "x_page", "y_page", *G.TEXT_GRIDS["fine"]), 5, 5)


@query
def pagepos_region_label(spark, d):
    cols, rows = G.TEXT_GRIDS["fine"]
    grid = G.total_grid(_grid(spark, d, "x_page", "y_page", cols, rows), LANG)
    return grid.groupBy("language", S.region_label(F.col("col"), F.col("row"), cols, rows).alias("region")).agg(F.sum("n").alias("n"))


# pixel positions: documents have no page images, so boxes follow from the text


def document_boxes(words: DataFrame) -> DataFrame:
    """A box for each word: 12 pixels a character, 40 a line; pages end with their longest line.

    A word begins after a space of its line, which the line's characters tell in one go, so no row waits for others, and
    lines may be as long as their page.
    """
    chars = F.split(F.array_join("words", " "), "")
    begins = F.filter(F.transform(chars, lambda c, k: F.when(c == " ", k + 1)), lambda k: k.isNotNull())
    starts = F.concat(F.array(F.lit(0)), begins)
    rows = words.select("folio", "language", "line_idx", "boxes_width", "boxes_height", F.posexplode_outer(F.arrays_zip(F.col("words").alias("text"), starts.alias("start"))).alias("k", "w")).where("w.text is not null")
    text, start = F.col("w.text"), F.col("w.start")
    return rows.select("folio", "language", (F.col("line_idx") * 100000 + F.col("k")).cast("long").alias("word_idx"), (start * 12).alias("x"), (F.col("line_idx") * 40).alias("y"), (F.length(text) * 12).alias("width"), F.lit(30).alias("height"), text.alias("text"), F.col("boxes_width").alias("page_width"), F.col("boxes_height").alias("page_height"))


def _box_pages(spark, d) -> DataFrame:
    """Pages with their words by line and what their boxes take: the longest line, single marks between words, and the last one with words."""
    corpus = _corpus(spark, d)
    own = [c for c in corpus.texts.columns if c != "text"]
    rows = corpus.normalised().select(*own, F.split("all", "\n").alias("ls"))
    rows = rows.select(*own, F.explode_outer(F.array(F.transform("ls", T.split_words))).alias("lines"))
    size = lambda ws: F.length(F.array_join(ws, " "))
    last = F.array_max(F.transform("lines", lambda ws, k: F.when(F.size(ws) > 0, k)))
    return rows.select(*own, "lines", (F.array_max(F.transform("lines", size)) * 12).alias("boxes_width"), (last * 40 + 40).alias("boxes_height"))


def _pixels(spark, d) -> tuple[DataFrame, DataFrame]:
    """Glyphs, and the sizes of the pages that have boxes, which take no row for a box."""
    pages = _box_pages(spark, d)
    # words are normalised already, so only their alphabet is kept
    boxes = document_boxes(pages.select(*(c for c in pages.columns if c != "lines"), F.posexplode_outer("lines").alias("line_idx", "words")))
    sizes = pages.where("boxes_height is not null").select("folio", F.col("boxes_width").alias("page_width"), F.col("boxes_height").alias("page_height"))
    return G.glyph_boxes(boxes, None), sizes


def _pixel_points(spark, d) -> DataFrame:
    return G.place_boxes(*_pixels(spark, d))


@query
def physpos_interpolate(spark, d):
    glyphs, _ = _pixels(spark, d)
    return glyphs.groupBy("folio", "glyph").agg(F.count("*").alias("n"), _r(F.sum("x"), "sum_x"), _r(F.sum("y"), "sum_y"), _r(F.min("x"), "min_x"), _r(F.max("x"), "max_x"))


@query
def physpos_grid_page(spark, d):
    return G.histogram(_pixel_points(spark, d), "x_page", "y_page", *G.PIXEL_GRIDS["coarse"], LANG)


@query
def physpos_grid_manuscript(spark, d):
    return G.histogram(_pixel_points(spark, d), "x_ms", "y_ms", *G.PIXEL_GRIDS["fine"], LANG)


@query
def physpos_raw_grid(spark, d):
    return G.raw_pixel_grid(_pixel_points(spark, d), LANG)


@query
def metadata_match_rate(spark, d):
    boxes = _table(spark, d, "documents").select(F.col("doc_id").alias("folio"))
    return G.match_rate(boxes, _table(spark, d, "labels").select(F.col("doc_id").alias("folio")))


# groups


@query
def group_membership(spark, d):
    return R.membership(_corpus(spark, d, labels=True).pages, R.DOCUMENTS).select("agg", "folio")


@query
def group_manifest(spark, d):
    return R.manifest(_corpus(spark, d, labels=True).pages, R.DOCUMENTS)


@query
def group_overlap_stats(spark, d):
    return R.overlaps(_corpus(spark, d, labels=True).pages, R.DOCUMENTS, ["language", "hand", "illustration"])


@query
def group_contents(spark, d):
    return R.contents(_corpus(spark, d, labels=True).pages, R.DOCUMENTS)


@query
def group_subset(spark, d):
    chosen = R.select(R.DOCUMENTS, ["lang_fr", "nowhere", "en_toxic"])
    return R.manifest(_corpus(spark, d, labels=True).pages, chosen)


@query
def page_order(spark, d):
    pages = _corpus(spark, d).pages.withColumn("number", T.quire_number(F.col("quire")))
    return D.places(pages.select("number", "folio"), "number", "folio")  # places within a quire; quires by number


@query
def legend_colours(spark, d):
    return D.intern_colours(_corpus(spark, d).pages, "language", "folio")


@query
def distinct_domains(spark, d):
    return R.domains(_corpus(spark, d, labels=True).pages, ["language", "hand", "illustration"])


# page metrics


def _dealt(spark, d) -> DataFrame:
    """Normalised texts, dealt out by page before that: cores share the work however few parts the table's files can be read in."""
    return K.from_documents(_table(spark, d, "documents"), spread=False).by_page().normalised()


def _page_items(spark, d) -> DataFrame:
    return P.page_items(_dealt(spark, d), EVA_DISTINCT, *G.TEXT_GRIDS["coarse"], dealt=True)


def _page_metrics(spark, d) -> DataFrame:
    return M.page_metrics(P.page_sums(_dealt(spark, d), EVA_DISTINCT, *G.TEXT_GRIDS["coarse"], dealt=True), *G.TEXT_GRIDS["coarse"])


def _metrics(spark, d, kind: str) -> DataFrame:
    return _page_metrics(spark, d).select("folio", *M.KINDS[kind])


def metric_tables(spark, d) -> dict[str, DataFrame]:
    """A table of each kind of metrics; all come from one row a page, which is written first."""
    at = new_folder(spark, "page-metrics")
    _page_metrics(spark, d).write.parquet(at)
    return {kind: spark.read.parquet(at).select("folio", *names) for kind, names in M.KINDS.items()}


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.round(c, 6).alias(c) if kind == "double" else c for c, kind in rows.dtypes))


@query
def page_metrics_entropy(spark, d):
    return _rounded(_metrics(spark, d, "ngram"))


@query
def page_metrics_transition(spark, d):
    return _rounded(_metrics(spark, d, "markov"))


@query
def page_metrics_wordpos(spark, d):
    return _rounded(_metrics(spark, d, "wordpos"))


@query
def page_metrics_spatial(spark, d):
    return _rounded(_metrics(spark, d, "pagepos"))


@query
def page_metrics_full_join(spark, d):
    """All metrics of the pages that have any, from one pass of their text."""
    return _rounded(_page_metrics(spark, d))


@query
def metric_axis_extent(spark, d):
    return _rounded(D.axis_extent(_metrics(spark, d, "markov"), "transition_entropy"))


@query
def nearest_point(spark, d):
    return _rounded(D.nearest_point(_metrics(spark, d, "pagepos"), "page_center_x", "page_center_y", (0.45, 0.45), 0.5, "folio"))


# scalar functions


@query
def normalize_distinct(spark, d):
    return _words(spark, d).select("folio", "line_idx", "norm")


@query
def normalize_collapsed(spark, d):
    return _corpus(spark, d).words(EVA_COLLAPSED).select("folio", "line_idx", "norm")


@query
def display_expand(spark, d):
    rows = C.ngrams(_words(spark, d), (3,), ())
    return rows.select("ngram", T.expand_word(F.col("ngram")).alias("shown"))


@query
def border_names(spark, d):
    rows = C.charset(_transitions(spark, d, word=True, line=True, para=True, page=True), ()).where("border")
    return rows.select("tok", T.border_name(F.col("tok")).alias("name"), T.border_label(F.col("tok")).alias("label"))


@query
def ligature_clean(spark, d):
    marked = F.replace(F.col("text"), F.lit("ou"), F.lit("{o'u}"))
    return _table(spark, d, "documents").select("doc_id", F.md5(T.resolve_ligatures(marked).cast("binary")).alias("digest"))


@query
def uncertain_resolve(spark, d):
    marked = F.replace(F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("[e:o]")), F.lit("th"), F.lit("[?:th]")), F.lit("an"), F.lit("[???:?]"))
    return _table(spark, d, "documents").select("doc_id", F.md5(T.resolve_alternatives(marked).cast("binary")).alias("digest"))


@query
def markup_clean(spark, d):
    marked = F.replace(F.replace(F.replace(F.col("text"), F.lit("of"), F.lit("<!note>of<->")), F.lit("en"), F.lit("@254;en")), F.lit("in"), F.lit("<%>in<$>-/"))
    return _table(spark, d, "documents").select("doc_id", F.md5(T.strip_markup(T.strip_references(T.strip_comments(marked))).cast("binary")).alias("digest"))


@query
def joined_page_text(spark, d):
    return K.joined_text(_corpus(spark, d).lines).select("folio", F.md5(F.col("text").cast("binary")).alias("digest"))


@query
def quire_numbers(spark, d):
    return _corpus(spark, d).pages.select("folio", "quire", T.quire_number(F.col("quire")).alias("number"))


@query
def canonical_order(spark, d):
    rows = C.charset(_transitions(spark, d, word=True, line=True, para=True, page=True), ())
    return D.canonical_order(rows, "tok", EVA_DISTINCT).select("tok", F.col("ord").cast("int").alias("ord"))


@query
def log_scale(spark, d):
    rows = C.ngrams(_words(spark, d), (1,), LANG)
    most = rows.groupBy("language").agg(F.max("cnt").alias("most"))
    return rows.join(most, "language").select("language", F.col("ngram").alias("glyph"), _r(S.log_scale(F.col("cnt"), F.col("most")), "scaled"))


@query
def ratio_scaling(spark, d):
    rows = C.position_ratios(C.word_positions(_words(spark, d), LANG))
    return rows.select("language", "glyph", *(_r(S.ratio_scale(F.col("start_ratio"), k), k) for k in ("linear", "sqrt", "log")))


@query
def url_state(spark, d):
    rows = _table(spark, d, "pages").select("page_id", T.parse_state(F.concat(F.lit("#view=diff&a="), F.url_encode(F.col("url")), F.lit("&log=1"))).alias("m"))
    return rows.select("page_id", F.col("m")["view"].alias("view"), F.col("m")["a"].alias("a"), T.state_flag(F.col("m")["log"]).alias("log"), T.state_flag(F.try_element_at("m", F.lit("b"))).alias("b"))
