"""Queries of nested profiles, matrices, orders of names, places, metrics of several tables, colours, and a feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cli
from ..functions import scale as S
from ..functions import text as T
from ..functions.profiles import EVA_DISTINCT
from ..operators import compare as D
from ..operators import counts as C
from ..operators import groups as R
from ..sources import results as X
from ..sources.shared import new_folder
from ..streaming import pages as P
from . import queries as Q
from .more_queries import ATTRIBUTES
from .queries import LANG, _corpus, _rounded, _table, _transitions, _words, query
from .source_queries import transcription_page

TOKENS = tuple(EVA_DISTINCT.order)

# nested forms


@query
def profiles_nested_and_back(spark, d):
    rows = C.length_profile(_words(spark, d), "word", 9, LANG)
    return X.long_profile(X.ragged_profile(rows, ["language"]), ["language"])


@query
def profiles_merged(spark, d):
    """Ragged profiles of each source, added up by language."""
    rows = C.length_profile(_words(spark, d), "word", 9, ("language", "hand"))
    return X.long_profile(X.merged_profiles(X.ragged_profile(rows, ["language", "hand"]), ["language"]), ["language"])


@query
def markov_matrix_wide(spark, d):
    return X.matrix(_transitions(spark, d), "from_tok", "to_tok", "n", TOKENS, ["language"])


@query
def markov_matrix_wide_and_back(spark, d):
    return X.long_matrix(markov_matrix_wide(spark, d), "from_tok", "to_tok", "n", TOKENS, ["language"])


@query
def groups_written_and_read(spark, d):
    """Transitions of each group as JSON in a folder of its own, as viewers load them."""
    counts = R.roll_up_attributes(C.transitions(_corpus(spark, d, labels=True).words(), by=ATTRIBUTES), R.DOCUMENTS, ["from_tok", "to_tok"], ["n"])
    at = new_folder(spark, "groups")
    X.write(X.nested_transitions(counts, "agg"), at, "json", "agg")
    return X.long_transitions(X.read(spark, at, "json", "agg string, transitions map<string, bigint>"), "agg")


@query
def pages_written_and_read(spark, d):
    """Each page with its attributes and transitions as JSON, and what a reader finds there."""
    corpus = _corpus(spark, d, labels=True)
    counts = Q._page_items(spark, d).where(F.col("kind") == Q.P.PAIR).select("folio", F.col("a").alias("from_tok"), F.col("b").alias("to_tok"), "n")
    at = new_folder(spark, "pages")
    X.write(X.nested_transitions(counts, "folio").join(corpus.pages, "folio", "right"), at, "json")
    schema = "folio bigint, quire string, illustration string, language string, hand string, transitions map<string, bigint>"
    pages = X.read(spark, at, "json", schema)
    known = pages.select("folio", "quire", "illustration", "language", "hand")
    found = X.long_transitions(pages, "folio").groupBy("folio").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return known.join(found, "folio", "left").fillna(0, ["total", "kinds"])


@query
def ratio_profiles_nested_and_back(spark, d):
    rows = C.dense_profile(C.length_profile(_words(spark, d), "line", 12, LANG), 12, LANG)
    return X.long_profile(X.nested_profile(rows, "language"), ["language"], "ratio").withColumn("ratio", F.round("ratio", 6))


@query
def command_line_ngrams(spark, d):
    """What the command line makes of a transcription of all documents, for two of its groups."""
    at = new_folder(spark, "command-line")
    _table(spark, d, "documents").select(F.array_join(transcription_page(), "\n").alias("value")).write.text(f"{at}/in")
    args = cli.parser().parse_args(["ngram", "--input", f"{at}/in", "--output", f"{at}/out", "--aggregations", "all", "language_b", "--min-count", "1"])
    for name, rows in cli.tables(spark, args).items():
        if name in ("frequencies", "manifest"):
            X.write(rows, f"{at}/out/{name}")
    rows = spark.read.parquet(f"{at}/out/frequencies").join(spark.read.parquet(f"{at}/out/manifest"), "agg")
    return rows.select("agg", "page_count", "n", "ngram", "cnt", F.round("freq", 6).alias("freq"))


@query
def groups_in_display_order(spark, d):
    shown = {g.name: k for k, g in enumerate(R.display_order(R.DOCUMENTS), 1)}
    place = F.element_at(F.create_map(*(x for kv in shown.items() for x in map(F.lit, kv))), F.col("agg"))
    return R.manifest(_corpus(spark, d, labels=True).pages, R.DOCUMENTS).select("agg", place.alias("place"), "page_count")


# orders of names


def _names(spark, d) -> DataFrame:
    """Pages named as leaves with two sides, some of which have two parts."""
    k = F.col("doc_id")
    side = F.when(k % 2 == 0, "r").otherwise("v")
    name = F.concat(F.lit("f"), F.floor(k / 4) + 1, side, F.when(k % 4 >= 2, "2").otherwise(""))
    return _table(spark, d, "documents").select(name.alias("page"), F.chr(F.pmod("doc_id", F.lit(20)).cast("int") + 65).alias("quire"))


@query
def page_order_natural(spark, d):
    """Places in a quire by the number of the leaf, then by name: f2r before f10r."""
    rows = _names(spark, d).withColumn("key", T.natural_key(F.col("page")))
    return D.places(rows, "quire", "key").select("quire", "page", "place")


@query
def page_order_by_name(spark, d):
    """Places in a quire by name alone: f10r before f2r."""
    rows = _names(spark, d).withColumn("key", T.in_locale(F.col("page")))
    return D.places(rows, "quire", "key").select("quire", "page", "place")


@query
def folio_bases(spark, d):
    """A page's leaf, in both of the ways that it is taken."""
    page = F.col("page")
    return _names(spark, d).select("page", T.folio_base(page).alias("leaf"), T.folio_base(page, "trailing").alias("without_side"), T.folio_number(page).alias("number"))


# places


@query
def nearest_pages(spark, d):
    """For each page of an id divisible by 50 the page of any other id whose mean glyph lies closest to its own, within a tenth of the page."""
    scaled = lambda c: F.round(F.round(c, 6) * 1000000).cast("long")
    points = Q.metric_tables(spark, d)["pagepos"].select("folio", scaled("page_center_x").alias("x"), scaled("page_center_y").alias("y"))
    places = points.where("folio % 50 = 0").withColumnRenamed("folio", "place")
    return D.near_places(points.where("folio % 50 <> 0"), places, 100000, "folio", "place")


# several tables


@query
def page_metrics_first_table(spark, d):
    """All four kinds of metrics, each for some pages only, with the attributes of the first table that has the page."""
    every = {"ngram": 2, "markov": 3, "wordpos": 5, "pagepos": 1}
    own = _corpus(spark, d).pages.select("folio", "language")
    named = [t.where(F.col("folio") % every[name] == 0).join(own, "folio").withColumn("known_from", F.lit(name)) for name, t in Q.metric_tables(spark, d).items()]
    return _rounded(Q.M.join_first(named, ("language", "known_from")))


@query
def page_metrics_joined(spark, d):
    """All metrics of a page, each kind from a table of its own, joined."""
    return _rounded(Q.M.join_all(*Q.metric_tables(spark, d).values()))


@query
def box_glyphs_by_label(spark, d):
    """Glyphs with pixel positions by labels; pages without labels are in no group."""
    glyphs, _ = Q._pixels(spark, d)
    known = _table(spark, d, "labels").select(F.col("doc_id").alias("folio"), "quality", "toxic")
    rows = glyphs.groupBy("folio").agg(F.count("*").alias("glyphs")).join(known, "folio")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("pages"), F.sum("glyphs").alias("glyphs"))


# tokens, colours, states


@query
def tokens_with_separators(spark, d):
    """Glyphs and the marks between words."""
    rows = _corpus(spark, d).lines.select("language", F.explode(T.tokens(F.col("text"))).alias("tok"))
    return rows.groupBy("language", "tok").agg(F.count("*").alias("n"))


HEAT = [(0.0, (0, 0, 0)), (0.25, (40, 0, 80)), (1.0, (255, 240, 200))]
COLD = [(0.0, (0, 0, 0)), (1.0, (80, 160, 255))]


@query
def glyph_colours(spark, d):
    """Colours of glyphs by their share of the commonest one, and of the difference between two languages."""
    rows = C.ngrams(_words(spark, d), (1,), LANG)
    rows = rows.groupBy("ngram").agg(*(F.coalesce(F.max(F.when(F.col("language") == x, F.col("cnt"))), F.lit(0)).alias(x) for x in ("en", "de")))
    most = rows.agg(F.max("en").alias("most"), F.max(F.abs(F.col("en") - F.col("de"))).alias("apart"))
    rows = rows.join(F.broadcast(most))
    share = lambda v, m: F.coalesce(v / F.nullif(F.col(m), F.lit(0)), F.lit(0.0))
    code = lambda c: F.array_join(c, ",")
    return rows.select(F.col("ngram").alias("glyph"), code(S.ramp(share(F.col("en"), "most"), HEAT)).alias("colour"), code(S.signed_ramp(share(F.col("en") - F.col("de"), "apart"), COLD, HEAT)).alias("diff_colour"))


@query
def cell_pixels(spark, d):
    """Where the cells of the pixel grid begin on the largest page."""
    glyphs, sizes = Q._pixels(spark, d)
    whole = sizes.agg(F.max("page_width").alias("g_width"), F.max("page_height").alias("g_height"))
    raw = Q.G.raw_pixel_grid(Q.G.place_boxes(glyphs, sizes), LANG).groupBy("col", "row").agg(F.sum("n").alias("n"))
    rows = raw.join(F.broadcast(whole))
    return rows.select("col", "row", "n", S.cell_pixel(F.col("col"), 100, F.col("g_width")).alias("x"), S.cell_pixel(F.col("row"), 150, F.col("g_height")).alias("y"))


@query
def url_state_formatted(spark, d):
    """States as parts of an address; empty values are left out."""
    state = F.create_map(F.lit("view"), F.lit("diff"), F.lit("page"), F.col("url"), F.lit("log"), F.when(F.col("page_id") % 2 == 0, "1").otherwise(""))
    return _table(spark, d, "pages").select("page_id", T.format_state(state).alias("state"))


# a feed


#: Bytes of files that a batch of the feed takes.
FEED_BATCH = 256 << 20


def _line_feed(spark, d) -> tuple[DataFrame, Callable[[int], DataFrame]]:
    turns = _table(spark, d, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"), F.min("turn").alias("first"))
    rows = turns.join(last, "conv_id")
    at = F.timestamp_seconds(F.lit(1700000000) + F.col("conv_id") * 60 + F.col("turn"))
    lines = rows.select(F.col("conv_id").cast("string").alias("folio"), at.alias("at"), F.col("turn").cast("int").alias("line_idx"), (F.col("turn") == F.col("first")).alias("para_start"), (F.col("turn") == F.col("last")).alias("para_end"), "text")
    end = lambda k: spark.range(1).select(F.lit(f"end {k}").alias("folio"), F.timestamp_seconds(F.lit(4000000000 + k * 100000000)).alias("at"), F.lit(0).alias("line_idx"), F.lit(False).alias("para_start"), F.lit(False).alias("para_end"), F.lit("").alias("text"))
    return lines, end


@query
def feed_transitions(spark, d):
    """Conversations as a feed of lines in files, read by a stream; two late lines close all pages.

    A batch takes files up to a size, so batches follow the feed's size and not the number of its files: each one
    opens and keeps the state of all pages.
    """
    lines, end = _line_feed(spark, d)
    at = new_folder(spark, "feed")
    lines.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{at}/lines")  # a batch's files are read by all cores
    for k in range(2):
        end(k).write.mode("append").parquet(f"{at}/lines")
    feed = spark.readStream.schema(lines.schema).option("maxBytesPerTrigger", FEED_BATCH).parquet(f"{at}/lines")
    items = P.running_items(feed, (), delay="3650 days", gap="1 day")
    stream = items.writeStream.format("parquet").option("path", f"{at}/items").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    found = spark.read.schema("w string, m long").parquet(f"{at}/items").groupBy("w").agg(F.sum("m").alias("m"))
    return C.transitions_of(found, ())
