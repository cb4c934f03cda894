"""Corpora: pages with attributes, and lines with flags, from transcriptions or ordinary tables.

pages: folio, quire, illustration, language, hand (strings but the key; "" if missing)
lines: folio, line_idx, line_num, para_start, para_end, text
texts, where a page is one row of a table: folio, further attributes, text with line ends
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import EVA_DISTINCT, Profile
from . import transcription


@dataclass(frozen=True)
class Corpus:
    pages: DataFrame
    lines: DataFrame
    texts: DataFrame | None = None

    def by_page(self) -> Corpus:
        """Texts dealt out by page: one shuffle of them, which all later counts and windows by page use, in place of one of each table of counts.

        The number of parts is given, so that Spark doesn't merge them by their bytes, into hardly more than there are
        cores: what is done with a text takes far longer than reading it.
        """
        if self.texts is None:
            return self
        parts = int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return replace(self, texts=self.texts.repartition(parts, "folio"))

    def normalised(self, profile: Profile = EVA_DISTINCT) -> DataFrame:
        """Texts with their normalised form (all), line ends and separators kept, in place of the text."""
        own = [c for c in self.texts.columns if c != "text"]
        return self.texts.select(*own, T.normalise(T.part_letters(F.col("text"), lines=True), profile, lines=True).alias("all"))

    def words(self, profile: Profile = EVA_DISTINCT) -> DataFrame:
        """lines with ``norm`` (normalised, separators kept) and ``words`` (array), without their text.

        Where pages are rows, a page is normalised at once before it is parted into lines, which carry what
        only a whole page knows: page_first and page_last (glyphs at its borders, "" if there are none),
        min_line, max_line and max_width. Elsewhere these take a shuffle by page.
        """
        if self.texts is None:
            norm = self.lines.withColumn("norm", T.normalise(F.col("text"), profile)).drop("text")
            return norm.withColumn("words", T.split_words(F.col("norm")))
        own = [c for c in self.texts.columns if c != "text"]
        rows = self.normalised(profile)
        rows = rows.select(*own, F.split("all", "\n").alias("ls"), F.left(T.solid(F.col("all")), F.lit(1)).alias("page_first"))
        width = F.array_max(F.transform("ls", lambda x: F.length(T.solid(x))))
        last = F.right(T.solid(F.element_at("ls", -1)), F.lit(1))
        # an outer explode: for an inner one the optimiser tests the array's size below, and so makes it twice
        rows = rows.select(*own, "page_first", last.alias("page_last"), F.size("ls").alias("max_line"), width.alias("max_width"), "ls")
        rows = rows.select(*(c for c in rows.columns if c != "ls"), F.posexplode_outer("ls").alias("line_idx", "norm"))
        flags = ((F.col("line_idx") + 1).alias("line_num"), (F.col("line_idx") == 0).alias("para_start"), (F.col("line_idx") == F.col("max_line") - 1).alias("para_end"))
        return rows.select(*own, "line_idx", *flags, "norm", T.split_words(F.col("norm")).alias("words"), "page_first", "page_last", F.lit(1).alias("min_line"), "max_line", "max_width")


def from_transcription(spark: SparkSession, path: str) -> Corpus:
    return Corpus(transcription.read_pages(spark, path), transcription.read_lines(spark, path))


def _spread(rows: DataFrame) -> DataFrame:
    """A table of fewer parts than half the cluster's cores, so a small one, is dealt out to all of them."""
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def _prose_lines(rows: DataFrame, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = rows.select("folio", *carry, F.size(lines).alias("n"), F.posexplode(lines).alias("line_idx", "line"))
    return rows.select("folio", *carry, "line_idx", (F.col("line_idx") + 1).alias("line_num"), (F.col("line_idx") == 0).alias("para_start"), (F.col("line_idx") == F.col("n") - 1).alias("para_end"), T.part_letters(F.col("line")).alias("text"))


def from_documents(docs: DataFrame, labels: DataFrame | None = None, spread: bool = True) -> Corpus:
    """Each document is a page and a paragraph: language from ``lang``, hand from ``source``.

    The quire is the letter of doc_id modulo 20. Labels, if given, make the illustration: ``q`` and ``t``
    with quality and toxicity, "" for documents without labels. Lines carry the attributes, so that counts
    by these need no join. ``spread`` deals out small tables; it looks at the table's parts, which runs what
    leads up to them if that isn't a plain scan.
    """
    known = docs.select(F.col("doc_id").alias("folio"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("hand"), F.chr(F.pmod("doc_id", F.lit(20)).cast("int") + 65).alias("quire"))
    if labels is None:
        pages = known.withColumn("illustration", F.lit(""))
    else:
        code = labels.select(F.col("doc_id").alias("folio"), F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("illustration"))
        pages = known.join(code, "folio", "left").withColumn("illustration", F.coalesce("illustration", F.lit("")))
    rows = docs.select(F.col("doc_id").alias("folio"), F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("hand"), F.chr(F.pmod("doc_id", F.lit(20)).cast("int") + 65).alias("quire"), "text")
    if labels is not None:
        rows = rows.join(code, "folio", "left").withColumn("illustration", F.coalesce("illustration", F.lit("")))
    return Corpus(pages, _prose_lines(rows, "text", ("language", "hand")), _spread(rows) if spread else rows)


def from_conversations(turns: DataFrame) -> Corpus:
    """Each conversation is a page, each turn a line; the hand is the role of the first turn."""
    ends = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.min_by("role", "turn").alias("hand"))
    pages = ends.select(F.col("conv_id").alias("folio"), F.lit("").alias("quire"), F.lit("").alias("illustration"), F.lit("").alias("language"), "hand")
    lines = turns.join(ends, "conv_id").select(F.col("conv_id").alias("folio"), F.col("turn").cast("int").alias("line_idx"), (F.col("turn") + 1).cast("int").alias("line_num"), (F.col("turn") == F.col("first")).alias("para_start"), (F.col("turn") == F.col("last")).alias("para_end"), T.part_letters(F.col("text")).alias("text"))
    return Corpus(pages, lines)


def from_web_pages(web: DataFrame) -> Corpus:
    """Each web page is a page, its markup stripped; block elements end lines."""
    body = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", " ")
    rows = web.select(F.col("page_id").alias("folio"), body.alias("body"))
    pages = rows.select("folio", *(F.lit("").alias(c) for c in ("quire", "illustration", "language", "hand")))
    return Corpus(pages, _prose_lines(rows, "body"), rows.withColumnRenamed("body", "text"))


def joined_text(lines: DataFrame, by: str = " ") -> DataFrame:
    """(folio, text): the lines of each page in order."""
    return lines.groupBy("folio").agg(T.join_lines(F.col("text"), F.col("line_idx"), by).alias("text"))
