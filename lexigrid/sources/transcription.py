"""Line-oriented transcriptions: page headers with variables, comments, and loci of text.

A line belongs to the last header before it. Large files are read in many tasks: each reads the lines of a
block, numbers the headers within it, and adds the headers of the blocks before, of which there is
a row of counts for each block. No task sees more than a block of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_line

# The format's line patterns and page variables.
HEADER = r"^<(f\d+[rv]\d*)>\s*(?:<!\s*(.+?)\s*>)?"
LOCUS = r"^<(f\d+[rv]\d*\.\d+),([*@+=])([A-Za-z0-9]+)(?:;[A-Z])?>(.*)$"
OVERRIDE = r"(?i)^#\s*currier'?s?\s+language\s+([ab]),?\s*hand\s+(\d+)"
VARIABLES = {"quire": "Q", "page_in_quire": "P", "illustration": "I", "language": "L", "hand": "H", "bifolio": "B"}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line) of text files: lines in the order of block, where a task began to read, and at.

    Numbers within a block grow with the place in it, whatever else the task reads.
    """
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def classified(lines: DataFrame) -> DataFrame:
    """Non-empty lines with the number of the page they belong to in their file (0: none yet).

    Lines without blocks are of one each file. What is no header, locus or comment on a page isn't needed and goes.
    """
    text = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0).cast("long"))
    text = text.where(F.col("line").rlike(HEADER) | F.col("line").rlike(LOCUS) | F.col("line").rlike(OVERRIDE)).withColumn("header", F.col("line").rlike(HEADER))
    counts = text.groupBy("file", "block").agg(F.count_if("header").alias("headers"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("earlier"))
    upto = Window.partitionBy("file", "block").orderBy("at")
    rows = text.withColumn("within", F.count_if("header").over(upto)).join(starts, ["file", "block"])
    return rows.select("file", F.struct("block", "at").alias("at"), "line", "header", (F.col("earlier") + F.col("within")).alias("page_idx"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``pages_of`` the files of ``path``."""
    return pages_of(classified(scan(spark, path)))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``lines_of`` the files of ``path``."""
    return lines_of(classified(scan(spark, path)))


def pages_of(rows: DataFrame) -> DataFrame:
    """(file, page_idx, folio, quire, page_in_quire, illustration, language, hand, bifolio): strings, "" if missing.

    The last comment that names language and hand overrides the header's variables.
    """
    rows = rows.where("page_idx > 0")
    variables = F.regexp_extract("line", HEADER, 2)
    last = lambda key: F.coalesce(F.try_element_at(F.regexp_extract_all(variables, F.lit(rf"\${key}=([A-Za-z0-9]+)"), F.lit(1)), F.lit(-1)), F.lit(""))
    heads = rows.where("header").select("file", "page_idx", F.regexp_extract("line", HEADER, 1).alias("folio"), *(last(k).alias(name) for name, k in VARIABLES.items()))
    said = rows.where(F.col("line").rlike(OVERRIDE))
    newest = said.groupBy("file", "page_idx").agg(F.max_by("line", "at").alias("line")).select("file", "page_idx", F.upper(F.regexp_extract("line", OVERRIDE, 1)).alias("l"), F.regexp_extract("line", OVERRIDE, 2).alias("h"))
    out = heads.join(newest, ["file", "page_idx"], "left")
    return out.withColumn("language", F.coalesce("l", "language")).withColumn("hand", F.coalesce("h", "hand")).drop("l", "h")


def lines_of(rows: DataFrame) -> DataFrame:
    """(file, page_idx, folio, line_idx, line_num, locus_type, para_start, para_end, text) of paragraph loci with text."""
    rows = rows.where("page_idx > 0")
    folios = rows.where("header").select("file", "page_idx", F.regexp_extract("line", HEADER, 1).alias("folio"))
    rows = rows.where(~F.col("header") & F.col("line").rlike(LOCUS) & ~F.col("line").startswith("#"))
    part = lambda k: F.regexp_extract("line", LOCUS, k)
    rows = rows.select("file", "page_idx", "at", F.regexp_extract(part(1), r"\.(\d+)", 1).cast("int").alias("line_num"), part(3).alias("locus_type"), (part(4).contains("<%>") | (part(2) == "*")).alias("para_start"), part(4).contains("<$>").alias("para_end"), clean_line(part(4)).alias("text"))
    rows = rows.where(F.col("locus_type").startswith("P") & (F.col("text") != "")).join(folios, ["file", "page_idx"])
    order = Window.partitionBy("file", "page_idx").orderBy("at")
    return rows.withColumn("line_idx", F.row_number().over(order) - 1).select("file", "page_idx", "folio", "line_idx", "line_num", "locus_type", "para_start", "para_end", "text")


def find_pages(names: DataFrame, pages: DataFrame, key: str = "name") -> DataFrame:
    """Pages by name, with or without its leading f."""
    bare = F.regexp_replace(F.col(key), "^f", "")
    return names.withColumn("_bare", bare).join(pages.withColumn("_bare", F.regexp_replace("folio", "^f", "")), "_bare", "left").drop("_bare")
