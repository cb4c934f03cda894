"""Word boxes of page images: XML files of a folder, or of zip archives.

Pages are a table first, with what can't be read named in it: (file, member, xml, error). A page that isn't
well-formed, or has a value that is no number where one belongs, gives no boxes, nor does a file that can't be
decoded; ``unreadable`` lists them, and ``counted`` counts them while boxes are made.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import archives

# The elements' attributes; a page of one word must still be a list.
SCHEMA = "_name string, _width int, _height int, _wordCount int, word array<struct<_index int, _x int, _y int, _width int, _height int, _VALUE string>>"
MALFORMED = "not well-formed, or a value of another kind"


def folder_pages(spark: SparkSession, path: str) -> DataFrame:
    """The ``*.xml`` files of a folder; those of no bytes are passed over by Spark."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    xml = F.col("content").cast("string")
    valid = F.is_valid_utf8(xml)
    return files.select(F.col("path").alias("file"), F.lit(None).cast("string").alias("member"), F.when(valid, xml).alias("xml"), F.when(~valid, F.lit("not UTF-8")).alias("error"))


def archive_pages(spark: SparkSession, path: str) -> DataFrame:
    """The XML members of an archive, or of the archives of a folder; plain pages have their content (plain) instead of their XML."""
    spark.dataSource.register(ZipPages)
    return spark.read.format(ZipPages.name()).load(path)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, content in zip(batch["path"], batch["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile as error:
                yield pd.DataFrame({"file": [file], "member": [None], "xml": [None], "error": [str(error)]})
                continue
            for name in sorted(n for n in archive.namelist() if archives.wanted(n, ".xml")):
                xml = error = None
                try:
                    xml = archive.read(name).decode("utf-8")
                except (UnicodeDecodeError, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"file": [file], "member": [name], "xml": [xml], "error": [error]})


def whole_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of archives in paths that only Spark can open, with their XML: an archive is one row and goes to one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return files.mapInPandas(_members, archives.SCHEMA)


#: Attributes of a page and of its words, but for the page's name all numbers.
_PAGE, _WORD = ("width", "height", "wordCount"), ("index", "x", "y", "width", "height")
_SPACE = "".join(map(chr, range(33)))
_HEAD = re.compile(r'[ \t\r\n]*<folio((?: (?:name="[^"<&\x00-\x20\ufffe\uffff]*"|(?:width|height|wordCount)="-?[0-9]{1,9}"))*)>')
_TAIL = re.compile(r"</folio>[ \t\r\n]*$")
_NAMES = re.compile(r' (\w+)="([^"]*)"')


@lru_cache(100)
def _word(order: tuple[str, ...]) -> str:
    """What stands before the end of a word with text, whose attributes have this order; a pattern of Arrow's."""
    numbers = "".join(f' {n}="(?P<{n}>-?[0-9]{{1,9}})"' for n in order)
    return rf"^[ \t\r\n]*<word{numbers}>(?P<VALUE>[^<&\]\x00-\x08\x0b-\x1f\x{{fffe}}\x{{ffff}}]*)$"


def plain_page(xml: str) -> tuple[dict, tuple[str, ...], str] | None:
    """A page's attributes, the order of those of its words, and what stands between its head and its tail.

    None if head, tail or the first word are anything but plainly written; ``_plain`` looks at the words.
    """
    head, tail = _HEAD.match(xml), _TAIL.search(xml, max(0, len(xml) - 100))
    if not head or not tail or tail.start() < head.end():
        return None
    own, first = _NAMES.findall(head[1]), xml.find(">", head.end(), tail.start())
    order = tuple(n for n, _ in _NAMES.findall(xml, head.end(), first + 1)) if first > 0 else ()
    if len(dict(own)) < len(own) or len(set(order)) < len(order) or not set(order) <= set(_WORD) or bool(order) != (first > 0):
        return None
    body = xml[head.end() : tail.start()]
    return None if not order and body.strip(" \t\r\n") else (dict(own), order, body)


def _runs(pages: list[tuple | None]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Pages that follow one another and whose words have attributes of one order; those without words go with any."""
    at, order = 0, ()
    for k, page in enumerate(pages):
        own = page[1] if page else ()
        if own and order and own != order:
            yield at, k, order
            at = k
        order = own or order
    if pages:
        yield at, len(pages), order


def _plain(kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the content of plain pages (plain), which are folios of words that have text and attributes of one order, and
    leaves the XML of other pages only."""
    whole = pa.int32()
    element = pa.struct([*((f"_{n}", whole) for n in _WORD), ("_VALUE", pa.string())])
    kind = pa.struct([("_name", pa.string()), *((f"_{n}", whole) for n in _PAGE), ("word", pa.list_(element))])

    def words_of(bodies: list[str], order: tuple[str, ...]) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
        """The words of plain bodies, their number in each of these, and which bodies aren't plain."""
        parts = pc.split_pattern(pa.array(bodies, pa.string()), "</word>")
        ends = parts.offsets.to_numpy()[1:] - 1  # what follows a body's last word
        parts, rest = parts.values, np.zeros(len(parts.values), bool)
        rest[ends] = True
        found = pc.extract_regex(parts, _word(order))
        wrong = found.is_null().to_numpy(zero_copy_only=False)
        wrong[ends] = pc.not_equal(pc.ascii_trim(parts.take(pa.array(ends)), " \t\r\n"), "").to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(bodies)), np.diff(ends, prepend=-1))
        odd = np.bincount(of[wrong], minlength=len(bodies)) > 0
        use = ~rest & ~odd[of]
        found = found.filter(pa.array(use))
        numbers = [found.field(n).cast(whole) if n in order else pa.nulls(len(found), whole) for n in _WORD]
        words = pa.StructArray.from_arrays([*numbers, pc.ascii_trim(found.field("VALUE"), _SPACE)], fields=list(element))
        return words, np.bincount(of[use], minlength=len(bodies)), odd

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # the words of a page take more room than its XML
                part = batch.slice(at, 64)
                xmls = part.column("xml").to_pylist()
                heads = [x and plain_page(x) for x in xmls]
                for begin, end, order in _runs(heads):
                    rows, xml, pages = part.slice(begin, end - begin), xmls[begin:end], heads[begin:end]
                    each, n = pa.array([], element), np.zeros(len(pages), int)
                    if order:
                        each, n, odd = words_of([p[2] if p else "" for p in pages], order)
                        pages = [None if wrong else p for p, wrong in zip(pages, odd, strict=True)]
                    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), whole), each)
                    own = lambda name: pa.array([p[0].get(name) if p else None for p in pages], pa.string())  # noqa: B023, E731
                    found = pa.StructArray.from_arrays([own("name"), *(own(n).cast(whole) for n in _PAGE), lists], fields=list(kind), mask=pa.array([not p for p in pages]))
                    left = pa.array([None if p else x for p, x in zip(pages, xml, strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([*(left if c == "xml" else rows.column(c) for c in kept), found], [*kept, "plain"])

    return run


class _PageReader(archives.Reader):
    def read(self, partition: archives.Part) -> Iterator[pa.RecordBatch]:
        return _plain(archives.COLUMNS)(super().read(partition))


class ZipPages(archives.ZipMembers):
    """Members of archives whose plain pages are parsed where they are read, as their XML takes many times the room."""

    reads = _PageReader

    @classmethod
    def name(cls) -> str:
        return "zip_pages"

    def schema(self) -> str:
        return f"{archives.SCHEMA}, plain struct<{SCHEMA}>"


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` with their content (page), and an error where there is none.

    Plain pages are parsed in batches, in a small part of the time that ``from_xml`` takes, which parses all others.
    Those of ``archive_pages`` have been parsed by then.
    """
    general = F.from_xml("xml", SCHEMA + ", _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    content, rows = StructType.fromDDL(SCHEMA), pages
    if "plain" in pages.columns:
        pages = pages.drop("plain")
    else:
        rows = pages.mapInArrow(_plain(pages.columns), StructType([*(StructField(f.name, f.dataType) for f in pages.schema), StructField("plain", content)]))
    # an explode, as the optimiser repeats what makes a column in filters below and for each field that is taken from it
    rows = rows.select(*pages.columns, "plain", F.explode_outer(F.array(general)).alias("other"))
    whole = F.struct(*(F.col(f"other.{c}").alias(c) for c in content.names))
    return rows.select(*(c for c in pages.columns if c not in ("xml", "error")), F.coalesce("error", F.when(F.col("other._malformed").isNotNull(), F.lit(MALFORMED))).alias("error"), F.coalesce("plain", F.when(F.col("other").isNotNull(), whole)).alias("page"))


def unreadable(rows: DataFrame) -> DataFrame:
    """(file, member, error) of ``parsed`` pages."""
    return rows.where("error is not null").select("file", "member", "error")


def counted(rows: DataFrame, seen: Observation) -> DataFrame:
    """``parsed`` pages; ``seen`` gets their number (pages) and how many can't be read (skipped) from the first action over them."""
    return rows.observe(seen, F.count(F.lit(1)).alias("pages"), F.count("error").alias("skipped"))


def boxes_in(rows: DataFrame) -> DataFrame:
    """Word boxes of ``parsed`` pages; pages without words have none."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pages = rows.where("error is null and page is not null").select("page.*").where(F.size("word") > 0)
    words = pages.select(F.coalesce("_name", F.lit("")).alias("folio"), zero("_width").alias("page_width"), zero("_height").alias("page_height"), F.explode("word").alias("w"))
    return words.select("folio", "page_width", "page_height", zero("w._index").alias("word_idx"), zero("w._x").alias("x"), zero("w._y").alias("y"), zero("w._width").alias("width"), zero("w._height").alias("height"), F.coalesce(F.trim("w._VALUE"), F.lit("")).alias("text"))


def counts_in(rows: DataFrame) -> DataFrame:
    """(file, member, folio, words, error) of ``parsed`` pages in one pass: the number of their word boxes, or the error instead.

    Pages without words, and those that were null, have none of both and no row.
    """
    n = F.size("page.word")
    counts = rows.select("file", "member", F.coalesce("page._name", F.lit("")).alias("folio"), F.when(F.col("error").isNull() & (n > 0), n).cast("long").alias("words"), "error")
    return counts.where("words is not null or error is not null")


def boxes_of(pages: DataFrame) -> DataFrame:
    """Word boxes of pages (xml), one a row."""
    return boxes_in(parsed(pages.withColumn("error", F.lit(None).cast("string"))))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parsed pages of an archive, by its name's end, else of a folder; other file names are an error."""
    if path.lower().endswith(".zip"):
        return parsed(archive_pages(spark, path))
    if posixpath.splitext(path.rstrip("/"))[1]:
        raise ValueError(f"neither a zip archive nor a folder: {path}")
    return parsed(folder_pages(spark, path))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes of ``read_pages``."""
    return boxes_in(read_pages(spark, path))
