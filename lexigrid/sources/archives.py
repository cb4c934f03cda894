"""Zip archives as a table of their members, a data source for Spark: ``spark.read.format("zip_members").load(path)``.

Members are dealt out by the archives' directories, so that a large archive is read in many tasks, each of
which holds one member at a time. Paths are those that Arrow's file systems open (local and mounted
folders, and the usual object stores); what only Spark can open is read by ``boxes.whole_archives``.

A member that can't be read is a row with an error instead of its text, and so is an archive that is none.

Writing makes an archive of each task's rows (member, xml), each member deflated, under a name of its own that readers
pass over; those of the tasks that count get their final names when all are done, so tries that failed leave nothing to
read. ``write`` holds the batches small in which pages, many times the size of their texts, get to the tasks.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "zip_members"
COLUMNS = ("file", "member", "xml", "error")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)
#: Bytes of members, unpacked, that a task is planned for.
PART_BYTES = 64 << 20
#: Bytes of members, unpacked, that are handed over at a time.
BATCH_BYTES = 4 << 20
#: Of zlib, for what is written.
LEVEL = 1


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def wanted(member: str, suffix: str) -> bool:
    """Files of the suffix; neither resource forks nor hidden ones."""
    return member.endswith(suffix) and not member.startswith("__MACOSX") and not posixpath.basename(member).startswith(".")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of SCHEMA."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], list(COLUMNS))


@dataclass
class Part(InputPartition):
    file: str
    members: tuple[str, ...]
    error: str | None = None


class Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str, part_bytes: int):
        self.path, self.suffix, self.part_bytes = path, suffix, part_bytes

    def partitions(self) -> list[Part]:
        files, at = opened(self.path)
        if files.get_file_info(at).type == fs.FileType.Directory:
            names = sorted(f.path for f in files.get_file_info(fs.FileSelector(at)) if f.path.lower().endswith(".zip") and not posixpath.basename(f.path).startswith(("_", ".")))
            names = [f"{self.path.rstrip('/')}/{posixpath.basename(n)}" for n in names]
        else:
            names = [self.path]
        return [part for name in names for part in self._parts(name)]

    def _parts(self, name: str) -> Iterator[Part]:
        files, at = opened(name)
        try:
            with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
                members = sorted((m.filename, m.file_size) for m in archive.infolist() if wanted(m.filename, self.suffix))
        except (zipfile.BadZipFile, ValueError) as error:  # Arrow says ValueError where a file is too short
            yield Part(name, (), str(error))
            return
        part, size = [], 0
        for member, n in members:
            if part and size + n > self.part_bytes:
                yield Part(name, tuple(part))
                part, size = [], 0
            part.append(member)
            size += n
        if part:
            yield Part(name, tuple(part))

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.error is not None:
            yield _batch([(partition.file, None, None, partition.error)])
            return
        files, at = opened(partition.file)
        rows, size = [], 0
        with files.open_input_file(at) as raw, zipfile.ZipFile(raw) as archive:
            for member in partition.members:
                size += len(member)
                try:
                    content = archive.read(member)
                    rows.append((partition.file, member, content.decode("utf-8"), None))
                    size += len(content)
                except (UnicodeDecodeError, zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError) as error:
                    rows.append((partition.file, member, None, f"{type(error).__name__}: {error}"))
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


class ZipMembers(DataSource):
    #: Other sources may make more of the members they read.
    reads = Reader

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.reads(self.options["path"], self.options.get("suffix", ".xml"), int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        archive = None
        files, at = opened(self.path)
        files.create_dir(at, recursive=True)
        name = f"part-{self.run}-{uuid.uuid4().hex}.zip"
        out = None
        for member, xml in ((m, x) for batch in batches for m, x in zip(batch.column("member"), batch.column("xml"), strict=True)):
            if archive is None:
                out = files.open_output_stream(f"{at}/_{name}")
                archive = zipfile.ZipFile(out, "w")
            # a fixed time, so that equal rows make equal archives; a ZipInfo has a compression of its own, which is none
            archive.writestr(zipfile.ZipInfo(member.as_py(), (1980, 1, 1, 0, 0, 0)), xml.as_buffer() or b"", zipfile.ZIP_DEFLATED, LEVEL)
        if archive is None:
            return Written(None)
        archive.close()
        out.close()
        return Written(name)

    def _remove(self, begin: str) -> None:
        files, at = opened(self.path)
        for f in files.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if posixpath.basename(f.path).startswith(begin) and f.path.endswith(".zip"):
                files.delete_file(f.path)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        if self.overwrite:
            self._remove("part-")
        for m in messages:
            if m and m.name:
                files.move(f"{at}/_{m.name}", f"{at}/{m.name}")
        self._remove(f"_part-{self.run}-")

    def abort(self, messages: list[Written | None]) -> None:
        # a task that still runs may leave a file of this run after this, which no reader sees
        self._remove(f"_part-{self.run}-")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages (member, xml) in a folder, which other archives may be in."""
    spark, key = pages.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    register(spark)
    before = spark.conf.get(key)
    if not 0 < int(before.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        pages.write.format(NAME).mode("append").save(path)
    finally:
        spark.conf.set(key, before)
