"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where there is none, a temporary one on a single machine (tests), and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession, most: int = 2000, size: int = 2 << 20) -> None:
    """Rows go to Python workers in batches of this many rows and bytes at most, so that buffers on both sides stay small.

    Results are lazy, so these two settings of the session stay; smaller ones are left alone.
    """
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", most), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= value:
            spark.conf.set(key, str(value))


_SCRATCH: list[list[Workspace]] = []


class Workspace:
    """Tables that one operator call writes to the shared folder to cut its lineage.

    A table written here survives lost executors, unlike cached blocks. ``drop`` removes
    those that no later plan reads. Results are lazy and read what is left, so that stays, unless the
    operator is called inside ``scratch``.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if _SCRATCH:
            _SCRATCH[-1].append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Without names: all of it."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """What operators called inside have written to the shared folder is removed at the end; their results must have been written by then."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for space in _SCRATCH.pop():
            space.drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of doc_id as text is a multiple of 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts take about ``most`` bytes at most; a longer text is a run of its own."""
    _, off = byte_column(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


_HELD: dict[str, list[Callable[[], None]]] = {}
_OWNER = [""]


def holds(name: str, clear: Callable[[], None]) -> None:
    """Tell how to drop what an operator keeps in a worker from task to task."""
    _HELD.setdefault(name, []).append(clear)


def only(name: str) -> None:
    """Called at the start of a task: a worker serves operators in turn, and what the others have kept goes."""
    if _OWNER[0] != name:
        _OWNER[0] = name
        for other, drops in _HELD.items():
            if other != name:
                for drop in drops:
                    drop()
        gc.collect()


class Memory(dict):
    """What a worker remembers, in ``most`` bytes: it starts anew when full, and what takes over a thousandth of them isn't kept."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def keep(self, key: str, value) -> None:
        size = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if size * 1000 > self.most:
            return
        if self.held + size > self.most:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    filled = 1
    while filled < n:
        take = min(filled, n - filled)
        with np.errstate(over="ignore"):
            out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
        filled += take
    return out


class PowerTable:
    """Powers of an odd base and of its inverse, grown on demand and kept by a worker."""

    def __init__(self, base: int, owner: str):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.clear()
        holds(owner, self.clear)

    def clear(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, len(self.up) * 5 // 4)
            self.up, self.down = powers(self.base, m), powers(self.inverse, m)
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
