"""Document fingerprints from prefix polynomial hashes.

``PrefixHashes`` holds, for a run of code points, the sums of c[i] * base**i up to every place,
modulo two primes under 2**31. The hash of any span is a difference of two sums times an inverse
power, so equality of any two spans takes constant time, and a binary search over lengths finds
the longest common extension of two places, also of many pairs of places at once. The query has it
for the start of each text and that of its edited text, and that of the next document.

A fingerprint is text: the number of code points, the hash of the whole, a ladder of prefix hashes
(lengths that grow by a fifth), and a sketch of the hashes of all spans of ``SPAN`` code points
(the least of each of ``CELLS`` classes). Equal texts have equal
fingerprints. ``likeness`` is 1 for equal wholes, else the larger of two shares: the longest
ladder prefix that both share (binary search, as prefixes agree up to some rung and differ beyond)
over the longer length, and the classes of the sketch with the same least hash. Both texts empty
are alike (1), one empty is not (0).

A null text is empty. Rows are in ascending order of id; a null id comes first, and rows of the
same id are in the order of their texts (equal rows change places with no effect). Very long texts are
hashed whole, by themselves. An empty table gives an empty result. No column but the id and the text is
read, so others may have any name.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holds, only, slices, small_batches

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, CELLS = 16, 32
#: Digits of a sketch cell, and what stands for a cell without a span.
_CELL, _NONE = 4, 0xFFFF


def _rungs(most: int) -> list[int]:
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, out[-1] * 6 // 5))
    return out


#: Lengths of the ladder's prefixes; longer texts than any that memory holds end it.
RUNGS = np.array(_rungs(1 << 34), np.int64)


class PrefixHashes:
    """Prefix sums of a run of code points; spans are [start, start + size)."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.n, self.sums, self.inverse = n, [], []
        for p, b in zip(PRIMES, BASES, strict=True):
            up, down = _powers(b, p, n + 1), _powers(pow(b, -1, p), p, n + 1)
            sums = np.zeros(n + 1, np.int64)
            np.cumsum((points.astype(np.int64) + 1) * up[:n] % p, out=sums[1:])
            sums %= p
            self.sums.append(sums)
            self.inverse.append(down)

    def span(self, start, size, which: int = 0):
        """Hash of spans, the same wherever the span stands."""
        sums = self.sums[which]
        return (sums[start + size] - sums[start]) % PRIMES[which] * self.inverse[which][start] % PRIMES[which]

    def equal(self, a: int, b: int, size: int) -> bool:
        return all(self.span(a, size, k) == self.span(b, size, k) for k in range(len(PRIMES)))

    def extension(self, at: np.ndarray, other: "PrefixHashes", to: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Lengths, up to ``most``, of the longest common extensions to the right of places here and places of another run."""
        low, high = np.zeros_like(most), most
        while (low < high).any():
            mid = (low + high + 1) // 2  # low where a search is over, and that much is equal
            same = np.logical_and(*(self.span(at, mid, k) == other.span(to, mid, k) for k in range(len(PRIMES))))
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


_KEPT: dict[tuple[int, int], np.ndarray] = {}
holds("fingerprint", _KEPT.clear)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    have = _KEPT.get((base, p))
    if have is None or len(have) < n:
        size, have = max(n, 1 << 16), np.ones(1, np.int64)
        while len(have) < size:
            have = np.concatenate((have, have * pow(base, len(have), p) % p))
        _KEPT[base, p] = have
    return have[:n]


def hashed(texts: list[str]) -> tuple[PrefixHashes, np.ndarray]:
    """Hashes of the texts end to end, and the n + 1 offsets."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return PrefixHashes(points), np.cumsum([0, *(len(t) for t in texts)], dtype=np.int64)


def fingerprints(hashes: PrefixHashes, off: np.ndarray) -> list[str]:
    """Of each text of ``hashed``."""
    sizes, count = np.diff(off), len(off) - 1
    whole = [hashes.span(off[:-1], sizes, k) for k in range(2)]
    steps = np.searchsorted(RUNGS, sizes, side="right")
    at = np.concatenate(([0], np.cumsum(steps)))
    row = np.repeat(np.arange(count), steps)
    ladder = hashes.span(off[row], RUNGS[np.arange(at[-1]) - at[row]]).astype(">u4").tobytes().hex()

    cells = np.full(count * CELLS, np.iinfo(np.int64).max, np.int64)
    if hashes.n >= SPAN:
        start = np.arange(hashes.n - SPAN + 1)
        value = hashes.span(start, SPAN)
        row = np.repeat(np.arange(count), sizes)[: len(start)]
        inside = start + SPAN <= off[row + 1]
        start, row = start[inside], row[inside]
        value = value[start]
        np.minimum.at(cells, row * CELLS + value % CELLS, value // CELLS * 2654435761 % (1 << 32))
    cells = np.where(cells == np.iinfo(np.int64).max, _NONE, (cells >> 8) % _NONE).astype(">u2").tobytes().hex()
    wide = CELLS * _CELL
    return [f"{n:x}.{a:08x}{b:08x}.{ladder[8 * x : 8 * y]}.{cells[k * wide : (k + 1) * wide]}" for k, (n, a, b, x, y) in enumerate(zip(sizes.tolist(), whole[0].tolist(), whole[1].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))]


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    n, whole, ladder, cells = a.split(".")
    m, other, rungs, marks = b.split(".")
    n, m = int(n, 16), int(m, 16)
    if (n, whole) == (m, other):
        return 1.0
    if not n or not m:
        return 0.0
    shared = bisect.bisect_left(range(min(len(ladder), len(rungs)) // 8), True, key=lambda k: ladder[8 * k : 8 * k + 8] != rungs[8 * k : 8 * k + 8])
    prefix = int(RUNGS[shared - 1]) / max(n, m) if shared else 0.0
    none = f"{_NONE:04x}"
    pairs = [(cells[k : k + _CELL], marks[k : k + _CELL]) for k in range(0, CELLS * _CELL, _CELL)]
    used = sum(x != none or y != none for x, y in pairs)
    return max(prefix, sum(x == y != none for x, y in pairs) / used if used else 0.0)


def with_successors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(i, text, part, follower): rows in ranges of i. ``follower`` rows end a range: they repeat the first of the next one (the last's: the first of all).

    The texts are shuffled once. Only the least id of each range goes to the driver and back.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    bounds = np.unique(np.array(rows.approxQuantile("i", [k / parts for k in range(1, parts)], 0.25 / parts) or [0.0])).astype(np.int64)

    @F.pandas_udf("int")
    def part(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, i.to_numpy(np.int64), side="right").astype(np.int32))

    ids = rows.select("i", part("i").alias("part")).groupBy("part").agg(F.min("i").alias("i")).orderBy("part").collect()
    if not ids:
        return rows.select("i", "text", F.lit(0).alias("part"), F.lit(False).alias("follower"))
    ends = spark.createDataFrame([(b.i, a.part) for a, b in zip(ids, ids[1:] + ids[:1], strict=True)], "i long, part int")
    followers = rows.join(F.broadcast(ends), "i").select("i", "text", "part", F.lit(True).alias("follower"))
    both = rows.select("i", "text", part("i").alias("part"), F.lit(False).alias("follower")).unionByName(followers)
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "follower", "i", "text")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("fingerprint")
    held = None  # the last row, until the one after it is known
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = list(zip(*(batch.column(x).to_pylist() for x in ("i", "text", "part", "follower")), strict=True))
            rows = ([held] if held else []) + rows
            held = rows[-1]
            first = [k for k, (a, b) in enumerate(zip(rows, rows[1:])) if a[2] == b[2] and not a[3]]
            if not first:
                continue
            hashes, off = hashed([r[1] for r in rows])
            marks, sizes = fingerprints(hashes, off), np.diff(off)
            edited = [rows[k][1][: len(rows[k][1]) - len(rows[k][1]) // 2] + rows[k + 1][1][: len(rows[k][1]) // 2] for k in first]
            changed_hashes, changed_off = hashed(edited)
            changed = fingerprints(changed_hashes, changed_off)
            k = np.array(first)
            common_edited = hashes.extension(off[k], changed_hashes, changed_off[:-1], np.minimum(sizes[k], np.diff(changed_off)))
            common_next = hashes.extension(off[k], hashes, off[k + 1], np.minimum(sizes[k], sizes[k + 1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][0] for k in first], pa.int64()),
                    pa.array(sizes[k]),
                    pa.array(edited, pa.string()),
                    pa.array([marks[k] for k in first], pa.string()),
                    pa.array(changed, pa.string()),
                    pa.array([likeness(marks[k], c) for k, c in zip(first, changed, strict=True)], pa.float64()),
                    pa.array([likeness(marks[k], marks[k + 1]) for k in first], pa.float64()),
                    pa.array(common_edited),
                    pa.array(common_next),
                ],
                ["i", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_edited", "common_next"],
            )


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, beside that of its edited text and that of the next document.

    The edited text has the last floor(n / 2) code points replaced by the next one's first as many.
    common_edited and common_next are the exact numbers of code points that both begin with.
    """
    schema = "i long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
    out = with_successors(docs, id_col, text_col).mapInArrow(_neighbours, schema)
    return out.select(F.when(F.col("i") != -(2**63), F.col("i")).alias(id_col), *out.columns[1:])
