"""Removal of long repeats with suffix arrays.

Every byte that is covered by a ``length``-byte string which also starts anywhere else (same
text included) goes. Texts are UTF-8 bytes; strings never cross texts; all strings are judged
on the input.

``SuffixFamily`` is the index: a batch of texts gets a suffix array (suffixes in the order of
their first ``length`` bytes), is merge-scanned against every existing level for strings that
both hold, and enters the family as a new level; two levels of the same rank merge into one of
the next, so n batches leave at most log2(n) + 1 levels.

On a cluster the suffixes are dealt out so that equal strings meet in one family:

1. Each string of ``length`` bytes picks an anchor, the k-gram of least hash in it (the leftmost
   of equals). Equal strings pick equal anchors at equal offsets. Neighbouring strings share
   their anchor, so about 2 rows for every ``length - k`` bytes describe a text: anchor hash,
   hash of the whole region that the strings of this anchor cover, and where it starts.
2. Anchors that occur once are dropped: all their strings occur once.
3. Regions that occur twice or more as a whole (partial aggregate: any number of copies is one
   row a task) are repeats; their strings are removed without further work.
4. What is left are anchors with differing regions, the ends of repeats: a single region of each
   kind goes to the family of its anchor. Anchors with over ``HOT`` kinds are split first: their
   regions fall into quarters, whose common string is longer, and steps 2 to 4 begin anew with
   the hash of that string; a quarter of one string needs no family.

Nulls are empty texts. Rows that repeat a doc_id or have none are told apart by a 64-bit hash of
their text; equal rows are repeats of each other, and no tie is broken. Texts under ``length`` bytes
stay as they are. A very long text is looked at in pieces, and its regions are dealt out as any
others. An empty table gives an empty result. Columns of ``docs`` that clash with names used here
do no harm: only the id, the text and those of ``keep`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PowerTable, Workspace, byte_column, mix, only, slices

LENGTH = 200
#: Kinds of regions of one anchor that a single family takes.
HOT = 20_000
#: Bytes of regions that a shard is planned for.
SHARD_BYTES = 3_000_000
#: Suffixes of a batch, and of a block of a level whose strings are laid out at once.
BATCH, BLOCK = 1 << 15, 1 << 14
#: Bytes of texts that a worker looks at together.
SLICE = 250_000

_POWER = PowerTable(0xD1342543DE82EF95, "suffix")
_PIECE = 1 << 22


class _Level:
    """Sorted suffixes of a text: ``order`` has their places, ``ids`` their numbers."""

    __slots__ = ("ids", "order", "rank", "text")

    def __init__(self, text, order, ids, rank):
        self.text, self.order, self.ids, self.rank = text, order, ids, rank


class SuffixFamily:
    """Levels of suffix arrays, merged geometrically; ``matched[id]``: the string occurs elsewhere."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[_Level] = []
        self.matched = np.zeros(0, bool)

    def _strings(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        every = np.ndarray((len(text) - self.length + 1,), f"S{self.length}", text.data, strides=(1,))
        return every[at]

    def _scan(self, level: _Level, text: np.ndarray, order: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Walk a level beside the sorted strings ``order`` of ``text``: (part of the strings, their places in the level, whether the level has them).

        Of either side only ``BLOCK`` strings are laid out at a time.
        """
        first, n = 0, len(level.order)
        block = self._strings(level.text, level.order[:BLOCK])
        for start in range(0, len(order), BLOCK):
            keys = self._strings(text, order[start : start + BLOCK])
            place, hit = np.empty(len(keys), np.int64), np.zeros(len(keys), bool)
            done = 0
            while True:
                last = first + len(block) >= n
                end = len(keys) if last else int(np.searchsorted(keys, block[-1], side="right"))
                if end > done:
                    at = np.searchsorted(block, keys[done:end])
                    place[done:end] = first + at
                    hit[done:end] = (at < len(block)) & (block[np.minimum(at, len(block) - 1)] == keys[done:end])
                    done = end
                if done == len(keys):
                    break
                first += len(block)
                block = self._strings(level.text, level.order[first : first + BLOCK])
            yield slice(start, start + len(keys)), place, hit

    def add(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Index the strings that start at ``at`` in ``text``; their numbers."""
        first = len(self.matched)
        ids = np.arange(first, first + len(at))
        self.matched = np.concatenate((self.matched, np.zeros(len(at), bool)))
        if not len(at):
            return ids
        keys = self._strings(text, at)
        by = np.argsort(keys, kind="stable")
        keys, order, own = keys[by], at[by], ids[by]
        same = keys[1:] == keys[:-1]
        self.matched[own[1:][same]] = True
        self.matched[own[:-1][same]] = True
        for level in self.levels:
            for part, place, hit in self._scan(level, text, order):
                self.matched[own[part][hit]] = True
                self.matched[level.ids[place[hit]]] = True
        fresh = _Level(text, order, own, 0)
        while self.levels and self.levels[-1].rank == fresh.rank:
            fresh = self._merge(self.levels.pop(), fresh)
        self.levels.append(fresh)
        return ids

    def _merge(self, a: _Level, b: _Level) -> _Level:
        places = np.concatenate([place for _, place, _ in self._scan(a, b.text, b.order)])
        return _Level(np.concatenate((a.text, b.text)), np.insert(a.order, places, b.order + len(a.text)), np.insert(a.ids, places, b.ids), a.rank + 1)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _POWER.get(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _POWER.get(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start])


def anchors(raw: np.ndarray, off: np.ndarray, length: int):
    """Rows (text, first string, strings, place of the anchor after it, anchor hash, region hash)."""
    k = max(1, length // 5)
    width = length - k + 1
    counts = np.maximum(np.diff(off) - length + 1, 0)
    rows: list[list[np.ndarray]] = []
    # texts are looked at in pieces whose places fit into the low bits of a key
    base, n = 0, len(raw)
    while base + length <= n:
        end = min(n, base + _PIECE)
        piece = raw[base:end]
        sums = _sums(piece)
        at = np.arange(len(piece) - k + 1)
        grams = _hash(sums, at, at + k)
        low = _least((grams & ~np.uint64(_PIECE - 1)) | at.astype(np.uint64), width)
        lo, hi = np.maximum(off[:-1], base) - base, np.minimum(off[:-1] + counts, base + len(low)) - base
        have = np.maximum(hi - lo, 0)
        doc = np.repeat(np.arange(len(counts)), have)
        starts = np.repeat(lo - np.concatenate(([0], np.cumsum(have)[:-1])), have) + np.arange(len(doc))
        if len(starts):
            place = (low[starts] & np.uint64(_PIECE - 1)).astype(np.int64)
            new = np.ones(len(starts), bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(starts)))
            s, a, d = starts[first], place[first], doc[first]
            with np.errstate(over="ignore"):
                region = _hash(sums, s, s + size - 1 + length) ^ mix((a - s).astype(np.uint64) * np.uint64(0x9E3779B1) + size.astype(np.uint64))
            rows.append([d, s + base - off[d], size, a - s, grams[a], region])
        base += len(low)
    if not rows:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*rows, strict=True)]


ANCHOR_SCHEMA = "i long, t long, ws int, nw int, d int, k long, r long"
REGION_SCHEMA = "i long, t long, ws int, nw int, d int, k long, n long, kinds long, region binary"
SPAN_SCHEMA = "i long, t long, x int, y int"


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                doc, ws, nw, d, k, r = anchors(*byte_column(batch.column("text")), length)
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("i").take(take), batch.column("t").take(take), *(pa.array(x.astype(np.int32)) for x in (ws, nw, d)), *(pa.array(x.view(np.int64)) for x in (k, r))],
                    ["i", "t", "ws", "nw", "d", "k", "r"],
                )

    return run


def _regions(length: int):
    """Cut the regions that a text's list names out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw, off = byte_column(batch.column("text"))
                lists = batch.column("wanted")
                size = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                part = {x: flat.field(x) for x in ("ws", "nw", "d", "k", "n", "kinds")}
                rows = np.repeat(np.arange(batch.num_rows), size)
                lo = off[rows] + np.asarray(part["ws"])
                hi = lo + np.asarray(part["nw"]) - 1 + length
                data = raw.tobytes()
                cut = pa.array([data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("i").take(take), batch.column("t").take(take), *part.values(), cut], ["i", "t", "ws", "nw", "d", "k", "n", "kinds", "region"])

    return run


def _quarters(length: int):
    """Split regions by the anchor's offset, so that equal strings fall into equal parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for batch in batches:
            out = {x: [] for x in ("i", "t", "ws", "nw", "d", "n", "k", "r", "region")}
            for row in batch.to_pylist():
                step = row["step"]
                s, d, nw, region = 0, row["d"], row["nw"], row["region"]
                sums = _sums(np.frombuffer(region, np.uint8))
                while s < nw:
                    # strings with the same (offset of the anchor) // step belong together
                    e = min(nw, s + (d - s) % step + 1)
                    part = region[s : e - 1 + length]
                    # what any strings of this slot share, those too that this region lacks
                    nearest = d - (d - s) // step * step
                    core, all_ = (int(_hash(sums, np.array([a]), np.array([b]))[0]) for a, b in ((nearest, nearest - step + 1 + length), (s, e - 1 + length)))
                    slot = int(mix(np.array([(d - s) // step * 4099 + step], np.uint64))[0])
                    for x, v in (("i", row["i"]), ("t", row["t"]), ("ws", row["ws"] + s), ("nw", e - s), ("d", d - s), ("n", row["n"]), ("k", core ^ slot), ("r", all_ ^ ((d - s) * 0x9E3779B97F4A7C15 % 2**64)), ("region", part)):
                        out[x].append(v)
                    s = e
            for x in ("k", "r"):
                out[x] = np.array(out[x], np.uint64).view(np.int64)
            kinds = {"i": pa.int64(), "t": pa.int64(), "ws": pa.int32(), "nw": pa.int32(), "d": pa.int32(), "n": pa.int64(), "k": pa.int64(), "r": pa.int64(), "region": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[x]) for x, v in out.items()], list(out))

    return run


def _families(length: int):
    """One family for each partition; the runs of strings that it finds elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        family, kept, waiting, suffixes = SuffixFamily(length), [], [], 0

        def flush():
            if waiting:
                sizes = np.concatenate([np.asarray(b.column("nw")) for b in waiting]).astype(np.int64)
                cols = [_binary(b.column("region")) for b in waiting]
                text = np.concatenate([c[0] for c in cols])
                lens = np.concatenate([np.diff(c[1]) for c in cols])
                off = np.concatenate(([0], np.cumsum(lens)[:-1]))
                at = np.repeat(off - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
                family.add(text, at)
                kept.append((*(np.concatenate([np.asarray(b.column(x)) for b in waiting]) for x in ("i", "t", "ws", "n")), sizes))
                waiting.clear()

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                waiting.append(batch)
                suffixes += int(np.asarray(batch.column("nw")).sum())
                if suffixes >= BATCH:
                    flush()
                    suffixes = 0
        flush()
        first = 0
        for i, t, ws, n, sizes in kept:
            hit = family.matched[first : first + sizes.sum()]
            first += int(sizes.sum())
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            hit = hit & (n[row] == 1)
            edge = np.diff(np.concatenate(([0], (hit * (row + 1)).astype(np.int64), [0])))
            begin = np.flatnonzero(hit & (edge[:-1] != 0))
            stop = np.flatnonzero(hit & (edge[1:] != 0))
            yield pa.RecordBatch.from_arrays([pa.array(i[row[begin]]), pa.array(t[row[begin]]), pa.array((ws[row[begin]] + place[begin]).astype(np.int32)), pa.array((ws[row[begin]] + place[stop] + 1).astype(np.int32))], ["i", "t", "x", "y"])

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


def _borders(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans widened to whole UTF-8 characters."""
    inside = np.append((raw & 0xC0) == 0x80, False)
    lo, hi = lo.copy(), hi.copy()
    for _ in range(3):
        lo -= inside[lo]
        hi += inside[hi]
    return lo, hi


def _removal(length: int, characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("suffix")
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw, off = byte_column(batch.column("text"))
                lists = batch.column("strings")
                size = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                row = np.repeat(np.arange(batch.num_rows), size)
                lo = off[row] + np.asarray(flat.field("x"))
                hi = off[row] + np.asarray(flat.field("y")) - 1 + length
                if characters:
                    lo, hi = _borders(raw, lo, hi)
                change = np.zeros(len(raw) + 1, np.int32)
                np.add.at(change, lo, 1)
                np.add.at(change, hi, -1)
                gone = np.cumsum(change[:-1]) > 0
                # runs never join across texts
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                heads = off[:-1][np.diff(off) > 0]
                begin[heads] = gone[heads]
                stop = gone.copy()
                stop[:-1] &= ~gone[1:]
                tails = off[1:][np.diff(off) > 0] - 1
                stop[tails] = gone[tails]
                b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
                of = np.searchsorted(off, b, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array((b - off[of]).astype(np.int32)), pa.array((e - off[of]).astype(np.int32))], ["start", "end"])
                cuts = np.searchsorted(b, off)
                kept_at = np.concatenate(([0], np.cumsum(~gone)))[off]
                kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(kept_at.astype(np.int32)), pa.py_buffer(raw[~gone].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans), kept], ["row", "n_bytes", "spans", "kept"])

    return run


def repeats(texts: DataFrame, space: Workspace, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(i, t, x, y): of the text (i, t), the strings that start from x to y - 1 also start elsewhere.

    ``texts`` has i long, t long and text; rows with equal i and t hold equal texts.
    """
    rows = space.put(texts.mapInArrow(_anchors(length), ANCHOR_SCHEMA), "anchors")
    # written, so that the join below has a plain table on either side and a hot anchor's rows can be split
    again = space.put(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "again")
    rows = space.put(rows.join(again, "k").withColumn("n", F.lit(1).cast("long")), "candidates")
    space.drop("anchors", "again")

    def resolve(rows: DataFrame, step: int, more: list[str]) -> DataFrame:
        """Write the strings of regions that occur as a whole twice; return a region of each kind of the other anchors."""
        kinds = space.put(rows.groupBy("k", "r").agg(F.sum("n").alias("n"), F.min(F.struct("i", "t", "ws", "nw", "d", *more)).alias("one")), f"kinds-{step}")
        whole = rows.drop("n").join(kinds.where("n > 1").select("k", "r"), ["k", "r"])
        space.put(whole.select("i", "t", F.col("ws").alias("x"), (F.col("ws") + F.col("nw")).alias("y")), f"spans-{step}")
        unlike = kinds.groupBy("k").agg(F.count("*").alias("kinds")).where("kinds > 1")
        return kinds.join(unlike, "k").select("one.*", "k", "n", "kinds")

    left = resolve(rows, 0, [])
    wanted = left.groupBy("i", "t").agg(F.collect_list(F.struct("ws", "nw", "d", "k", "n", "kinds")).alias("wanted"))
    one = texts.join(wanted, ["i", "t"])
    regions = space.put(one.mapInArrow(_regions(length), REGION_SCHEMA), "regions-0")
    space.drop("candidates", "kinds-0")
    cold, step, wide = [regions.where(F.col("kinds") <= hot)], 1, length
    names = ["spans-0"]
    # at width 1 the common string is the whole string, so that every anchor has one kind
    while wide > 1 and not (over := regions.where(F.col("kinds") > hot)).isEmpty():
        wide = -(-wide // 4)
        parts = over.withColumn("step", F.lit(wide)).mapInArrow(_quarters(length), "i long, t long, ws int, nw int, d int, n long, k long, r long, region binary")
        parts = space.put(parts, f"parts-{step}")
        regions = space.put(resolve(parts, step, ["region"]).select("i", "t", "ws", "nw", "d", "k", "n", "kinds", "region"), f"regions-{step}")
        names.append(f"spans-{step}")
        cold.append(regions.where(F.col("kinds") <= hot))
        step += 1
    for more in cold[1:]:
        cold[0] = cold[0].unionByName(more)
    amount = cold[0].agg(F.sum(F.length("region"))).first()[0] or 0
    shards = max(1, -(-amount // SHARD_BYTES))
    ends = cold[0].select("i", "t", "ws", "nw", "k", "n", "region").repartition(int(max(shards, 8)), "k").mapInArrow(_families(length), SPAN_SCHEMA)
    found = space.put(ends, "ends")
    for name in names:
        found = found.unionByName(space.get(name))
    return found


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, the columns of ``keep``, n_bytes, spans (start, end of the removed bytes) and kept (the other bytes).

    With ``characters``, spans are widened to whole characters, so that kept is a text again.
    """
    space = Workspace(docs.sparkSession, "suffix")
    # hashes tell texts of a repeated id apart, and those without an id
    text = F.col(text_col).cast("string")
    i, t = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text, F.lit("no id"))), F.xxhash64(text)
    texts = docs.select(i.alias("i"), t.alias("t"), text.alias("text"), F.struct(id_col, *keep).alias("row"))
    strings = repeats(texts.drop("row"), space, length, hot).groupBy("i", "t").agg(F.collect_list(F.struct("x", "y")).alias("strings"))
    none = F.array().cast("array<struct<x:int,y:int>>")
    rows = texts.join(strings, ["i", "t"], "left").withColumn("strings", F.coalesce("strings", none))
    schema = rows.select("row", F.lit(0).cast("long").alias("n_bytes"), F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("spans"), F.lit(b"").alias("kept")).schema
    return rows.mapInArrow(_removal(length, characters), schema).select("row.*", "n_bytes", "spans", "kept")
