"""MinHash near-duplicate detection.

Documents whose sets of word shingles have a Jaccard similarity of at least ``threshold``
are linked; a class is a connected component of links.

1. One pass over the texts (Arrow batches, numpy) gives each document its number of distinct
   shingles, a 128-bit digest of the set, ``HASHES`` minima of multiply-shift hash functions,
   and from these the band keys and one signature bit a minimum.
2. Documents with the same set collapse to the smallest id (a partial aggregate, so a group
   of copies of any size costs one row a task).
3. Each ``ROWS`` minima are a band. Within a bucket of equal bands only the pairs with its
   smallest and its largest member are formed (stars).
4. Signature verification drops pairs whose bits differ too often (over five standard
   deviations beyond what the threshold allows); full sets confirm the rest.
5. Components of the confirmed links come from alternating large-star and small-star.
6. Buckets that still hold two components or more may hide links that no star has. Those of
   up to ``SMALL`` rows are joined with themselves, under the conditions "other component" and
   "signatures agree", and full sets confirm the pairs. Documents that larger ones connect form
   crowds, in which most pairs are near misses: a crowd is dealt into blocks of about ``BLOCK``
   shingles, and each pair of blocks counts the intersections of documents of different
   components exactly and returns links that join components, one for each two that meet. No
   component that a link of banding can join is left apart.

A pair at exactly 0.8 shares no band with a probability of 5e-6.

Nulls and texts without words have an empty set and link with nothing. Rows that repeat a
doc_id are treated as one document per distinct text; a null doc_id links with nothing. A very long text
is one set like any other, in a batch of its own. Of equal candidates the smaller id is confirmed
first. An empty table gives an empty result. Only the id and the text are read, so other columns clash
with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PowerTable, Workspace, byte_column, mix, only, slices

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
SIGNATURE_WORDS = 4
#: Rows of a bucket up to which all its pairs of different components are tested.
SMALL = 4
#: Shingles that a block of a crowd is planned for (16 MB).
BLOCK = 2_000_000
#: Bits of the filter that tells documents of buckets from others.
FILTER_BITS = 1 << 26

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_POWER = PowerTable(0x9E3779B97F4A7C15, "minhash")
_RNG = np.random.default_rng(20240607)
_MULTIPLIERS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_BANDS = np.arange(HASHES).reshape(BANDS, ROWS)
_BAND_MULTIPLIERS = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word, and the number of words of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    gap = _SEPARATOR[raw]
    first = np.ones(n, bool)
    first[1:] = gap[:-1]
    inner = off[1:-1]
    first[inner[inner < n]] = True
    starts = np.flatnonzero(first & ~gap)
    last = np.ones(n, bool)
    last[:-1] = gap[1:]
    last[inner[(inner > 0)] - 1] = True
    ends = np.flatnonzero(last & ~gap) + 1
    up, down = _POWER.get(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER[raw] * up[:n], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * down[starts])
    return words, np.diff(np.searchsorted(starts, off))


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end; and the n + 1 offsets."""
    words, counts = word_hashes(raw, off)
    docs = len(counts)
    first = np.concatenate(([0], np.cumsum(counts)))
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    doc = np.repeat(np.arange(docs), made)
    start = first[doc] + (np.arange(at[-1]) - at[doc])
    size = np.minimum(counts, width)[doc]
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(width):
            have = size > k
            part = words[np.where(have, start + k, 0)] if len(words) else np.zeros(len(start), np.uint64)
            h = h * np.uint64(0x2545F4914F6CDD1D) + np.where(have, part, np.uint64(0))
        h = mix(h)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    heads = at[:-1][made > 0]
    keep[heads] = True
    sizes = np.zeros(docs, np.int64)
    if len(h):
        sizes[made > 0] = np.add.reduceat(keep.astype(np.int64), heads)
    return h[keep], np.concatenate(([0], np.cumsum(sizes)))


def sketch(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets that aren't empty: two digest words, the band keys and the signature words."""
    heads = at[:-1]
    with np.errstate(over="ignore"):
        digest = np.stack([np.add.reduceat(mix(sets), heads), np.add.reduceat(mix(sets + np.uint64(0x5851F42D4C957F2D)), heads)], 1)
        minima = np.empty((HASHES, len(heads)), np.uint64)
        work = np.empty_like(sets)
        for i in range(HASHES):
            np.multiply(sets, _MULTIPLIERS[i], out=work)
            np.add(work, _ADDENDS[i], out=work)
            np.minimum.reduceat(work, heads, out=minima[i])
        minima >>= np.uint64(32)
        keys = np.empty((len(heads), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(heads), b * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
            for r in range(ROWS):
                key = mix(key ^ (minima[_BANDS[b, r]] * _BAND_MULTIPLIERS[r]))
            keys[:, b] = key
        bits = (mix(minima) & np.uint64(1)).astype(np.uint8)
    padded = np.zeros((SIGNATURE_WORDS * 64, len(heads)), np.uint8)
    padded[:HASHES] = bits
    return digest, keys, np.packbits(padded, axis=0).T.copy().view(np.uint64).reshape(len(heads), SIGNATURE_WORDS)


SKETCH_SCHEMA = "row_id long, n_shingles long, d0 long, d1 long, s0 long, s1 long, s2 long, s3 long, bands array<long>"
SET_SCHEMA = "row_id long, shingles array<long>"


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("minhash")
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, off = byte_column(batch.column("text"))
                sets, at = shingle_sets(raw, off, width)
                sizes = np.diff(at)
                full = np.flatnonzero(sizes)
                n = len(sizes)
                digest, sig = np.zeros((n, 2), np.uint64), np.zeros((n, SIGNATURE_WORDS), np.uint64)
                lengths = np.zeros(n, np.int32)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    digest[full], keys, sig[full] = sketch(sets, np.concatenate((at[full], at[-1:])))
                    lengths[full] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                longs = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*digest.T, *sig.T)]
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(sizes), *longs, bands], ["row_id", "n_shingles", "d0", "d1", "s0", "s1", "s2", "s3", "bands"])

    return run


def _slots(ids: np.ndarray) -> np.ndarray:
    """Places of ids in the filter."""
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.unique(_slots(batch.column("row_id").to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(at // 32768), pa.array(at % 32768)], ["page", "bit"])


def id_filter(ids: DataFrame) -> np.ndarray | None:
    """A bit for each hash of an id, FILTER_BITS in all (8 MB at most); None if over an eighth of them would be set."""
    if ids.count() * 8 > FILTER_BITS:
        return None
    pages = ids.mapInArrow(_filter_bits, "page long, bit long").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for p in pages:
        out[p.page * 4096 : (p.page + 1) * 4096] = np.frombuffer(p.bits, np.uint8)
    return out


def _sets(width: int, shared=None):
    """Sets of the texts whose ids pass the filter, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("minhash")
        for whole in batches:
            if shared is not None:
                at = _slots(whole.column("row_id").to_numpy())
                whole = whole.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            for batch in slices(whole, "text"):
                raw, off = byte_column(batch.column("text"))
                sets, at = shingle_sets(raw, off, width)
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))], ["row_id", "shingles"])

    return run


def _links_of_block(percent: int):
    """Links that join all components of a pair of blocks that any link joins, by postings of shingles: fewer than there are components."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, own = (table.column(x).to_numpy() for x in ("row_id", "c", "own"))
        sets = table.column("shingles").combine_chunks()
        off = np.asarray(sets.offsets).astype(np.int64)
        size = np.diff(off)
        _, value = np.unique(np.asarray(sets.flatten()), return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), size)
        by = np.argsort(value, kind="stable")
        posted, start = owner[by], np.searchsorted(value[by], np.arange(len(by) and value.max() + 2))
        names, counts = np.unique(comp, return_counts=True)
        # pairs within a component need no test; each other pair has a side outside the largest one
        outside = np.flatnonzero(comp != names[np.argmax(counts)]) if len(names) > 1 else []
        two = own.min() != own.max()
        # components that a link of this block has joined need no other
        place = np.searchsorted(names, comp)
        joined = np.arange(len(names))
        us, vs = [], []
        for x in outside:
            grams = value[off[x] : off[x + 1]]
            lo, n = start[grams], start[grams + 1] - start[grams]
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            same = np.bincount(posted[at], minlength=len(ids))
            hit = (same * 100 >= (size + size[x] - same) * percent) & (joined[place] != joined[place[x]])
            if two:
                hit &= own != own[x]
            found = np.flatnonzero(hit)
            _, first = np.unique(joined[place[found]], return_index=True)
            for y in found[first].tolist():
                us.append(ids[x])
                vs.append(ids[y])
                joined[joined == joined[place[y]]] = joined[place[x]]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def components(edges: DataFrame, space: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) of undirected ``edges`` (u, v): alternating large-star and small-star.

    component is the smallest node that can be reached. Isolated nodes don't appear. Each round is
    written to the shared folder, so that a lost executor repeats one round at most.
    """
    edges = space.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, k = print_of(edges), 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that the joins have a plain exchange on either side and a hub's rows can be split
        low = space.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), f"{name}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = space.put(large, f"{name}-{k + 1}")
        low = space.put(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = space.put(small, f"{name}-{k + 2}")
        after = print_of(small)
        space.drop(f"{name}-{k}", f"{name}-{k + 1}")
        edges, k = small, k + 2
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id (smallest id reachable) and kept.

    Shingles are of ``width`` words; sets with 100 * intersection >= percent * union are linked.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    sketches = space.put(texts.mapInArrow(_sketches(width), SKETCH_SCHEMA), "sketches")
    sig = [f"s{i}" for i in range(SIGNATURE_WORDS)]

    linked = sketches.where("n_shingles > 0 and row_id is not null")
    classes = space.put(linked.groupBy("d0", "d1", "n_shingles").agg(F.min("row_id").alias("rep")), "classes")
    reps = linked.join(classes.select("d0", "d1", "n_shingles", F.col("rep").alias("row_id")), ["d0", "d1", "n_shingles", "row_id"], "left_semi")

    rows = reps.select("row_id", F.explode("bands").alias("bucket"))
    # written, so that the join below has a plain exchange on either side and a hot bucket's rows can be split
    ends = space.put(rows.groupBy("bucket").agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).where("lo < hi"), "ends")
    buckets = space.put(rows.join(ends, "bucket").select("bucket", "row_id", "lo", "hi"), "buckets")
    in_bucket = buckets.select("row_id").distinct()
    info = space.put(reps.join(in_bucket, "row_id", "left_semi").select("row_id", "n_shingles", *sig).distinct(), "info")
    # the filter keeps most texts out of the shuffle; the exact join drops what passes by chance
    wanted = info.select("row_id").distinct()
    bits = id_filter(wanted)
    some = texts.where("row_id is not null")
    if bits is None:
        sets = some.join(wanted, "row_id", "left_semi").mapInArrow(_sets(width), SET_SCHEMA)
    else:
        sets = some.mapInArrow(_sets(width, spark.sparkContext.broadcast(bits)), SET_SCHEMA).join(wanted, "row_id", "left_semi")
    sets = space.put(sets, "sets")

    # the mean share of equal bits is (1 + J) / 2; five standard deviations are left for chance
    j = percent / 100
    p = (1 + j) / 2
    most = int(HASHES * (1 - p) + 5 * (HASHES * p * (1 - p)) ** 0.5) + 1
    fits = lambda a, b: (F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * percent)
    apart = lambda a, b: reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))) for s in sig))
    side = lambda k: info.select(F.col("row_id").alias(k), F.col("n_shingles").alias(f"{k}n"), *(F.col(s).alias(f"{k}{s}") for s in sig))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("row_id").alias("a"), F.col("shingles").alias("x"))
        b = sets.select(F.col("row_id").alias("b"), F.col("shingles").alias("y"))
        same = F.size(F.array_intersect("x", "y"))
        return pairs.select("a", "b").join(a, "a").join(b, "b").where(same * 100 >= (F.size("x") + F.size("y") - same) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))

    stars = buckets.select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("row_id").alias("b")), F.struct(F.col("row_id").alias("a"), F.col("hi").alias("b")))).alias("p")).select("p.*").where("a < b").distinct()
    likely = stars.join(side("a"), "a").join(side("b"), "b").where(fits("a", "b") & (apart("a", "b") <= most))
    # written for the same reason
    likely = space.put(likely.select("a", "b", apart("a", "b").alias("bits")), "likely").groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a"))
    links = space.put(confirmed(likely), "links-0")
    found = space.put(components(links, space, "cc0"), "found-0")

    # buckets that still hold two components or more
    known = buckets.select("bucket", "row_id", "lo").join(found, F.col("row_id") == F.col("node"), "left").select("bucket", "row_id", "lo", F.coalesce("component", "row_id").alias("c"))
    known = space.put(known, "known")
    mixed = space.put(known.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("rows")).where("x < y").select("bucket", "rows"), "mixed")
    rest = space.put(known.join(mixed, "bucket"), "rest")
    space.drop("buckets", "ends", "known", "mixed")
    if not rest.isEmpty():
        large = rest.where(F.col("rows") > SMALL)
        crowds = space.put(components(large.select(F.col("row_id").alias("u"), F.col("lo").alias("v")), space, "cw").select(F.col("node").alias("row_id"), F.col("component").alias("crowd")), "crowds")
        small = rest.where(F.col("rows") <= SMALL).join(info, "row_id").join(crowds, "row_id", "left")
        cols = lambda k: small.select("bucket", F.col("row_id").alias(k), F.col("c").alias(f"{k}c"), F.col("crowd").alias(f"{k}w"), F.col("n_shingles").alias(f"{k}n"), *(F.col(s).alias(f"{k}{s}") for s in sig))
        a, b = cols("a"), cols("b")
        apart_too = (F.col("ac") < F.col("bc")) & F.coalesce(F.col("aw") != F.col("bw"), F.lit(True))
        pairs = a.join(b, (a["bucket"] == b["bucket"]) & apart_too & fits("a", "b") & (apart("a", "b") <= most)).select("a", "b").distinct()

        members = crowds.join(large.select("row_id", "c").distinct(), "row_id")
        blocks = members.join(info.select("row_id", "n_shingles"), "row_id").groupBy("crowd").agg(F.ceil(F.sum("n_shingles") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int")
        spread = members.join(blocks, "crowd").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        spread = spread.select("row_id", "c", "crowd", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        within = spread.join(sets, "row_id").groupBy("crowd", "low", "high").applyInArrow(_links_of_block(percent), "u long, v long")
        links = space.put(links.unionByName(confirmed(pairs)).unionByName(within), "links-1")
        found = space.put(components(links, space, "cc1"), "found-1")

    heads = classes.join(found, F.col("rep") == F.col("node"), "left").select("d0", "d1", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    rows = sketches.select("row_id", "n_shingles", "d0", "d1")
    out = rows.join(heads, (rows["d0"] == heads["d0"]) & (rows["d1"] == heads["d1"]) & (rows["n_shingles"] == heads["n"]) & rows["row_id"].isNotNull(), "left")
    out = out.select(F.col("row_id").alias(id_col), rows["n_shingles"], F.coalesce("component", "row_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
