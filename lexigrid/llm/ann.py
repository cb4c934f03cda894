"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of ``STAGES`` codewords, one of each full-dimensional codebook. The
codebooks are trained on a sample of at most ``SAMPLE`` vectors: k-means on residuals stage by
stage, then rounds of encoding and least squares for all codewords at once. All vectors are encoded
by beam search, which keeps the ``BEAM`` best partial sums, and stored as one byte a stage with the
squared norm of their approximation and the distance to it. A query's squared distance to all of
them is then its own norm, plus the stored norm, less twice a sum of ``STAGES`` table lookups.

Equal vectors are indexed once and expanded after the search, to their smallest ids, as
many as are asked for: a vector that a third of all rows share is no hot group and no tie is lost.

Every query scans all codes; queries come in blocks of at most ``QUERIES``, one after another, which
are broadcast. The exact distances of the ``DEPTH`` best by lookup in a task's first batch give a query's
first radius, within which ``k`` vectors lie. By the triangle inequality a vector is outside of the radius
where its lookup distance less its distance to its approximation is; all others are compared by
exact Euclidean distance on the original vectors, in double precision, and the radius shrinks with
each that is found. So the neighbours are exact at any size of the table, whatever ``DEPTH``; the codes
only save work, the less the farther vectors are from their approximations. Codes are made of
vectors over the table's largest component, divided in double precision, and squares that leave the
range of doubles are scaled first, so that huge and tiny vectors are told apart as well.

Null vectors, zero vectors and those with null or non-finite components take no part. There is no distance
between vectors of different lengths, so each length that a query has (``LENGTHS`` at most, more are refused)
is a table with an index of its own. Ties go to the smaller id.
Equal rows are one. Where an id has several vectors, each is a candidate, the least is the query, and
none is a neighbour of its own id. An empty table gives an empty result; a text or other column beside
the id and the vector, of whatever name or length, isn't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

STAGES, WORDS, BEAM = 16, 256, 8
SAMPLE, KMEANS, REFITS = 20_000, 12, 2
QUERIES, DEPTH = 8192, 400
_SALTS = 32
#: Lengths of vectors that have an index, one after another.
LENGTHS = 1000
#: What rounding may add to a lookup in single precision, or a product in double precision, in proportion to its terms.
_ROUND, _FINE = 1e-4, 1e-11


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x stages) of the best sum that beam search finds."""
    stages, words, dim = books.shape
    out = np.empty((len(vectors), stages), np.uint8)
    norms = (books**2).sum(2)
    for start in range(0, len(vectors), 1024):
        x = vectors[start : start + 1024]
        n = len(x)
        left = x[:, None, :]  # what is left of each partial sum
        codes = np.zeros((n, 1, 0), np.uint8)
        for s in range(stages):
            # |r - c|^2 without the part that all codewords of a partial sum share
            cost = (left**2).sum(2)[:, :, None] + norms[s] - 2 * (left.reshape(-1, dim) @ books[s].T).reshape(n, -1, words)
            flat = cost.reshape(n, -1)
            width = min(beam if s < stages - 1 else 1, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width]
            of, word = best // words, best % words
            rows = np.arange(n)[:, None]
            codes = np.concatenate((codes[rows, of], word[:, :, None].astype(np.uint8)), 2)
            left = left[rows, of] - books[s][word]
        out[start : start + n] = codes[:, 0]
    return out


def approximate(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[s][codes[:, s]] for s in range(len(books)))


def train(sample: np.ndarray, stages: int = STAGES, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """Codebooks (stages x words x dim)."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    words = min(words, n)
    left = sample.astype(np.float32)
    books = []
    for _ in range(stages):
        book = left[rng.choice(n, words, replace=False)]
        for _ in range(KMEANS):
            near = ((book**2).sum(1) - 2 * left @ book.T).argmin(1)
            counts = np.bincount(near, minlength=words)
            order = np.argsort(near, kind="stable")
            used = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[used]
            book[used] = np.add.reduceat(left[order], starts, axis=0) / counts[used, None]
            empty = np.flatnonzero(counts == 0)
            if len(empty):
                book[empty] = left[rng.choice(n, len(empty))]
        near = ((book**2).sum(1) - 2 * left @ book.T).argmin(1)
        left = left - book[near]
        books.append(book)
    books = np.stack(books)
    for _ in range(REFITS):
        codes = encode(sample, books)
        # least squares over all codewords, with a little weight on the old ones
        place = codes.astype(np.int64) + np.arange(stages) * words
        gram = np.zeros((stages * words, stages * words), np.float32)
        for a in range(stages):
            for b in range(stages):
                gram[a * words : (a + 1) * words, b * words : (b + 1) * words] = np.bincount(codes[:, a].astype(np.int64) * words + codes[:, b], minlength=words * words).reshape(words, words)
        right = np.zeros((stages * words, dim), np.float32)
        for a in range(stages):
            np.add.at(right, place[:, a], sample)
        old = books.reshape(-1, dim)
        gram[np.diag_indices(len(gram))] += 0.5
        books = np.linalg.solve(gram, right + 0.5 * old).astype(np.float32).reshape(stages, words, dim)
    return books


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, squares summed in the order of the components; scaled where squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.zeros(len(a))
        for j in range(a.shape[1]):
            out += (a[:, j] - b[:, j]) ** 2
        out = np.sqrt(out)
        odd = np.flatnonzero((out < 1e-140) | ~(out < 1e150))
        if len(odd):
            apart = a[odd] - b[odd]
            most = np.abs(apart).max(1)
            fine = (most > 0) & np.isfinite(most)
            scaled = apart[fine] / most[fine, None]
            out[odd[fine]] = most[fine] * np.sqrt((scaled**2).sum(1))
    return out


class Found:
    """The best few classes of each of some queries (by distance, then id), as batches of classes come in."""

    def __init__(self, asked: np.ndarray, x: np.ndarray, table: np.ndarray, unit: float, most: int, depth: int):
        self.asked, self.x, self.table, self.unit, self.most, self.depth = asked, x, table, unit, most, depth
        with np.errstate(over="ignore"):
            self.norm = (x**2).sum(1)
        self.small = ((x / unit) ** 2).sum(1).astype(np.float32)
        self.rounding = self.small + np.abs(table).max(2).sum(1)
        self.ids = np.full((len(x), most), np.iinfo(np.int64).max)
        self.scores = np.full((len(x), most), np.inf)

    def _merge(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(of):
            return
        some = np.unique(of)
        of = np.concatenate((np.repeat(some, self.most), of))
        ids, scores = np.concatenate((self.ids[some].ravel(), ids)), np.concatenate((self.scores[some].ravel(), scores))
        order = np.lexsort((ids, scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        # the same class may come twice, from the first radius
        new = np.concatenate(([True], (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]) | (ids[1:] == np.iinfo(np.int64).max)))
        of, ids, scores = of[new], ids[new], scores[new]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        top = place < self.most
        self.ids[of[top], place[top]], self.scores[of[top], place[top]] = ids[top], scores[top]

    def add(self, ids: np.ndarray, alone: np.ndarray, code: np.ndarray, norm: np.ndarray, error: np.ndarray, v: np.ndarray) -> None:
        """``alone``: only the row of this id has the vector, so it is no neighbour of its own."""
        about = self.small[:, None] + norm
        for s in range(code.shape[1]):
            about -= 2 * self.table[:, s][:, code[:, s]]
        open_ = np.flatnonzero(self.ids[:, -1] == np.iinfo(np.int64).max)
        if len(open_) and self.depth:
            width = min(self.depth, len(ids))
            best = np.argpartition(about[open_], width - 1, axis=1)[:, :width]
            of, at = np.repeat(open_, width), best.ravel()
            other = ~alone[at] | (ids[at] != self.asked[of])
            self._merge(of[other], ids[at][other], distance(self.x[of[other]], v[at[other]]))
        radius = self.scores[:, -1]
        with np.errstate(over="ignore", under="ignore", invalid="ignore"):
            reach = (radius / self.unit)[:, None] + error
            may = ~(about > reach**2 + _ROUND * (self.rounding[:, None] + norm + error**2))  # not a number stays
            may &= ~(alone & (ids == self.asked[:, None]))
            at = np.flatnonzero(may.any(0))
            if not len(at):
                return
            w = v[at]
            size = self.norm[:, None] + (w**2).sum(1)
            far = size - 2 * (self.x @ w.T)
            of, column = np.nonzero(may[:, at] & ~(far > (radius**2)[:, None] + _FINE * size))
        # all vectors may be at the same distance, so pairs are taken by the piece
        for start in range(0, len(of), 100_000):
            o, c = of[start : start + 100_000], column[start : start + 100_000]
            self._merge(o, ids[at[c]], distance(self.x[o], w[c]))


def _distance(a: str, b: str) -> Column:
    """``distance`` as an expression."""
    apart = F.zip_with(a, b, lambda x, y: x - y)
    plain = F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x))
    most = F.array_max(F.transform(apart, F.abs))
    scaled = most * F.sqrt(F.aggregate(F.transform(apart, lambda x: x / most), F.lit(0.0), lambda s, x: s + x * x))
    return F.when((plain >= 1e-140) & (plain < 1e150), plain).when((most > 0) & (most < float("inf")), scaled).otherwise(plain)


def nearest(rows: DataFrame, is_query: Column, *, k: int = 10, depth: int = DEPTH, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest other rows of each query row, by Euclidean distance."""
    spark = rows.sparkSession
    space = Workspace(spark, "ann")
    good = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks")).where(usable(F.col("v")))
    good = space.put(good.withColumn("dim", F.size("v")), "good")
    lengths = [r.dim for r in good.where("asks").select("dim").distinct().orderBy("dim").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of over {LENGTHS} lengths")
    out = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    for dim in lengths:
        found = _nearest_of(Workspace(spark, "ann"), good.where(F.col("dim") == dim).select("i", "v", "asks"), dim, k, depth, id_col, seed)
        out = found if len(lengths) == 1 else out.unionByName(found)
    return out


def _nearest_of(space: Workspace, good: DataFrame, dim: int, k: int, depth: int, id_col: str, seed: int) -> DataFrame:
    """``nearest`` of usable vectors (i, v, asks) of one length, one of which asks at least."""
    spark = space.spark
    # classes of equal vectors: the least ids of each, found in salted groups first
    alike = Window.partitionBy("v", "salt").orderBy("i")
    few = good.select("v", "i").distinct().withColumn("salt", F.pmod(F.xxhash64("i"), F.lit(_SALTS))).withColumn("r", F.row_number().over(alike)).where(F.col("r") <= k + 1)
    same = Window.partitionBy("v")
    members = few.withColumn("r", F.row_number().over(same.orderBy("i"))).where(F.col("r") <= k + 1)
    members = members.withColumn("class", F.min("i").over(same)).withColumn("alone", F.count("*").over(same) == 1)
    members = space.put(members.select("class", "i", "alone", "v"), "members")
    classes = members.where("class = i").select("i", "alone", "v")

    n, largest = classes.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    # about twice the sample passes the first test, so that few rows are sorted
    share = min(1.0, 2 * SAMPLE / n)
    draw = F.xxhash64("i", F.lit(seed))
    drawn = classes.withColumn("draw", draw).where(F.col("draw") <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))).orderBy("draw", "i").limit(SAMPLE).select("v").collect()
    # the largest component sets the unit, so that float32 holds any scale
    unit = float(largest)
    books = train((np.array([r.v for r in drawn]) / unit).astype(np.float32), seed=seed)
    model = spark.sparkContext.broadcast((books, unit))

    def run_encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, unit = model.value
        for b in batches:
            x = (_matrix(b.column("v"), dim) / unit).astype(np.float32)
            codes = encode(x, books)
            near = approximate(codes, books)
            error = np.sqrt(((x.astype(np.float64) - near) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("alone"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((near**2).sum(1), pa.float32()), pa.array(error, pa.float32()), b.column("v")], ["i", "alone", "code", "norm", "error", "v"])

    codes = space.put(classes.mapInArrow(run_encode, "i long, alone boolean, code binary, norm float, error float, v array<double>"), "codes")

    queries = space.put(good.where("asks").groupBy("i").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-queries.count() // QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    best = Window.partitionBy("query_id").orderBy("score", "class")
    names = []
    # one block after another: the driver and the workers hold the queries of one
    for block in range(blocks):
        asked = queries.where(F.col("block") == block).select("i", "v").collect()
        if not asked:
            continue
        shared = spark.sparkContext.broadcast((np.array([q.i for q in asked]), np.array([q.v for q in asked], np.float64)))

        def run_scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books, unit = model.value
            asked, x = shared.value
            small = (x / unit).astype(np.float32)
            groups = [Found(asked[g : g + 32], x[g : g + 32], np.einsum("qd,swd->qsw", small[g : g + 32], books).astype(np.float32), unit, k, depth) for g in range(0, len(x), 32)]
            for b in batches:
                ids, alone = b.column("i").to_numpy(), b.column("alone").to_numpy(zero_copy_only=False)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                v = _matrix(b.column("v"), dim)
                for group in groups if len(ids) else ():
                    group.add(ids, alone, code, b.column("norm").to_numpy(), b.column("error").to_numpy(), v)
            for group in groups:
                of, at = np.nonzero(group.ids < np.iinfo(np.int64).max)
                if len(of):
                    yield pa.RecordBatch.from_arrays([pa.array(group.asked[of]), pa.array(group.ids[of, at]), pa.array(group.scores[of, at])], ["query_id", "class", "score"])

        part = codes.mapInArrow(run_scan, "query_id long, class long, score double")
        space.put(part.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("query_id", "class"), f"near-{block}")
        names.append(f"{space.root}/near-{block}")
        shared.unpersist()
    near = spark.read.parquet(*names).distinct()
    # classes that share a least id, as ids repeat, all come back here with their own distances
    pairs = near.join(members.select("class", "i", F.col("v").alias("w")), "class").where("i <> query_id").join(queries.select(F.col("i").alias("query_id"), "v"), "query_id")
    scored = pairs.select("query_id", "i", _distance("v", "w").alias("score")).distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "i")).cast("int")
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("i").alias(id_col), "score")
