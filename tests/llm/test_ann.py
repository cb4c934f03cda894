import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import ann
from lexigrid.llm.common import table
from lexigrid.llm.queries import ORACLE_SQL, op9_additive_quantisation
from tests.conftest import SF


def brute(ids, x, query, k=10):
    d = np.sqrt(((x - x[query]) ** 2).sum(1))
    other = ids != ids[query]
    order = np.lexsort((ids[other], d[other]))[:k]
    return list(zip(ids[other][order].tolist(), d[other][order].tolist(), strict=True))


def test_recall_and_scores(spark):
    rows = op9_additive_quantisation(spark, "/root/testdata/sf0.1").collect()
    data = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data], float)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        want = brute(ids, x, q)
        got = sorted((r for r in rows if r.query_id == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        place = {v: k for k, v in enumerate(ids.tolist())}
        for r in got:
            assert abs(r.score - np.sqrt(((x[place[r.vec_id]] - x[q]) ** 2).sum())) < 1e-12
        hits += len({r.vec_id for r in got} & {v for v, _ in want})
        total += len(want)
    assert hits / total >= 0.9


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = op9_additive_quantisation(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_SQL["op9_additive_quantisation"]).fetchall())


def test_neighbours_are_exact_with_poor_codebooks(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 300)
    x = np.random.default_rng(4).standard_normal((6000, 32))
    ids = np.arange(len(x))
    rows = ann.nearest(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 300 == 0).collect()
    for q in range(0, 6000, 300):
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in got] == [i for i, _ in brute(ids, x, q)]


@pytest.mark.parametrize("scale", [1e-300, 1e-100, 1.0, 1e38, 1e100, 1e300])
def test_any_scale(spark, scale):
    x = np.random.default_rng(6).standard_normal((1500, 8))
    ids = np.arange(len(x))
    rows = ann.nearest(spark.createDataFrame([(k, v) for k, v in enumerate((x * scale).tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    for q in range(0, 1500, 100):
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in got] == [i for i, _ in brute(ids, x, q)]
        assert np.allclose([r.score / scale for r in got], [d for _, d in brute(ids, x, q)], rtol=1e-12)


def test_mixed_scales(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 4)) * np.repeat([1e120, 1e20, 1.0, 1e-60], 100)[:, None]
    ids = np.arange(len(x))
    rows = ann.nearest(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    for q in range(0, 400, 50):
        assert [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in brute(ids, x, q)]


def test_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (0, [5.0, 5.0]), (0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [1.0, 1.0]), (2, [9.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=4).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 2, 0.0), (2, 1, 1.0), (3, 1, 2.0), (4, 2, 8.0)]


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 7)
    x = np.random.default_rng(9).standard_normal((800, 6))
    ids = np.arange(len(x))
    rows = ann.nearest(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert len(rows) == 400
    for q in range(0, 800, 20):
        assert [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] == [i for i, _ in brute(ids, x, q)]


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    books = ann.train(x, stages=4, words=32)
    error = lambda beam: ((x - ann.approximate(ann.encode(x, books, beam), books)) ** 2).sum(1).mean()
    assert error(8) <= error(1)
    assert error(8) < 0.6 * (x**2).sum(1).mean()


def test_ties_and_a_common_vector(spark):
    rng = np.random.default_rng(2)
    common = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, common) for i in range(0, 900, 3)] + [(i, rng.standard_normal(4).tolist()) for i in range(1, 900, 3)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 300 == 0).collect()
    for q in (0, 300, 600):
        mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert mine == [i for i in range(0, 60, 3) if i != q][:10]


def test_vectors_that_take_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [nan, 1.0]), (400, [inf, 1.0]), (500, [None, 1.0]), (600, [1.0, 1.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 0.5]), (9, []), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 8, 0.5), (0, 2, 7, round(2**0.5, 6))]


def test_each_length_has_neighbours_of_its_own(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(k, rng.standard_normal(3 if k % 4 else 2 if k % 8 else 7).tolist()) for k in range(400)] + [(4000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") % 50 == 1)).collect()
    for q, v in rows:
        if q % 20 and q % 50 != 1:
            continue
        alike = [(i, np.array(w)) for i, w in rows if len(w) == len(v) and i != q]
        want = sorted((float(np.sqrt(((w - np.array(v)) ** 2).sum())), i) for i, w in alike)[:10]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in want]
    con = duckdb.connect()
    embeddings = df.where("vec_id % 100 = 0 or vec_id < 300").toPandas()  # noqa: F841  DuckDB reads it by name
    con.sql("CREATE TABLE embeddings AS SELECT * FROM embeddings")
    near = ann.nearest(df.where("vec_id % 100 = 0 or vec_id < 300"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(near)] == [x[:3] for x in sorted(con.sql(ORACLE_SQL["op9_additive_quantisation"]).fetchall())]
    monkeypatch.setattr(ann, "LENGTHS", 1)
    with pytest.raises(ValueError, match="lengths"):
        ann.nearest(df, F.col("vec_id") % 20 == 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.lit(True))
    assert got.isEmpty()
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
