"""Orders, places, nested forms and the catalogue on small tables."""

import random
import shutil
import time

import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexigrid.functions import text as T
from lexigrid.functions.profiles import EVA_DISTINCT
from lexigrid.operators import compare as D
from lexigrid.operators import counts as C
from lexigrid.operators import grids as G
from lexigrid.operators import groups as R
from lexigrid.operators import metrics as M
from lexigrid.operators import pages as P
from lexigrid.sources import corpus
from lexigrid.sources import results as X


def test_places_of_null_groups_and_large_ones(spark):
    rows = [(None if k % 5 == 0 else "big" if k % 3 else f"g{k % 7}", k) for k in range(300)]
    random.Random(3).shuffle(rows)
    got = D.places(spark.createDataFrame(rows, "by string, key int"), "by", "key", parts=7).collect()
    want, seen = {}, {}
    for by, key in sorted(rows, key=lambda r: r[1]):
        seen[by] = seen.get(by, 0) + 1
        want[key] = (by, seen[by])
    assert {r.key: (r.by, r.place) for r in got} == want and len(got) == len(rows)


def test_orders_of_names(spark):
    names = ["f10r", "f2v", "f2r", "fRos", "f85r2", "f85r1", "F2r", "f101v", "f2r1", "odd"]
    df = spark.createDataFrame([(n,) for n in names], "page string")
    order = lambda key: [r.page for r in df.orderBy(key(F.col("page"))).collect()]
    assert order(T.natural_key) == ["fRos", "odd", "f2r", "F2r", "f2r1", "f2v", "f10r", "f85r1", "f85r2", "f101v"]
    assert order(T.in_locale) == ["f101v", "f10r", "f2r", "F2r", "f2r1", "f2v", "f85r1", "f85r2", "fRos", "odd"]


@pytest.mark.parametrize("radius", [1, 7, 40])
def test_near_places_against_all_pairs(spark, radius):
    rng = random.Random(radius)
    points = [(k, rng.randrange(-60, 60), rng.randrange(-60, 60)) for k in range(250)]
    spots = [(f"s{k}", rng.randrange(-60, 60), rng.randrange(-60, 60)) for k in range(40)] + [("on", *points[3][1:]), ("far", 9000, 9000)]
    got = D.near_places(spark.createDataFrame(points, "id int, x int, y int"), spark.createDataFrame(spots, "spot string, x int, y int"), radius, "id", "spot")
    want = {}
    for name, x, y in spots:
        near = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in points)
        if near[0] <= radius * radius:
            want[name] = (near[1], near[0])
    assert {r.spot: (r.id, r.squared) for r in got.collect()} == want


def test_a_difference_of_two_sides(spark):
    rows = spark.createDataFrame([("en", "a", 3), ("de", "a", 1), ("en", "b", 2), ("de", "c", 5), ("fr", "d", 9), (None, "e", 9)], "language string, k string, n int")
    side = lambda x: rows.where(F.col("language") == x).select("k", "n")
    one, two = D.diff_of(rows, "language", ("en", "de"), ["k"], ["n"]), D.diff(side("en"), side("de"), ["k"], ["n"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.select(one.columns).collect())) == [("a", 3, 1, 2), ("b", 2, 0, 2), ("c", 0, 5, -5)]


def test_ragged_profiles_of_unequal_lengths(spark):
    rows = [("x", "o", 3, 2, 4), ("x", "o", 1, 0, 7), ("y", "o", 3, 0, 1), ("y", "a", 2, 1, 5)]
    counts = spark.createDataFrame(rows, "page string, glyph string, length int, pos int, n long")
    nested = X.ragged_profile(counts, ["page"])
    assert {(r.page, r.glyph): r.profile for r in nested.collect()} == {("x", "o"): {"1": [7], "3": [0, 0, 4]}, ("y", "o"): {"3": [1, 0, 0]}, ("y", "a"): {"2": [0, 5]}}
    assert sorted(map(tuple, X.long_profile(nested, ["page"]).collect())) == sorted(rows)
    merged = X.merged_profiles(nested.withColumn("all", F.lit(1)).select("all", "glyph", "profile"), ["all"])
    assert {r.glyph: r.profile for r in merged.collect()} == {"o": {"1": [7], "3": [1, 0, 4]}, "a": {"2": [0, 5]}}
    # arrays that were cut short elsewhere
    short = spark.createDataFrame([(1, "o", {"3": [2]}), (1, "o", {"3": [1, 1, 1]})], "all int, glyph string, profile map<string, array<bigint>>")
    assert X.merged_profiles(short, ["all"]).first().profile == {"3": [3, 1, 1]}


def test_matrix_of_tokens_that_differ_by_case(spark):
    counts = spark.createDataFrame([("t", "T", 2), ("T", "t", 3), ("t", "x", 9)], "a string, b string, n long")
    wide = X.matrix(counts, "a", "b", "n", ("t", "T"), [])
    assert {r.a: (r.to_0, r.to_1) for r in wide.collect()} == {"t": (0, 2), "T": (3, 0)}
    assert sorted(map(tuple, X.long_matrix(wide, "a", "b", "n", ("t", "T"), []).collect())) == [("T", "t", 3), ("t", "T", 2)]


def test_groups_as_viewers_list_them():
    shown = [g.name for g in R.display_order(R.MANUSCRIPT)]
    assert shown[:3] == ["all", "language_a", "language_b"] and shown[-6:] == ["quire_13", "quire_20", "herbal_lang_a", "herbal_lang_b", "biological_lang_a", "biological_lang_b"]
    config = X.shared_config()
    assert config["aggregation_order"] == shown
    assert list(config["illustration_types"]) == list("THZBPACS")


@pytest.fixture
def published(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x", 1), ("b", "y", 2), ("a", "x", 3)], "agg string, tok string, n long")
    X.write(rows, str(tmp_path / "counts"), by="agg")
    spark.createDataFrame([("b", 0), ("a", 1), ("empty", 2)], "agg string, ord int").coalesce(1).write.json(str(tmp_path / "manifest"))
    return tmp_path


def jobs_of(spark, run):
    """What it returns, and the jobs that ran for it."""
    name = f"g{time.time()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), [spark.sparkContext.statusTracker().getJobInfo(j) for j in spark.sparkContext.statusTracker().getJobIdsForGroup(name)]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_catalogue(spark, published):
    found = X.Catalogue(spark, str(published))
    assert found.groups() == ["b", "a", "empty"]
    first = found.read("counts", "b")
    assert sorted((r.tok, r.n) for r in first.collect()) == [("x", 1), ("y", 2)]
    assert found.read("counts", "empty") is None and found.read("nothing", "b") is None
    # a second read is the kept one, and asks no file: it still answers when they are gone
    again, jobs = jobs_of(spark, lambda: found.read("counts", "b"))
    assert again is first and jobs == []
    assert "InMemoryTableScan" in again._jdf.queryExecution().executedPlan().toString()
    plan = found.read("counts", "a")._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan
    # a group that changed is read anew, the other one isn't
    kept = found.read("counts", "a")
    spark.createDataFrame([("x", 10)], "tok string, n long").write.mode("overwrite").parquet(str(published / "counts/agg=b"))
    assert [(r.agg, r.tok, r.n) for r in found.read("counts", "b").select("agg", "tok", "n").collect()] == [("b", "x", 10)]
    assert found.read("counts", "a") is kept
    shutil.rmtree(published / "counts/agg=b")
    assert found.read("counts", "b") is None
    found.clear()
    assert not first.is_cached and not found.kept


def test_catalogue_preloads(spark, published):
    found = X.Catalogue(spark, str(published))
    assert found.preload("counts") == 2
    assert set(found.kept) == {("counts", "a"), ("counts", "b")}
    assert found.preload("counts", ["a"]) == 1
    found.clear()


def test_places_of_many_rows(spark):
    """Borders of ranges are sampled where a table is large; all rows keep their places, whatever columns are used."""
    ids = spark.range(0, 60000, numPartitions=6).selectExpr("concat('q', id % 20) as quire", "id as page", "named_struct('a', id, 'b', concat('f', id)) as key")
    got = D.places(ids, "quire", "key", parts=12).select("quire", "page", "place")
    assert got.count() == 60000
    assert got.where("place <> page div 20 + 1 or quire <> concat('q', page % 20)").isEmpty()


def test_near_places_in_a_crowd(spark):
    """Many points close to many places: the closest is found without looking at all of them."""
    points = spark.range(4000, numPartitions=4).selectExpr("id", "500000 + pmod(hash(id), 3000) as x", "500000 + pmod(hash(id, 1), 3000) as y")
    spots = spark.range(400).selectExpr("id as spot", "500000 + pmod(hash(id, 2), 3000) as x", "500000 + pmod(hash(id, 3), 3000) as y").unionByName(spark.range(1).selectExpr("-1L as spot", "440000 as x", "501000 as y"))
    near = D.near_places(points, spots, 100000, "id", "spot")
    p, s = points.toPandas().astype("int64"), spots.toPandas().astype("int64")
    best = lambda r: min(zip((p.x - r.x) ** 2 + (p.y - r.y) ** 2, p.id, strict=True))
    assert sorted((r.spot, r.squared, r.id) for r in near.collect()) == sorted((r.spot, *best(r)) for r in s.itertuples())
    # what the join makes, before the closest are picked, is far from all 1.6 million pairs
    seen = Observation()
    wide = D.pairs_near(points, spots, 100000, "id", "spot").observe(seen, F.count(F.lit(1)).alias("n"))
    wide.write.format("noop").mode("overwrite").save()
    assert 401 <= seen.get["n"] < 100000


def test_page_items_are_the_counts_of_lines(spark):
    """Counts within a page are those of its exploded lines, for null, empty and repeated pages too."""
    texts = ["The quick cheese\n\nis it in iiii? Shoo", None, "", "\n", "one\n", "\ntwo words\n12 - ", "a", "a b\nckh cthee " * 30, "again\nand again"]
    docs = spark.createDataFrame([(min(k, 7), x, "en", "s") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    source = corpus.from_documents(docs)
    items = P.page_items(source.normalised(), EVA_DISTINCT, 5, 10).cache()
    words = source.words()
    of = lambda kind, *c: sorted(map(tuple, items.where(F.col("kind") == kind).select("folio", *c).collect()))
    rows = lambda df, *c: sorted(map(tuple, df.select("folio", *c).collect()))
    assert of(P.PAIR, "a", "b", "n") == rows(C.transitions(words), "from_tok", "to_tok", "n")
    assert of(P.GLYPH, "a", "n0", "n1", "n2", "n3", "n") == rows(C.word_positions(words), "glyph", *C.POSITIONS, "total")
    near = C.length_profile(words, "word", 9).groupBy("folio").agg(F.sum("n").alias("n"))
    assert of(P.NEAR, "n") == rows(near, "n")
    assert of(P.TRIGRAMS, "n") == rows(C.ngrams(words, (3,)).groupBy("folio").agg(F.sum("cnt").alias("n")), "n")
    once = docs.where("text not like 'again%'")  # cells of a repeated page are by each of its rows
    lines, grid = corpus.from_documents(once).words(), P.page_items(corpus.from_documents(once).normalised(), EVA_DISTINCT, 5, 10)
    cells = G.total_grid(G.histogram(G.place(lines, False), "x_page", "y_page", 5, 10), ("folio",))
    assert sorted(map(tuple, grid.where("kind = 'g'").selectExpr("folio", "int(a)", "int(b)", "n").collect())) == rows(cells, "col", "row", "n")


def test_page_sums_give_the_metrics_of_items(spark):
    """A row a page, with the metrics that its items' tables give, for pages without pairs, trigrams or glyphs too."""
    texts = ["The quick cheese\n\nis it in iiii? Shoo", None, "", "12 - ", "a", "a b a", "on no", "a b\nckh cthee " * 30, "again\nand again"]
    docs = spark.createDataFrame([(min(k, 7), x, "en", "s") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    source = corpus.from_documents(docs)
    items = P.page_items(source.normalised(), EVA_DISTINCT, 5, 10).cache()
    of = lambda kind: items.where(F.col("kind") == kind)
    grid = of(P.CELL).select("folio", F.col("a").cast("int").alias("col"), F.col("b").cast("int").alias("row"), "n")
    positions = of(P.GLYPH).select("folio", F.col("a").alias("glyph"), F.col("n").alias("total"), *(F.col(f"n{k}").alias(p) for k, p in enumerate(C.POSITIONS)))
    tables = [M.ngram_metrics(C.ngrams(source.words())), M.transition_metrics(of(P.PAIR)), M.position_metrics(positions), M.grid_metrics(grid, 5, 10)]
    got = M.page_metrics(P.page_sums(source.normalised(), EVA_DISTINCT, 5, 10), 5, 10)
    want = M.join_all(*tables).select(got.columns)
    shown = lambda df: sorted(tuple(v if v is None else round(v, 9) + 0 for v in r) for r in df.collect())
    assert len(shown(got)) == 5 and shown(got) == shown(want)


@pytest.mark.parametrize("chars, pages", [(1, 1), (40, 200), (1 << 18, 3), (1 << 18, 200)])
def test_pages_are_counted_many_at_once(monkeypatch, chars, pages):
    """Where one call ends and the next begins changes nothing, also within the rows of one page; few calls count many pages."""
    monkeypatch.setattr(P, "CHARS", chars)
    monkeypatch.setattr(P, "PAGES", pages)
    calls, count = [], P._pages
    monkeypatch.setattr(P, "_pages", lambda *args: calls.append(1) or count(*args))
    run = P._counter(EVA_DISTINCT, 5, 10, P._items(EVA_DISTINCT, 5, 10, pa.int64()))
    ids = [1, 2, 2, 2, 3, 4, *range(5, 105)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(["Ca.to\nk", "to", None, "ao.k1", "", "\n.t\n", *["Co.ta\nokok"] * 100])], ["folio", "all"])
    found = [r for x in run(batch.slice(k, 50) for k in (0, 50, 100)) for r in x.to_pylist()]
    of = lambda folio, kind: {(r["a"], r["b"]): r["n"] for r in found if (r["folio"], r["kind"]) == (folio, kind)}
    assert of(2, P.PAIR) == {("t", "o"): 1, ("a", "o"): 1, ("k", "1"): 1, ("o", "$"): 2, ("1", "$"): 1} | {(s, c): n for s in ("^^", "^^^", "^^^^") for c, n in (("t", 1), ("a", 1))} | {("^", c): 1 for c in "tak"} | {(c, e): 1 for e in ("$$", "$$$", "$$$$") for c in "o1"}
    assert of(1, P.CELL) == {("0", "0"): 1, ("1", "0"): 1, ("2", "0"): 1, ("3", "0"): 1, ("0", "9"): 1}
    assert of(4, P.PAIR) == {("t", "$"): 1, ("^", "t"): 1, ("^^", "t"): 1, ("t", "$$"): 1, ("^^^^", "t"): 1} and not of(3, P.PAIR)
    assert all(of(k, P.TRIGRAMS) == {("", ""): 2} and of(k, P.NEAR) == {("", ""): 8} for k in range(5, 105))
    assert (len(calls) <= 4) == (chars > 40 and pages > 3)
