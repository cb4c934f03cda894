import random
import re
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import mixing
from lexigrid.llm.common import table
from lexigrid.llm.mixing_sql import mixing_sql
from lexigrid.llm.queries import op3_min_cost_mixing
from tests.conftest import SF


def test_shares_stop_and_are_shared_again():
    got = mixing.shares({"a": 10, "b": 100, "c": 100, None: 90})
    assert got["a"] == 30.0
    assert sum(got.values()) == pytest.approx(300)
    assert got["b"] / got["c"] == pytest.approx(2)
    assert got[None] / got["c"] == pytest.approx(5)
    assert mixing.shares({"a": 0, "b": 5})["a"] == 0.0


def cost(edges, flow):
    return sum(c * f for (_, _, _, c), f in zip(edges, flow, strict=True))


def test_flow_is_greatest_and_cheapest():
    edges = [(0, 2, 4, 0), (0, 2, 4, 1), (0, 3, 3, 0), (0, 3, 3, 1), (2, 4, 9, 0), (2, 5, 9, 0), (3, 5, 9, 0), (4, 1, 6, 0), (5, 1, 5, 0)]
    flow = mixing.min_cost_flow(edges, 6, 0, 1)
    assert flow[7] + flow[8] == 11
    assert cost(edges, flow) == 11 - 7
    for node in (2, 3, 4, 5):
        assert sum(f for (_, b, _, _), f in zip(edges, flow, strict=True) if b == node) == sum(f for (a, _, _, _), f in zip(edges, flow, strict=True) if a == node)


def paths_one_by_one(edges, nodes, start, end):
    """Greatest flow of least cost by the plainest of means: a cheapest path at a time, by relaxing all edges."""
    arcs = [[a, b, cap, c] for a, b, cap, c in edges] + [[b, a, 0, -c] for a, b, _, c in edges]
    n = len(edges)
    while True:
        far, via = {start: 0}, {}
        for _ in range(nodes):
            for k, (a, b, cap, c) in enumerate(arcs):
                if cap and a in far and far[a] + c < far.get(b, far[a] + c + 1):
                    far[b], via[b] = far[a] + c, k
        if end not in far:
            return [arcs[n + k][2] for k in range(n)]
        path, a = [], end
        while a != start:
            path.append(via[a])
            a = arcs[via[a]][0]
        most = min(arcs[k][2] for k in path)
        for k in path:
            arcs[k][2] -= most
            arcs[(k + n) % (2 * n)][2] += most


@pytest.mark.parametrize("seed", range(12))
def test_flow_against_a_path_at_a_time(seed):
    rng = random.Random(seed)
    sources = "abcde"[: rng.randrange(1, 6)]
    patterns = {tuple(sorted(rng.sample(sources, rng.randrange(1, len(sources) + 1)))): rng.randrange(0, 60) for _ in range(9)}
    quota = {s: rng.randrange(0, 150) for s in sources}
    keys, place = sorted(patterns, key=repr), {s: 2 + len(patterns) + k for k, s in enumerate(sources)}
    edges = [(0, 2 + k, patterns[p], r) for k, p in enumerate(keys) for r in range(3)] + [(2 + k, place[s], 3 * patterns[p], 0) for k, p in enumerate(keys) for s in p] + [(place[s], 1, quota[s], 0) for s in sources]
    nodes = 2 + len(keys) + len(sources)
    ours, plain = mixing.min_cost_flow(edges, nodes, 0, 1), paths_one_by_one(edges, nodes, 0, 1)
    amount = lambda flow: sum(f for (_, b, _, _), f in zip(edges, flow, strict=True) if b == 1)
    assert amount(ours) == amount(plain) and cost(edges, ours) == cost(edges, plain)
    assert all(0 <= f <= e[2] for e, f in zip(edges, ours, strict=True))


def test_many_patterns_are_routed_in_time():
    rng = random.Random(1)
    names = [f"s{k}" for k in range(40)]
    patterns = {tuple(sorted(rng.sample(names, rng.randrange(1, 6)))): rng.randrange(1, 10_000) for _ in range(20_000)}
    total = sum(patterns.values())
    began = time.process_time()
    routed = mixing.route(patterns, {s: total // 40 * (1 + k % 3) // 2 for k, s in enumerate(names)})
    assert time.process_time() - began < 60
    assert all(sum(x.values()) <= 3 * patterns[p] for p, x in routed.items())


@pytest.mark.parametrize("parts", [1, 4])
def test_equal_rows_are_taken_one_by_one(spark, parts):
    """Six equal rows of three words, in a mix that asks for some of them."""
    rows = [(1, "x y z", "a")] * 6 + [(k, "w " * 20, "b") for k in range(10, 20)] + [(None, "v v", "c")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
    got = defaultdict(lambda: [0, 0.0, 0])
    for r in mixing.mix(docs).collect():
        own = got[r.sources[0]]
        own[0], own[1], own[2] = own[0] + r.taken, r.target, max(own[2], r.size)
    for taken, target, size in got.values():
        assert abs(taken - target) <= size / 2 + 0.5
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841  DuckDB reads it by name
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, source FROM documents")
    want = con.sql(f"SELECT doc_id, taken, count(*) FROM ({mixing_sql()}) GROUP BY ALL").fetchall()
    assert {(r.doc_id, r.taken): r["count"] for r in mixing.mix(docs).groupBy("doc_id", "taken").count().collect()} == {(i, t): n for i, t, n in want}


def test_overlapping_patterns_are_used_before_repetition():
    routed = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10})
    assert sum(sum(x.values()) for x in routed.values()) == 30
    assert max(sum(x.values()) for x in routed.values()) == 10


def test_query_near_targets(spark):
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    rows = op3_min_cost_mixing(spark, SF).collect()
    sums, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or ""))
        assert 0 <= r.taken <= 3 * r.size
        s = docs[r.doc_id].source
        sums[s, r.source_size, r.target] += r.taken
        largest[s] = max(largest[s], r.size)
    assert len(rows) == len(docs)
    assert sum(t for _, _, t in sums) == pytest.approx(sum(r.size for r in rows))
    for (s, size, target), taken in sums.items():
        assert target <= 3 * size
        assert abs(taken - target) <= largest[s] / 2 + 1


def test_reruns_agree(spark):
    a, b = op3_min_cost_mixing(spark, SF), op3_min_cost_mixing(spark, SF)
    assert a.exceptAll(b).isEmpty()


def test_overlapping_sources(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit(None).cast("string"))).alias("s"))
    rows = mixing.mix(df, sources=F.col("s"))
    assert rows.count() == 600
    assert rows.where("copies > 3").isEmpty()


def test_odd_documents(odd):
    rows = mixing.mix(odd, keep=("t",)).collect()
    assert len(rows) == 15
    assert {r.t for r in rows} == {"x"}
    assert all(r.taken == r.size * r.copies for r in rows)
    assert {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}


def test_empty_table(none):
    assert mixing.mix(none).isEmpty()
