import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import minhash
from lexigrid.llm.common import Workspace, table
from tests.conftest import SF


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(docs, width, percent=80):
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df, **k):
    rows = minhash.near_duplicates(df, **k).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


@pytest.mark.parametrize("width", [4, 5])
def test_whole_table(spark, width):
    docs = table(spark, SF, "documents")
    assert result(docs, width=width) == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_near_misses_around_a_hub(spark, prose):
    """Copies of one text that are each other's near misses, in crowds of several blocks."""
    rng, base = random.Random(3), prose(9, 200).split()
    docs = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for k in rng.sample(range(200), rng.choice([4, 6, 8, 10, 12])):
            words[k] = f"w{i}x{k}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = minhash.BLOCK
    minhash.BLOCK = 5000
    try:
        assert result(df, width=4) == brute(docs, 4)
    finally:
        minhash.BLOCK = old


def test_exactly_at_the_threshold(spark):
    a = " ".join(f"a{k}" for k in range(13))
    docs = [(1, a), (2, " ".join(f"a{k}" for k in range(12))), (3, " ".join(f"a{k}" for k in range(11))), (4, "x y"), (5, "X  Y"), (6, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(df, width=4) == brute(docs, 4)


def test_odd_documents(odd):
    rows = minhash.near_duplicates(odd, width=4).collect()
    assert len(rows) == 15
    got = {r.doc_id: r for r in rows}
    assert got[2].component_id == 1
    assert got[3].component_id == 1
    assert (got[4].n_shingles, got[5].n_shingles, got[6].n_shingles, got[7].n_shingles) == (0, 0, 0, 1)
    assert got[4].kept
    assert sum(r.doc_id == 8 and r.kept for r in rows) == 3
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_empty_table(none):
    assert minhash.near_duplicates(none).isEmpty()


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = minhash.components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    none = spark.createDataFrame([], "u long, v long")
    assert minhash.components(none, Workspace(spark, "t")).isEmpty()


def test_signature_bits_estimate_similarity(prose):
    a, b = prose(1, 2000), prose(1, 2000) + " " + prose(2, 300)
    raw = np.frombuffer((a + b).encode(), np.uint8)
    sets, at = minhash.shingle_sets(raw, np.array([0, len(a), len(raw)]), 4)
    _, keys, sig = minhash.sketch(sets, at)
    same = minhash.HASHES - sum(int(x).bit_count() for x in (sig[0] ^ sig[1]))
    x, y = set(sets[: at[1]].tolist()), set(sets[at[1] :].tolist())
    assert abs(2 * same / minhash.HASHES - 1 - len(x & y) / len(x | y)) < 0.15
    assert (keys[0] == keys[1]).any()


def test_rows_of_a_hot_bucket(spark, prose):
    base = prose(11, 80)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(base)).otherwise(F.concat(F.lit(base + " "), F.col("id").cast("string"))).alias("text"))
    rows = minhash.near_duplicates(df, width=5)
    assert rows.where("component_id <> 0").isEmpty()
