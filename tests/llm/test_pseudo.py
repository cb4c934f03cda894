import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import pseudo as L
from lexigrid.llm.common import Workspace, table
from tests.conftest import SF

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x20\x09-\x0d]")


def split(text):
    return [t.lower() for t in TOKEN.findall(text.encode())]


def name(token):
    return int(L.hashes(np.frombuffer(token, np.uint8), np.array([0, len(token)]))[0][0])


#: A single pass is the rule at any size; what these small tables can teach shows after some more.
EPOCHS = 12


@pytest.fixture(scope="module")
def model(spark):
    return L.train(table(spark, SF, "documents").select("text", "doc_id"), Workspace(spark, "t"), epochs=EPOCHS)


def direct(text, words, net):
    """Token by token, straight from the definition."""
    known = {int(h): k for k, h in enumerate(words.known)}
    h = [name(t) for t in split(text)]
    inputs = [0] * L.SIDE + [1 + known[x] if x in known else 1 + len(known) + (x >> 40) % L.INPUTS for x in h] + [0] * L.SIDE
    softmax = lambda z: z.astype(float) - z.max() - np.log(np.exp(z.astype(float) - z.max()).sum())
    total = 0.0
    for k, x in enumerate(h, L.SIDE):
        pre = net["b"].astype(float)
        for d in range(1, L.SIDE + 1):
            pre = pre + net["emb"][inputs[k - d]][(d - 1) * L.HIDDEN : d * L.HIDDEN] + net["emb"][inputs[k + d]][(L.SIDE + d - 1) * L.HIDDEN : (L.SIDE + d) * L.HIDDEN]
        hidden = np.tanh(pre)
        groups = softmax(hidden @ net["wg"] + net["bg"])
        if x in known:
            g, place = 1 + known[x] // L.GROUP, known[x] % L.GROUP
            total += groups[g] + softmax(hidden @ net["wt"][g] + net["bt"][g])[place]
        else:
            total += groups[0] + max(float(words.classes[x % L.CLASSES]), 0.0) - np.log(words.rare + 1)
    return total


def test_tokens():
    texts = ["Der Ümlaut, 3x!\n\tab--c", "", " ", "x", "y z", "ABC abc"]
    raw = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    found, sizes = L.hashes(np.frombuffer(raw, np.uint8), off)
    want = [split(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want]
    assert found.tolist() == [name(t) for w in want for t in w]
    assert want[0] == ["der".encode(), "Ümlaut".encode(), b",", b"3x", b"!", b"ab", b"-", b"-", b"c"]
    assert found[-1] == found[-2]


def test_counts_of_the_whole_corpus(spark, model):
    words, net = model
    counts = {}
    for r in table(spark, SF, "documents").collect():
        for t in split(r.text or ""):
            counts[name(t)] = counts.get(name(t), 0) + 1
    top = sorted(counts, key=lambda h: (-counts[h], h if h < 2**63 else h - 2**64))[: L.KNOWN]
    assert words.known.tolist() == top
    rare = {}
    for h in counts.keys() - set(top):
        rare[h % L.CLASSES] = rare.get(h % L.CLASSES, 0) + counts[h]
    assert words.rare == sum(rare.values())
    assert np.allclose(np.exp(words.classes[list(rare)].astype(float)), list(rare.values()), rtol=0.01)
    assert (words.classes >= 0).sum() == len(rare)


def test_scores_equal_the_definition(spark, model):
    docs = table(spark, SF, "documents").where("n_chars < 900").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = L.score(docs, *model).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        assert r.n_tokens == len(split(texts[r.doc_id]))
        assert r.pll == pytest.approx(direct(texts[r.doc_id], *model), rel=1e-4)
        assert r.mean_pll == pytest.approx(r.pll / r.n_tokens)


def test_text_is_likelier_than_its_shuffle_and_than_the_untrained_network_says(spark, model):
    rng = random.Random(1)
    texts = [r.text for r in table(spark, SF, "documents").where("n_chars between 300 and 3000").limit(40).collect()]
    both = spark.createDataFrame([(k, j, t) for k, x in enumerate(texts) for j, t in enumerate((x, " ".join(rng.sample(x.split(), len(x.split())))))], "doc_id long, j int, text string")
    trained = {(r.doc_id, r.j): r.mean_pll for r in L.score(both, *model).collect()}
    fresh = {(r.doc_id, r.j): r.mean_pll for r in L.score(both, model[0], L.fresh(len(model[0].known))).collect()}
    assert all(trained[k, 0] > fresh[k, 0] + 0.5 for k in range(len(texts)))
    assert np.mean([trained[k, 0] > trained[k, 1] for k in range(len(texts))]) > 0.9


def test_gradients():
    rng = np.random.default_rng(0)
    n, known = 60, 200
    inputs = rng.integers(0, 1 + known + L.INPUTS, n + 2 * L.SIDE)
    at = np.arange(L.SIDE, n + L.SIDE)
    rank = rng.integers(-1, known, n)
    net = {k: v.astype(np.float64) for k, v in L.fresh(known).items()}
    network = L.Network(net, 1.0)
    seen = {}
    network._step = lambda name, grad, index=slice(None): seen.setdefault(name, []).append((index, grad.copy()))
    network.train(inputs, rank, at)
    grads = {k: np.zeros_like(v) for k, v in net.items()}
    for k, parts in seen.items():
        for index, g in parts:
            grads[k][index] += g
    loss = lambda: -L.Network(net).outputs(L.Network(net).hidden(inputs)[at], rank).sum()
    for k, v in net.items():
        for spot in [np.unravel_index(np.abs(grads[k]).argmax(), v.shape), tuple(rng.integers(0, d) for d in v.shape)]:
            kept = v[spot]
            v[spot] = kept + 1e-5
            up = loss()
            v[spot] = kept - 1e-5
            down = loss()
            v[spot] = kept
            assert grads[k][spot] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_sums():
    rng = np.random.default_rng(1)
    token, rows = rng.integers(0, 40, 500) ** 2 // 60, rng.standard_normal((500, 6))
    out, of = L._sums(rows, token)
    assert of.tolist() == sorted(set(token.tolist()))
    assert np.allclose(out, [rows[token == t].sum(0) for t in of])


def test_windows_weigh_by_their_full_counts(spark):
    # after "the" comes "b" nine times as often as "c"
    texts = [" ".join(f"the {'c' if k % 10 == 0 else 'b'} . . . ." for k in range(200))] * 30
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    words, net = L.train(docs, Workspace(spark, "t"), epochs=EPOCHS)
    given = spark.createDataFrame([(1, ". . . . the b . . . ."), (2, ". . . . the c . . . .")], "doc_id long, text string")
    a, b = (r.pll for r in sorted(L.score(given, words, net).collect()))
    assert np.exp(a - b) == pytest.approx(9, rel=0.35)


def test_a_window_spans_words(spark):
    # a word follows from the one before it, with the same words around it
    rng = random.Random(5)
    texts = [" ".join(f"{a} ooo {b} eee" for a, b in (("up", "ba") if rng.random() < 0.5 else ("on", "ka") for _ in range(40))) for _ in range(60)]
    swapped = [t.replace("ba", "?").replace("ka", "ba").replace("?", "ka") for t in texts[:10]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = L.train(docs, Workspace(spark, "t"), epochs=EPOCHS)
    both = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:10] + swapped)], "doc_id long, text string")
    got = {r.doc_id: r.mean_pll for r in L.score(both, *model).collect()}
    assert all(got[k] - got[k + 10] > 0.1 for k in range(10))


def scores(docs, **more):
    return {r.doc_id: r.mean_pll for r in L.fit_and_score(docs.select("doc_id", "text"), **more).collect()}


def test_files_and_tasks_do_not_decide_scores(spark, monkeypatch):
    """One split or six, in another order: the same replicas see the same texts in the same order."""
    monkeypatch.setattr(L, "SHARE", 5000)
    docs = table(spark, SF, "documents")
    one, six = scores(docs.coalesce(1)), scores(docs.orderBy(F.desc("n_chars")).repartition(6))
    assert one.keys() == six.keys()
    assert max(abs(one[k] - six[k]) for k in one if one[k] is not None) < 1e-3


@pytest.mark.parametrize("share", [300, 5000])
def test_many_replicas_are_averaged_in_layers(spark, monkeypatch, share):
    """One rule at any size: more tokens make more replicas, and their means come from layers of a few."""
    monkeypatch.setattr(L, "SHARE", share)
    monkeypatch.setattr(L, "FAN", 3)
    docs = table(spark, SF, "documents")
    words, net = L.train(docs.select("text", "doc_id"), Workspace(spark, "t"))
    rows = docs.where("n_chars between 300 and 3000").select("doc_id", "text")
    trained = {r.doc_id: r.mean_pll for r in L.score(rows, words, net).collect()}
    fresh = {r.doc_id: r.mean_pll for r in L.score(rows, words, L.fresh(len(words.known))).collect()}
    assert all(trained[k] > fresh[k] for k in trained)


def test_layers_give_the_weighted_mean(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 3)
    rng = np.random.default_rng(2)
    nets, weights = rng.standard_normal((20, 6)).astype(np.float32), rng.integers(1, 99, 20).astype(float)
    rows = [(k, j, w, part.tobytes()) for k, (n, w) in enumerate(zip(nets, weights)) for j, part in enumerate(np.array_split(n, 2))]
    rng.shuffle(rows)
    pieces = spark.createDataFrame([(int(a), int(b), float(c), bytearray(d)) for a, b, c, d in rows], L.PIECE_SCHEMA).repartition(5)
    got = sorted(L.averaged(pieces, 20).collect(), key=lambda r: r.piece)
    assert [r.piece for r in got] == [0, 1] and {r.weight for r in got} == {weights.sum()}
    assert np.allclose(np.concatenate([np.frombuffer(r.net, np.float32) for r in got]), np.average(nets, axis=0, weights=weights), atol=1e-5)


def test_copies_of_a_text_are_dealt_out(spark, prose, monkeypatch):
    """A third of all rows have one text; no replica gets all of them."""
    monkeypatch.setattr(L, "SHARE", 1000)
    hot = prose(1, 60)
    docs = spark.createDataFrame([(k, hot if k % 3 == 0 else prose(k + 2, 60)) for k in range(600)], "doc_id long, text string")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(36))
    most = docs.where(F.col("text") == hot).groupBy(part.alias("p")).count().agg(F.max("count")).first()[0]
    assert most < 30
    got = scores(docs)
    assert len({round(got[k], 5) for k in range(0, 600, 3)}) == 1


def test_rare_tokens_have_their_share(spark, prose, monkeypatch):
    monkeypatch.setattr(L, "KNOWN", 20)
    odd = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, prose(7, 800)), (2, odd), (3, "q " * 300), (4, "w1 w2 zzz")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.fit_and_score(docs, epochs=EPOCHS).collect()}
    assert got[2].mean_pll < got[1].mean_pll < got[3].mean_pll
    assert (got[2].n_once, got[3].n_once, got[4].n_once) == (298, 0, 1)


def test_counting_hands_on_what_it_has(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)
    import pyarrow as pa

    texts = [" ".join(f"w{(k * 7 + j) % 90}" for j in range(60)) for k in range(20)]
    rows = [b for t in texts for b in L._count(iter([pa.RecordBatch.from_arrays([pa.array([t])], ["text"])]))]
    many = list(L._count(iter([pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts])))
    total = lambda bs: {h: sum(n for b in bs for x, n in zip(b.column("h").to_pylist(), b.column("n").to_pylist()) if x == h) for b in bs for h in b.column("h").to_pylist()}
    assert len(many) > 1 and total(many) == total(rows)


def test_odd_documents(odd, none, spark):
    rows = L.fit_and_score(odd).collect()
    assert len(rows) == 15
    assert {(r.n_tokens, r.n_once, r.pll, r.mean_pll) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 0, 0.0, None)}
    assert len({r.pll for r in rows if r.doc_id in (1, 2)}) == 1
    assert L.fit_and_score(odd, keep=("doc_id", "pll")).columns == ["doc_id", "n_tokens", "n_once", "pll", "mean_pll"]
    assert L.fit_and_score(none).isEmpty()
