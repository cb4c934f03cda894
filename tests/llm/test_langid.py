import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import langid
from lexigrid.llm.common import held_out, table
from lexigrid.llm.queries import op5_mixture_language_id
from tests.conftest import SF


def test_held_out_accuracy(spark):
    rows = op5_mixture_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixed_documents(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    langs, model = langid.train(docs)
    some = {r.lang: " ".join(r.text.split()[:150]) for r in docs.collect()}
    mixed = spark.createDataFrame([(some["en"] + " " + some["de"], 1), (some["fr"], 2)], "text string, doc_id long")
    got = {r.doc_id: r for r in langid.predict(mixed, langs, model).collect()}
    assert {x.lang for x in got[1].languages} == {"en", "de"}
    assert all(abs(x.share - 0.5) < 0.15 for x in got[1].languages)
    assert [x.lang for x in got[2].languages] == ["fr"]


def test_expectation_maximisation_finds_proportions():
    rng = np.random.default_rng(0)
    owner = rng.random(4000) < 0.25
    words = np.where(owner[:, None], [[-1.0, -5.0]], [[-5.0, -1.0]]).astype(np.float32)
    share, kept = langid.mixtures(words, np.array([0]))
    assert abs(share[0, 0] - owner.mean()) < 0.02
    assert kept[0].all()
    _, kept = langid.mixtures(words[owner][:50], np.array([0]))
    assert kept[0].tolist() == [True, False]


def plain_mixture(words, tolerance=langid.TOLERANCE):
    """Proportions and set of one document, from the definition, in loops: EM for all languages, then for growing sets."""
    n, langs = words.shape
    like = np.exp(words.astype(float))

    def fit(share):
        while True:
            for _ in range(langid.ROUNDS):
                joint = like * share
                before, share = share, (joint / joint.sum(1, keepdims=True)).mean(0)
            if np.abs(share - before).max() < tolerance:
                return share, np.log((like * share).sum(1)).sum()

    order = np.argsort(-fit(np.full(langs, 1 / langs))[0], kind="stable")
    full = fit(np.full(langs, 1 / langs))[0]
    best, kept, score = None, None, -np.inf
    for k in range(1, langs + 1):
        start = np.where(np.isin(np.arange(langs), order[:k]), full + 1e-6, 0)
        share, found = fit(start / start.sum())
        found -= 0.5 * (k - 1) * np.log(max(n, 2))
        if found <= score:
            break
        best, kept, score = share, set(order[:k].tolist()), found
    return best, kept


@pytest.mark.parametrize("seed", range(6))
def test_mixtures_against_a_plain_version(seed):
    """Documents of one to six languages, some with few words, all in one call."""
    rng = np.random.default_rng(seed)
    langs, docs = 6, []
    for _ in range(12):
        own = rng.choice(langs, rng.integers(1, langs + 1), replace=False)
        words = rng.normal(-6, 1, (rng.integers(1, 400), langs))
        words[np.arange(len(words)), rng.choice(own, len(words))] += rng.uniform(2, 5)
        docs.append(words.astype(np.float32))
    first = np.cumsum([0, *(len(d) for d in docs[:-1])])
    share, kept = langid.mixtures(np.concatenate(docs), first)
    for k, words in enumerate(docs):
        want, members = plain_mixture(words)
        assert set(np.flatnonzero(kept[k]).tolist()) == members
        assert np.allclose(np.where(kept[k], share[k], 0), np.where(kept[k], want, 0), atol=1e-4)


@pytest.mark.parametrize("shares", [(0.4, 0.3, 0.3), (0.4, 0.3, 0.2, 0.1), (0.6, 0.15, 0.15, 0.05, 0.05)])
def test_three_languages_and_more(shares):
    rng = np.random.default_rng(len(shares))
    langs, n = len(shares) + 2, 3000
    owner = rng.choice(len(shares), n, p=shares)
    words = rng.normal(-8, 0.5, (n, langs)).astype(np.float32)
    words[np.arange(n), owner] += 5
    share, kept = langid.mixtures(words, np.array([0]))
    assert np.flatnonzero(kept[0]).tolist() == list(range(len(shares)))
    assert np.allclose(share[0, : len(shares)], np.bincount(owner) / n, atol=0.03)


def test_odd_documents(odd):
    rows = langid.identify(odd, ~held_out()).collect()
    assert len(rows) == 15
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "fr", "es", "und") for r in rows)
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id in (1, 2)}) == 1


def test_without_training(odd, none):
    assert {r.lang_pred for r in langid.identify(odd, F.lit(False)).collect()} == {"und"}
    assert langid.identify(none, F.lit(True)).isEmpty()


def test_trigrams_of_texts_are_apart():
    a, first, doc = langid.trigrams(["ab", "", "Éb c", "İ"])
    assert doc.tolist() == [0, 2, 2, 3]
    both, _, _ = langid.trigrams(["ab"])
    assert a[:2].tolist() == both.tolist()
    assert first[0] == 0
