import random
from collections import Counter

import numpy as np
import pytest

from lexigrid.llm import suffix
from lexigrid.llm.common import table
from tests.conftest import SF


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def check(df, length, hot=suffix.HOT):
    docs = df.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *b) for r, b in zip(docs, brute([(r.text or "").encode() for r in docs], length), strict=True))
    got = suffix.remove_repeats(df, length=length, hot=hot).collect()
    for r in got:
        assert all(s.start < s.end for s in r.spans)
        assert r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept)
    assert sorted((r.doc_id if r.doc_id is not None else -1, len(r.spans), bytes(r.kept)) for r in got) == want


@pytest.mark.parametrize("length", [1, 3, 5])
def test_family(length, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 7)
    rng, family, texts = random.Random(length), suffix.SuffixFamily(length), []
    for _ in range(13):
        texts.append(np.frombuffer(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(length, 30))), np.uint8))
        family.add(texts[-1], np.arange(len(texts[-1]) - length + 1))
    counts = Counter(bytes(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    assert family.matched.tolist() == [counts[bytes(t[i : i + length])] > 1 for t in texts for i in range(len(t) - length + 1)]
    assert [level.rank for level in family.levels] == [3, 2, 0]


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_whole_table(spark, hot):
    check(table(spark, SF, "documents"), 200, hot)


@pytest.mark.parametrize("length", [2, 12])
@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_random_strings(spark, length, hot):
    rng = random.Random(length)
    rows = [(i, "".join(rng.choice("aabé") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), length, hot)


def test_repeats_inside_a_text_and_overlaps(spark):
    rows = [(1, "ab" * 300), (2, "x" * 199), (3, "y" * 200), (4, "z" * 201), (5, "".join(chr(33 + k % 90) for k in range(400)))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 200)


def test_odd_documents(odd):
    check(odd, 200)
    check(odd, 20, 2)
    kept = suffix.remove_repeats(odd, keep=("lang",))
    assert kept.columns == ["doc_id", "lang", "n_bytes", "spans", "kept"]


def test_empty_table(none):
    assert suffix.remove_repeats(none).isEmpty()


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 1 << 10)
    rng = random.Random(4)
    raw = np.frombuffer(bytes(rng.choice(b"abcdefgh") for _ in range(5000)), np.uint8)
    doc, ws, nw, *_ = suffix.anchors(raw, np.array([0, 100, 5000]), 50)
    covered = [(d, w + k) for d, w, n in zip(doc, ws, nw, strict=True) for k in range(n)]
    assert sorted(covered) == [(0, k) for k in range(51)] + [(1, k) for k in range(4851)]
