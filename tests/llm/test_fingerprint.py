import hashlib
import os
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrid.llm import fingerprint as P
from lexigrid.llm.common import table
from lexigrid.llm.queries import op7_prefix_fingerprints
from tests.conftest import SF


def points(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=30), st.data())
def test_spans_and_extensions(text, data):
    h, n = P.PrefixHashes(points(text)), len(text)
    a, b = data.draw(st.integers(0, n)), data.draw(st.integers(0, n))
    size = data.draw(st.integers(0, n - max(a, b)))
    assert h.equal(a, b, size) == (text[a : a + size] == text[b : b + size])
    k = 0
    while max(a, b) + k < n and text[a + k] == text[b + k]:
        k += 1
    one = lambda x: np.array([x])
    assert h.extension(one(a), h, one(b), one(n - max(a, b))).tolist() == [k]


def prints(texts):
    return P.fingerprints(*P.hashed(texts))


def plain(text):
    """A fingerprint with whole numbers alone, each hash from its own span."""

    def value(span, p, b):
        return sum((ord(c) + 1) * pow(b, i, p) for i, c in enumerate(span)) % p

    ladder, rung = [], 1
    while rung <= len(text):
        ladder.append(f"{value(text[:rung], P.PRIMES[0], P.BASES[0]):08x}")
        rung = max(rung + 1, rung * 6 // 5)
    cells = {}
    for k in range(len(text) - P.SPAN + 1):
        h = value(text[k : k + P.SPAN], P.PRIMES[0], P.BASES[0])
        cells.setdefault(h % P.CELLS, []).append(h // P.CELLS * 2654435761 % 2**32)
    sketch = "".join(f"{(min(cells[c]) >> 8) % 0xFFFF:04x}" if c in cells else "ffff" for c in range(P.CELLS))
    whole = "".join(f"{value(text, p, b):08x}" for p, b in zip(P.PRIMES, P.BASES, strict=True))
    return f"{len(text):x}.{whole}.{''.join(ladder)}.{sketch}"


def plain_likeness(a, b):
    """From fingerprints, rung after rung and cell after cell."""
    (n, whole, ladder, cells), (m, other, rungs, marks) = a.split("."), b.split(".")
    if (n, whole) == (m, other):
        return 1.0
    if n == "0" or m == "0":
        return 0.0
    prefix, rung = 0, 1
    for k in range(0, min(len(ladder), len(rungs)), 8):
        if ladder[k : k + 8] != rungs[k : k + 8]:
            break
        prefix, rung = rung, max(rung + 1, rung * 6 // 5)
    both = [(cells[4 * k : 4 * k + 4], marks[4 * k : 4 * k + 4]) for k in range(P.CELLS)]
    used = [x == y for x, y in both if (x, y) != ("ffff", "ffff")]
    return max(prefix / max(int(n, 16), int(m, 16)), sum(used) / len(used) if used else 0.0)


def test_plain_version(spark, prose):
    docs = [(1, prose(1, 30)), (2, prose(1, 30) + " and more"), (3, ""), (4, "é\U0001f600x"), (5, prose(2, 60)), (6, prose(2, 40) + prose(9, 20)), (7, prose(2, 60)), (8, "abc")]
    rows = {r.doc_id: r for r in P.neighbours(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        a, b, c = plain(text), plain(edited), plain(after)
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (a, b)
        assert (rows[i].near_edited, rows[i].near_next) == (plain_likeness(a, b), plain_likeness(a, c))
        assert (rows[i].common_edited, rows[i].common_next) == (len(os.path.commonprefix([text, edited])), len(os.path.commonprefix([text, after])))


def test_fingerprints_do_not_depend_on_neighbours(prose):
    texts = [prose(k, k * 7) for k in range(20)] + ["", "x", prose(3, 21)]
    assert prints(texts) == [prints([t])[0] for t in texts]
    assert len(set(prints(texts))) == 21  # two empty texts, and a text twice
    assert prints([]) == []


def test_likeness(prose):
    a, b = prose(1, 400), prose(2, 400)
    fa, fb, half, moved = prints([a, b, a[: len(a) // 2] + b[len(b) // 2 :], "new start " + a])
    assert P.likeness(fa, fa) == 1
    assert P.likeness(fa, fb) < 0.15
    assert 0.35 < P.likeness(fa, half) <= 0.55
    assert P.likeness(fa, moved) > 0.8
    empty = prints([""])[0]
    assert (P.likeness(empty, empty), P.likeness(empty, fa)) == (1, 0)


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    want = []
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_short_texts_have_a_sketch():
    texts = [f"{c}{k} stone by {k} green river {k}"[:size] for k in range(10) for size in (20, 24, 29) for c in "ab"]
    marks = prints(texts)
    assert all(P.likeness(a, b) > 0.3 for a, b in zip(marks[::2], marks[1::2], strict=True))


def test_query(spark):
    docs = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    rows = op7_prefix_fingerprints(spark, SF).collect()
    check([(r.doc_id, r.n_chars, r.edited_sha256) for r in rows], docs)
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    follower = dict(zip(sorted(dict(docs)), [t for _, t in sorted(docs)[1:]] + [sorted(docs)[0][1]], strict=True))
    assert all(r.common_next == len(os.path.commonprefix([dict(docs)[r.doc_id], follower[r.doc_id]])) for r in rows)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    texts, marks = dict(docs), {}
    assert all(marks.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint for r in rows)


def test_many_ranges_with_few_rows(spark):
    rng = random.Random(2)
    docs = [(rng.randrange(1000), f"text {k} " * rng.randrange(4)) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = P.neighbours(df).collect()
    check([(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in rows], docs)


def test_odd_documents(odd, none, spark):
    docs = [(r.doc_id, r.text or "") for r in odd.collect()]
    rows = P.neighbours(odd).collect()
    check([(r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in rows], docs)
    assert P.neighbours(none).isEmpty()
    one = P.neighbours(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r.n_chars, r.edited) for r in one] == [(4, "abab")]
