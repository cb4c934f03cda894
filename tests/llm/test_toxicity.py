import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import toxicity as T
from lexigrid.llm.common import held_out, table
from tests.conftest import SF

SF_LABELLED = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def restorer(spark):
    return T.Restorer(T.character_model(table(spark, SF, "documents").unionByName(table(spark, "/root/testdata/sf0.01", "documents"))))


@pytest.mark.parametrize(
    ("hidden", "plain"),
    [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("i    d \t\n  i   o\n\n\n\n\nt", "idiot"), ("stuuuupid", "stupid"), ("$tup1d", "stupid"), ("M0R0N", "moron"), ("l0ser", "loser"), ("tr@sh", "trash"), ("y o u m o r o n", "you moron"), ("p4th3tic", "pathetic"), ("s_c_u_m", "scum"), ("cl0wn!!!", "clown"), ("end.the", "end the"), ("The, river?", "the river"), ("thoner$$$", "thoner")],
)
def test_restores(restorer, hidden, plain):
    assert T.restore(hidden, restorer) == plain


def test_plain_words_stay(restorer, prose):
    assert T.restore(prose(1, 300), restorer) == prose(1, 300)


def test_viterbi_finds_the_best_path(restorer):
    """Against all paths of a small lattice."""

    def paths(token):
        out = [("", 0.0)]
        for letters, drop, end in restorer.lattice(token):
            step = [(x, c) for x, c in letters] + ([("", drop)] if drop is not None else []) + ([(" ", end)] if end is not None else [])
            out = [(s + x, c + d) for s, c in out for x, d in step]
        return out

    def score(s, c):
        a = b = 0
        for x in s + " ":
            k = T._symbol(x)
            if x == " " and b == 0:
                continue
            c += restorer.model[(a * T.SYMBOLS + b) * T.SYMBOLS + k]
            a, b = (b, k) if k else (0, 0)
        return c

    for token in ("1d10t", "tr@sh", "a.b!l"):
        best = max(paths(token), key=lambda p: score(*p))[0]
        assert restorer.decode(token) == best.split()


def test_held_out(spark):
    docs = table(spark, SF_LABELLED, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = table(spark, SF_LABELLED, "labels")
    rows = T.fit_and_score(docs, labels, ~held_out(), keep=("held_out",)).where("held_out").join(labels, "doc_id").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    order = s.argsort().argsort()
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (y == 0).sum())
    assert auc > 0.95
    assert ((s >= 0.5) & (y == 0)).sum() <= 0.01 * (y == 0).sum()
    assert ((s >= 0.5) & (y == 1)).sum() >= 0.85 * y.sum()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.fit_and_score(docs, x, ~held_out()) for x in (labels, flipped))
    assert a.exceptAll(b).isEmpty()


def test_odd_documents(odd, spark):
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5, 7, 8, 8, 99)], "doc_id long, toxic int")
    rows = T.fit_and_score(odd, labels, F.lit(True)).collect()
    assert len(rows) == 15
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1


def test_without_labels(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.fit_and_score(odd, labels, F.lit(True)).collect()} == {0.0}
    assert T.fit_and_score(none, labels, F.lit(True)).isEmpty()


def test_restored_text_column(odd, spark):
    chars = T.character_model(odd)
    model = {"chars": chars, "weights": {}, "center": np.zeros(5), "scale": np.ones(5), "coef": None}
    rows = T.score(odd.select("doc_id", "text"), model, restored=True).where("doc_id = 7").collect()
    assert rows[0].restored == "one two"


def test_tokens_of_any_length(restorer):
    assert restorer.decode("1d10t" * 30_000) == restorer.words("1d10t" * 30_000)
    assert len("".join(restorer.decode("tr@sh" * 30_000))) == 150_000
    assert restorer.words("o" * 200_000) == restorer.decode("o" * 200_000)
    assert restorer.words("a" + "bc" * 60_000) == ["a" + "bc" * 60_000]


def test_memory_is_bounded_in_bytes(restorer, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 200_000)
    weigher = T.Weigher(restorer, {"word$": 2.0})
    assert weigher.vector("word " + "x" * 5000)[1] == 2.0
    assert set(weigher.known) == {"word"}
    weigher.vector(" ".join(f"plain{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)))
    assert weigher.known.held <= 200_000
    assert 0 < len(weigher.known) < 2000
