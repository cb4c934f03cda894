import os
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from lexigrid.llm.common import Workspace, shared_dir, table
from lexigrid.llm.suffix import _borders as borders
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_suffix import brute as repeats

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    space, docs = Workspace(spark, "test"), table(spark, SF, "documents")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(space.put(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "mixing", "bpe"]
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity_keeps_clean_documents(stages, spark):
    docs, kept = stages[:2]
    assert kept.exceptAll(docs).isEmpty()
    gone = docs.join(kept, "doc_id", "left_anti")
    labels = table(spark, SF, "labels")
    assert gone.join(labels.where("toxic = 0"), "doc_id").count() <= 0.01 * labels.where("toxic = 0").count()
    assert gone.join(labels.where("toxic = 1"), "doc_id").count() >= 0.7 * labels.where("toxic = 1").count()


def test_one_of_each_group_stays(stages):
    docs, kept = stages[1:3]
    groups = near_groups([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in groups.items() if i == c}


def test_repeats_are_cut(stages):
    docs, cut = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    ids = sorted(docs)
    want = repeats([docs[i].text.encode() for i in ids], 200)
    assert set(cut) == set(docs)
    for i, (runs, kept) in zip(ids, want, strict=True):
        assert cut[i].text == (kept.decode("utf-8", "ignore") if runs else docs[i].text)
        assert cut[i].n_chars == (len(cut[i].text) if runs else docs[i].n_chars)


def test_mixed_to_targets(stages):
    docs, mixed = stages[3:5]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    have, got, most = {}, {}, {}
    for r in docs.collect():
        have[r.source] = have.get(r.source, 0) + size(r.text)
        most[r.source] = max(most.get(r.source, 0), size(r.text))
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + size(r.text)
    for s, target in P.mixing.shares(have).items():
        assert abs(got.get(s, 0) - target) <= most[s] / 2 + 1
    assert mixed.distinct().exceptAll(docs).isEmpty()


def test_tokens(stages):
    mixed, tokens = stages[4:]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    rows = tokens.collect()
    assert len(rows) == mixed.count()
    assert all(r.exact for r in rows)
    for r in rows[:60]:
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) == len(r.ids) // 4


def test_rows_of_one_id_and_replacement_characters_stay(spark, prose):
    shared = prose(7, 60) + " \ufffd ümläut "
    rows = [
        (1, "a \ufffd " + prose(1, 50), "en", "a", 1),
        (1, "b \ufffd " + prose(2, 50), "en", "a", 1),
        (1, "b \ufffd " + prose(2, 50), "de", "a", 1),
        (2, "b \ufffd " + prose(2, 50), "en", "a", 1),
        (None, "c " + prose(3, 50), None, None, None),
        (None, "d " + prose(4, 50), None, None, None),
        (None, "c " + prose(3, 50), "x", None, None),
        (5, "ü" + shared + "\ufffd" + prose(5, 100), "en", "a", 1),
        (6, "é" + shared + "ñ\ufffd" + prose(6, 100), "en", "a", 1),
        (7, None, "en", "a", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, docs, SF)
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted({(r[0] or 0, r[1] or "") for r in rows if r[0] != 2})
    assert kept.where("lang = 'de'").count() == 1  # of equal rows the one of least values
    cut = {r.doc_id: r for r in P.cut_repeats(spark, kept.where("doc_id > 1"), SF).collect()}
    assert cut[5].text == "ü\ufffd" + prose(5, 100) and cut[6].text == "éñ\ufffd" + prose(6, 100)
    assert cut[5].n_chars == len(cut[5].text)


def test_cuts_inside_characters():
    # a run that splits characters at both ends: what is left of them must not become another character
    raw = np.frombuffer("aéüñb".encode(), np.uint8)
    lo, hi = borders(raw, np.array([2, 1]), np.array([6, 3]))
    assert (lo.tolist(), hi.tolist()) == ([1, 1], [7, 3])


def test_run(spark, stages):
    there = set(os.listdir(shared_dir(spark)))
    got, want = P.run(spark, SF), stages[-1]
    (left,) = set(os.listdir(shared_dir(spark))) - there
    assert os.listdir(f"{shared_dir(spark)}/{left}") == ["bpe"]
    assert got.count() == want.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert P.ORACLE_SQL is None


def test_odd_documents(odd, spark):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", "row")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
        docs.count()
    empty = odd.where("doc_id = -5")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.isEmpty()
