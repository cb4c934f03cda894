import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexigrid.llm import bpe
from lexigrid.llm.common import table
from lexigrid.llm.queries import op6_backtracking_bpe
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.load_vocabulary(PATH)
ENCODER, DECODER = bpe.Encoder(VOCABULARY), bpe.Decoder(VOCABULARY)


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<u4").tolist()


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    raw, _ = DECODER.decode(np.array(want, np.int64))
    assert raw.tobytes().decode("utf-8", "replace") == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b <|endoftext|>", "\x1c a\x85b c  d\n\n e", "don't I'll we've 'S 's", "²½٠一\U00020000\U0001f600 é́"])
def test_cases(text):
    same(text)


def test_every_code_point():
    points = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    for k in range(0, len(points), 997):
        same("".join("a" + chr(c) for c in points[k : k + 60]))


def test_dense_merges():
    rng = random.Random(1)
    for _ in range(300):
        same("".join(rng.choice(["a", "aa", "ab", "the", "in", "ing", "er", "th", "e"]) for _ in range(60)))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    encoder = bpe.Encoder(VOCABULARY)
    text = " ".join(f"word{k}ing thousands" for k in range(40))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert len(encoder.pieces) <= 5
    assert len(encoder.pairs) <= 5


def test_memory_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 200_000)
    encoder = bpe.Encoder(VOCABULARY)
    text = "x" * 5000 + " short" + "".join(f" word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert encoder.pieces.held <= 200_000
    assert 0 < len(encoder.pieces) < 2000
    assert max(map(len, encoder.pieces)) < 100


@pytest.mark.parametrize("unit", ["a", "ab", "the", "é", "9", "=", " ", "xqzj"])
def test_pieces_of_any_length(unit):
    same(unit * (120_000 // len(unit)))


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = op6_backtracking_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_documents(odd, none):
    rows = bpe.encode_decode(odd, PATH, keep_text=True).collect()
    assert len(rows) == 15
    assert all(r.decoded == (r.text or "") for r in rows)
    assert bpe.encode_decode(none, PATH).isEmpty()
