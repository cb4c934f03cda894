"""Byte-level BPE: a backtracking encoder in linear time, and a decoder with an offset table.

The encoder never applies merges. For a piece of text (the pre-tokenizer's unit) an
Aho-Corasick automaton over the vocabulary finds the longest token at every byte. Walking from
the left, the longest token is taken if it may follow the token before it; else its longest
proper prefix in the vocabulary is tried, and when none is left the token before is taken back
and the byte is never entered again. Two tokens may stand side by side if merging their bytes by
rank leaves the border alone; that is decided by undoing merges at the border, from the later
merge on, and kept in a pair table. If all neighbours are compatible, the tokens are those that
merging by rank gives.

Pieces repeat, so a worker keeps the tokens of those it has met, in a table of bounded bytes that
starts anew when full.

Decoding: all tokens' bytes lie end to end; an id's offset and length are looked up, and one
gather makes the bytes of a run of texts.

A null text is empty and has no tokens. A special token's string in a text becomes its id. Very long
texts, and pieces of any length, are encoded whole. Rows that repeat an id are encoded each, and equal
texts alike; there are no ties, as the tokens of a text are unique. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from .common import Memory, holds, only, slices, small_batches

#: Bytes of pieces with their tokens, and pairs of tokens, that a worker remembers at once.
PIECES, PAIRS = 64 << 20, 300_000


def _printable() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Tokens by id, the two parts that each was merged from (-1: none), and special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte = _printable()
    raw = lambda s: bytes(byte[c] for c in s)
    vocab = spec["model"]["vocab"]
    tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for text, i in vocab.items():
        tokens[i] = raw(text)
    parts = [(-1, -1)] * len(tokens)
    order = []
    for merge in spec["model"]["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        made = vocab[a + b]
        if parts[made] == (-1, -1):
            parts[made] = (vocab[a], vocab[b])
            order.append(made)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for text, i in special.items():
        tokens[i] = text.encode()
    return {"tokens": tokens, "parts": parts, "order": order, "special": special}


def _class(prop: str) -> str:
    """The code points of a property as a set of ranges for the re module, whose sets are faster than property tests."""
    found = regex.compile(rf"{prop}+").findall("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    out = []
    for run in found:
        start = prev = ord(run[0])
        for c in map(ord, run[1:]):
            if c != prev + 1:
                out.append((start, prev))
                start = c
            prev = c
        out.append((start, prev))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Splitter:
    """The pre-tokenizer: contractions, letters, numbers and other marks with one space before, white space."""

    def __init__(self):
        letters, numbers, space = _class(r"\p{L}"), _class(r"\p{N}"), _class(r"\p{White_Space}")
        pattern = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
        make = lambda l, n, s: re.compile(pattern.replace("{L}", l).replace("{N}", n).replace("{S}", s)).findall  # noqa: E731, E741
        self.ascii = make("A-Za-z", "0-9", "\\t-\\r ")
        self.any = make(letters, numbers, space)

    def __call__(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.any(text)


class Encoder:
    def __init__(self, vocabulary: dict):
        self.tokens, self.parts, self.special = vocabulary["tokens"], vocabulary["parts"], vocabulary["special"]
        n = len(self.tokens)
        named = set(self.special.values())
        self.rank = [0] * n
        for k, t in enumerate(vocabulary["order"]):
            self.rank[t] = k + 1
        self.made = {p: t for t, p in enumerate(self.parts) if p != (-1, -1)}
        self.size = [len(t) for t in self.tokens]
        ids = {t: i for i, t in enumerate(self.tokens) if i not in named and t and (len(t) == 1 or self.parts[i] != (-1, -1))}
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in self.tokens]
        self.matcher = ahocorasick.Automaton()
        for t, i in ids.items():
            self.matcher.add_word(t.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces = Memory(PIECES)
        self.split = Splitter()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank never merges across their border."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Merges at the border are undone from the latest; a merge across it of two tokens
        # that exist at the same time, earlier than what has swallowed them, is the conflict.
        ranks, parts, made = self.rank, self.parts, self.made
        until = float("inf")
        while True:
            across = made.get((left, right))
            if across is not None and ranks[across] < until:
                return False
            a, b = ranks[left], ranks[right]
            if not a and not b:
                return True
            if a > b:
                # of equal ranks the merge further left comes first, so a merge across wins only if earlier
                until, left = a, parts[left][1]
            else:
                until, right = b + 0.5, parts[right][0]

    def piece(self, text: str) -> bytes:
        """Token ids of one piece, as little-endian 32-bit integers."""
        raw = text.encode()
        n, size = len(raw), self.size
        longest = [-1] * n
        for end, token in self.matcher.iter(raw.decode("latin-1")):
            start = end + 1 - size[token]
            if longest[start] < 0 or size[longest[start]] < size[token]:
                longest[start] = token
        if size[longest[0]] == n:
            out = [longest[0]]
        else:
            out, at, closed, token = [], 0, set(), longest[0]
            while at < n:
                while token >= 0:
                    end = at + size[token]
                    if end not in closed and (not out or self.compatible(out[-1], token)):
                        break
                    token = self.shorter[token]
                if token >= 0:
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                else:
                    closed.add(at)
                    token = out.pop()
                    at -= size[token]
                    token = self.shorter[token]
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.special and any(s in text for s in self.special):
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self._plain(x) for x in self.cut(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self.pieces
        out = []
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece)
                known.keep(piece, ids)
            out.append(ids)
        return b"".join(out)


class Decoder:
    def __init__(self, vocabulary: dict):
        sizes = np.array([len(t) for t in vocabulary["tokens"]], np.int64)
        self.bytes = np.frombuffer(b"".join(vocabulary["tokens"]), np.uint8)
        self.start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.size = sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes end to end, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)], ends


_MADE: dict[int, tuple[Encoder, Decoder]] = {}
holds("bpe", _MADE.clear)


def _tools(shared) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder, made once for each vocabulary."""
    if shared.value["key"] not in _MADE:
        _MADE.clear()
        _MADE[shared.value["key"]] = (Encoder(shared.value), Decoder(shared.value))
    return _MADE[shared.value["key"]]


def encode_decode(docs: DataFrame, vocabulary_path: str, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (text), and without its text unless ``keep_text``.

    Columns of ``docs`` with these names give way.
    The vocabulary is a file of fixed size that the driver reads and broadcasts.
    """
    small_batches(docs.sparkSession)
    vocabulary = load_vocabulary(vocabulary_path)
    vocabulary["key"] = hash((vocabulary_path, len(vocabulary["tokens"]), tuple(vocabulary["order"][:1000])))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rest = [c for c in docs.columns if c not in ("ids", "decoded") and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("bpe")
        encoder, decoder = _tools(shared)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = [encoder.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
                raw, ends = decoder.decode(flat)
                last = np.cumsum(sizes) // 4
                at = np.concatenate(([0], np.where(last > 0, ends[np.maximum(last - 1, 0)] if len(ends) else 0, 0)))
                data = raw.tobytes()
                decoded = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["row", "ids", "decoded"])

    schema = StructType([rows.schema["row"]]).add("ids", BinaryType()).add("decoded", StringType())
    return rows.mapInArrow(run, schema).select("row.*", "ids", "decoded")
