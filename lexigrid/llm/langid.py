"""Language identification by mixture inference.

A language is a distribution over letter trigrams inside words (word ends count as a letter),
hashed into ``BUCKETS`` classes and counted over all training texts. A word's likelihood in a
language is the product over its trigrams, tempered because neighbouring trigrams overlap.

A document is a mixture of languages: expectation-maximisation over its words estimates the
proportions, until they move by less than ``TOLERANCE``. Sets of the one, two, ... likeliest languages are
fitted in the same way, as long as a document's log-likelihood, less half of ln(words) for each
language beyond the first, rises; the last set that raised it is kept. The prediction is the language of the greatest proportion in that set, and the score
is that proportion.

Null texts and texts without letters are ``und`` with score 0; without training texts all are. Very
long texts are read whole, in a batch of their own. Ties go to the language that comes first by
code point. Rows that repeat an id are predicted each, and equal texts alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from .common import only, slices, small_batches

BUCKETS = 1 << 17
#: Proportions that move by less are done; rounds after which documents that are done leave the others.
TOLERANCE, ROUNDS = 2e-3, 4
SMOOTH, TEMPER = 0.5, 0.5
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all letters end to end: the class of the trigram around each; where words start among them; each word's text."""
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # lower() may change lengths, so texts are told apart after it
    sizes = np.array([len(t.lower()) for t in texts], np.int64)
    begin = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    letter = letter_table()[points]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.where(letter, points, 0)
    h = code[at - 1] * np.uint32(0x9E3779B1) + code[at] * np.uint32(0x85EBCA77) + code[at + 1] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    first = np.flatnonzero(~letter[at - 1])
    return (h & np.uint32(BUCKETS - 1)).astype(np.int64), first, np.searchsorted(begin, at[first], side="right") - 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("langid")
    tables: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in slices(whole, "text"):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lang in set(langs):
                own = [t or "" for t, x in zip(texts, langs, strict=True) if x == lang]
                grams, _, _ = trigrams(own)
                tables[lang] = tables.get(lang, 0) + np.bincount(grams, minlength=BUCKETS)
    for lang, counts in tables.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "gram", "n"])


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the tempered log-probability of each class of trigrams in each.

    The driver gets at most BUCKETS counts a language, whatever the size of the corpus.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    got = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    counts[got["gram"].to_numpy(np.int64), np.searchsorted(langs, got["lang"].to_numpy(str)) if langs else []] = got["n"]
    seen = max(1, int((counts.sum(1) > 0).sum()))
    model = np.log(counts + SMOOTH) - np.log(counts.sum(0) + SMOOTH * seen)
    return langs, (TEMPER * model).astype(np.float32)


def mixtures(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and kept set (both documents x languages) of documents whose words start at ``first``; words: log-likelihoods."""
    counts = np.diff(np.append(first, len(words)))
    top = words.max(1)
    like = np.exp(words - top[:, None])
    base = np.add.reduceat(top.astype(np.float64), first)
    langs = words.shape[1]

    def part(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of some documents: likelihoods, the document of each (as a number in ``docs``), and first words."""
        own = np.repeat(np.arange(len(docs)), counts[docs])
        begin = np.cumsum(counts[docs]) - counts[docs]
        return like[first[docs][own] + np.arange(len(own)) - begin[own]], own, begin

    def fit(docs: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods of some documents, from a start."""
        share, left = share.copy(), np.arange(len(docs))
        while len(left):
            x, own, begin = part(docs[left])
            n, some = counts[docs[left]][:, None], share[left]
            for _ in range(ROUNDS):
                joint = some[own] * x
                before, some = some, np.add.reduceat(joint / joint.sum(1)[:, None], begin, axis=0) / n
            share[left] = some
            left = left[np.abs(some - before).max(1) >= TOLERANCE]
        x, own, begin = part(docs)
        return share, np.add.reduceat(np.log((share[own] * x).sum(1)), begin) + base[docs]

    every = np.arange(len(first))
    full, _ = fit(every, np.full((len(first), langs), 1 / langs))
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, chosen, score = np.zeros(full.shape), rank < 1, np.full(len(first), -np.inf)
    open_ = every
    for k in range(1, langs + 1):
        start = np.where(rank[open_] < k, full[open_] + 1e-6, 0)
        # a word that no language of the set can have still needs some likelihood
        share, found = fit(open_, start / start.sum(1, keepdims=True))
        found = found - 0.5 * (k - 1) * np.log(np.maximum(counts[open_], 2))
        rises = found > score[open_]
        open_ = open_[rises]
        best[open_], chosen[open_], score[open_] = share[rises], rank[open_] < k, found[rises]
        if not len(open_):
            break
    return best, chosen


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, *, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` and ``languages`` (array of language and share, of the kept set); columns of these names give way."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score", "languages")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        names, table = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                pred, score, sets = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                grams, first, doc = trigrams([t or "" for t in batch.column("text").to_pylist()])
                if len(grams) and names:
                    words = np.add.reduceat(table[grams], first, axis=0)
                    heads = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    share, kept = mixtures(np.maximum(words, words.max(1, keepdims=True) - 60), heads)
                    best = np.where(kept, share, -1).argmax(1)
                    for k, d in enumerate(doc[heads].tolist()):
                        pred[d], score[d] = names[best[k]], min(1.0, float(share[k, best[k]]))
                        sets[d] = [{"lang": names[x], "share": float(share[k, x])} for x in np.flatnonzero(kept[k])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(pred, pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    ["row", "lang_pred", "score", "languages"],
                )

    shares = ArrayType(StructType().add("lang", StringType()).add("share", DoubleType()))
    schema = StructType([rows.schema["row"]]).add("lang_pred", StringType()).add("score", DoubleType()).add("languages", shares)
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "languages")


def identify(docs: DataFrame, training: Column, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predictions for all of ``docs`` by a model of the rows where ``training`` holds."""
    langs, model = train(docs.where(training), text_col=text_col, lang_col=lang_col)
    return predict(docs, langs, model, text_col=text_col)
