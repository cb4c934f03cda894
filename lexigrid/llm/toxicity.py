"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model counts all words of all documents (64 symbols: a to z, accented
   Latin letters, one for other letters, one for word ends).
2. A token that holds digits or marks besides letters, or a letter three times on end, or
   a run of single characters with spaces between, is a lattice: a character may stand for the
   letters that look like it, a mark may be dropped or end a word, a repeated letter may be
   dropped. Viterbi decoding under channel costs and the character model restores the likeliest
   words. Plain words restore to themselves.
3. Scores come from restored words alone. On a sample of labelled rows (at most ``POSITIVES`` and
   ``NEGATIVES``, by a hash of the id) prefixes and whole words are counted by label; a feature's
   weight is the lower end of its log-odds. A logistic regression on five sums of these weights
   turns them into a probability; it is fitted on weights of the other half of the sample, with
   each class weighed by its share of all labelled rows.

Empty and null texts have no words and get the score of such a text; very long ones are read whole, in
a batch of their own. Rows that repeat a doc_id are scored each, and equal texts alike; without labelled
documents of both kinds every score is 0, and an empty table gives an empty result. Of equally likely
words the one found first stays.

What reaches the driver: 64**3 counts of trigrams at most, the ids of the sample, five sums a sampled
row, and those features of the sample (prefixes and words) that four toxic texts or more have and
fewer others: at most a quarter of the features of at most ``POSITIVES`` texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from .common import Memory, Workspace, only, slices
from .langid import letter_table

POSITIVES, NEGATIVES = 4000, 8000
PREFIXES = (4, 5, 6, 7, 8)
SYMBOLS = 64
#: Features that a task counts before it hands on what it has.
COUNTED = 200_000
#: Bytes of a worker's memory of tokens.
REMEMBERED = 32 << 20

#: Letters that a digit or mark may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "^": "a",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ı": "i",
}
#: Channel log-costs: a look-alike; its loss, if it is a digit or letter and if it is a mark; a lost repetition.
LOOK, LOSE, LOSE_MARK, REPEAT = -0.3, -8.0, -3.5, -0.7
#: A mark or space dropped, or as a word end: between single characters, and elsewhere.
SPACED_OUT, ELSEWHERE = (-0.2, -3.0), (-2.0, -0.3)
_SOFT = frozenset("!|(<+^")

_EDGES = ".,;:?\"'()[]{}…«»“”„‘’-"
_RUN = re.compile(r"(.)\1\1")
_TAIL = re.compile(r"([^\w\s])\1\1+$|^([^\w\s])\2\2+|[#&%*~]+$|^[#&%*~]+")
_SPACED = re.compile(r"(?<!\S)[\"'(\[]?\S(?:\s+\S){2,}[.,;:!?\"')\]]*(?!\S)")


def _symbol(c: str) -> int:
    """1 to 26: a to z; then the small letters of Latin-1; 60: other letters; 0: the rest."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if "ß" <= c <= "ÿ" and c != "÷":
        return 27 + ord(c) - 0xDF
    return 60 if c.isalpha() else 0


_TABLE: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    if not _TABLE:
        table = np.where(letter_table(), 60, 0).astype(np.uint8)
        for c in range(0x100):
            table[c] = _symbol(chr(c))
        _TABLE.append(table)
    return _TABLE[0]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("toxicity")
    counts = np.zeros(SYMBOLS**3, np.int64)
    for whole in batches:
        for batch in slices(whole, "text"):
            text = "\n\n" + "\n\n".join(t or "" for t in batch.column("text").to_pylist()).lower() + "\n"
            s = symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
            a, b, c = np.where(s[1:-1] > 0, s[:-2], 0), s[1:-1], s[2:]
            counts += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c)[(b > 0) | (c > 0)], minlength=SYMBOLS**3)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probability of each symbol after two others, interpolated with shorter contexts; 64**3 counts at most reach the driver."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    got = rows.mapInArrow(_count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SYMBOLS**3)
    n[got["gram"].to_numpy(np.int64)] = got["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = n.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * two) / (n.sum(2, keepdims=True) + 5)).reshape(-1)


class Restorer:
    """Likeliest words of tokens, under the channel and the character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        # Two states are alike once both have taken the same two letters (or word end), so a state that is
        # behind by more than three steps can differ by is on no best path.
        self.behind = 3 * float(np.abs(model).max())

    def lattice(self, token: str) -> list[tuple[list[tuple[str, float]], float | None, float | None]]:
        """For each character: letters with costs, the cost of losing it, and that of a word end in its place."""
        out, before = [], ""
        solid = [c in LOOKS or c.isalpha() for c in token]
        for k, c in enumerate(token):
            if c in LOOKS:
                lost = REPEAT if c == before else LOSE_MARK if c in _SOFT else LOSE
                out.append(([(x, LOOK) for x in LOOKS[c]], lost, -6.0 if c in _SOFT else None))
            elif c.isalpha():
                out.append(([(c, 0.0)], REPEAT if c == before else None, None))
            else:
                alone = not (k > 1 and solid[k - 1] and solid[k - 2]) and not (k + 2 < len(token) and solid[k + 1] and solid[k + 2])
                out.append(([], *(SPACED_OUT if alone else ELSEWHERE)))
            before = c
        return out

    def decode(self, token: str) -> list[str]:
        model = self.model
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for letters, drop, end in self.lattice(token):
            fresh: dict[tuple[int, int], tuple[float, tuple]] = {}
            options = [(x, _symbol(x), cost) for x, cost in letters]
            for (a, b), (score, path) in states.items():
                base = (a * SYMBOLS + b) * SYMBOLS
                for x, s, cost in options:
                    new, key = score + cost + model[base + s], (b, s)
                    if key not in fresh or new > fresh[key][0]:
                        fresh[key] = (new, (path, x))
                if drop is not None:
                    new = score + drop
                    if (a, b) not in fresh or new > fresh[a, b][0]:
                        fresh[a, b] = (new, path)
                if end is not None:
                    new = score + end + (model[base] if b else 0.0)
                    if (0, 0) not in fresh or new > fresh[0, 0][0]:
                        fresh[0, 0] = (new, (path, " "))
            if len(fresh) > 8:
                least = max(x[0] for x in fresh.values()) - self.behind
                fresh = {k: x for k, x in fresh.items() if x[0] >= least}
            states = fresh
        _, path = max(((score + (model[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0), path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            path, x = path
            out.append(x)
        return "".join(reversed(out)).split()

    def words(self, token: str) -> list[str]:
        """Restored words of a lower-cased token."""
        core = token.strip(_EDGES)
        if core.isalpha():
            plain = core
        else:
            plain = _TAIL.sub("", core).strip(_EDGES)
            if not plain or plain.isdigit():
                return []
        if plain.isalpha() and not _RUN.search(plain) and not any(c in LOOKS for c in plain if c > "\x7f"):
            return [plain]
        return self.decode(plain)


def restore(text: str, restorer: Restorer) -> str:
    """A whole text, restored: lower-cased words with single spaces between."""
    return " ".join(w for part in _parts(text.lower()) for w in (restorer.decode(part) if " " in part else restorer.words(part)))


def _spaced(run: str) -> str:
    """A run of single characters with one space between, without marks at its ends."""
    return " ".join(run.split()).strip(_EDGES + " ")


def _parts(text: str) -> list[str]:
    """Tokens in order; a run of single characters is one token with its spaces."""
    if not _SPACED.search(text):
        return text.split()
    out, last = [], 0
    for m in _SPACED.finditer(text):
        out += text[last : m.start()].split()
        out.append(_spaced(m[0]))
        last = m.end()
    return out + text[last:].split()


def features(word: str) -> list[str]:
    return [word[:k] for k in PREFIXES if len(word) >= k] + [word + "$"]


class Weigher:
    """Weights of a text's tokens; a worker remembers tokens, in a table that starts anew when full."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        self.restorer, self.weights, self.known = restorer, weights, Memory(REMEMBERED)

    def token(self, token: str) -> float:
        w = self.known.get(token)
        if w is None:
            words = self.restorer.decode(token) if " " in token else self.restorer.words(token)
            w = max((self.weights.get(f, 0.0) for x in words for f in features(x)), default=0.0)
            self.known.keep(token, w)
        return w

    def vector(self, text: str) -> list[float]:
        text = text.lower()
        tokens = set(text.split())
        if _SPACED.search(text):
            tokens.update(_spaced(m[0]) for m in _SPACED.finditer(text))
        strong = [w for w in map(self.token, tokens) if w > 0]
        total, size = sum(strong), np.log1p(len(tokens))
        return [np.log1p(total), max(strong, default=0.0), np.log1p(len(strong)), total / (1 + len(tokens)) ** 0.5, size]


def _samples(labelled: DataFrame) -> DataFrame:
    draw = F.xxhash64("i", F.lit(11))
    picked = [labelled.where(F.col("y") == y).select("i", "y", draw.alias("draw")).orderBy("draw", "i").limit(most) for y, most in ((1, POSITIVES), (0, NEGATIVES))]
    return picked[0].unionByName(picked[1])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method; the intercept isn't shrunk."""
    x = np.column_stack((x, np.ones(len(x))))
    b = np.zeros(x.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def _log_odds(pos: np.ndarray, neg: np.ndarray, p: float, n: float) -> np.ndarray:
    """Lower end (three standard errors) of the log-odds of a feature."""
    return np.log((pos + 0.5) / (p + 1)) - np.log((neg + 1) / (n + 1)) - 3 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 1) - 1 / (p + 1) - 1 / (n + 1)).clip(0) * 0.7


def train(docs: DataFrame, labels: DataFrame, space: Workspace) -> dict:
    """A model from ``docs`` (i, text) and ``labels`` (i, y): character model, weights and coefficients."""
    chars = character_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(chars)
    counts = {r.y: r.n for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    model = {"chars": chars, "weights": {}, "center": np.zeros(5), "scale": np.ones(5), "coef": None}
    if not counts.get(0) or not counts.get(1):
        return model
    picked = _samples(labels).withColumn("half", F.pmod("draw", F.lit(2)).cast("int"))
    # at most POSITIVES + NEGATIVES ids: a proven bound
    sample = space.put(docs.join(F.broadcast(picked.select("i", "y", "half")), "i"), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        restorer, table = Restorer(shared.value), Counter()

        def emit() -> pa.RecordBatch:
            f, y, half = zip(*table, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(y, pa.int32()), pa.array(half, pa.int32()), pa.array(table.values(), pa.int64())], ["f", "y", "half", "n"])
            table.clear()
            return out

        for batch in batches:
            for text, y, half in zip(*(batch.column(x).to_pylist() for x in ("text", "y", "half")), strict=True):
                table.update((f, y, half) for f in {f for w in set(restore(text or "", restorer).split()) for f in features(w)})
                if len(table) >= COUNTED:
                    yield emit()
        if table:
            yield emit()

    cell = lambda y, h: F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"c{y}{h}")
    rows = sample.mapInArrow(count, "f string, y int, half int, n long").groupBy("f").agg(*(cell(y, h) for y in (0, 1) for h in (0, 1)))
    got = rows.where("c10 + c11 >= 4 and c10 + c11 > c00 + c01").toPandas()
    sizes = {(r.y, r.half): r.n for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    size = lambda y, *h: sum(sizes.get((y, x), 0) for x in h)
    if not size(0, 0, 1) or not size(1, 0, 1):
        return model
    share = (counts[1] / size(1, 0, 1)) / (counts[0] / size(0, 0, 1))

    def weigh(*halves: int) -> dict[str, float]:
        pos, neg = (sum(got[f"c{y}{h}"].to_numpy(float) for h in halves) for y in (1, 0))
        w = _log_odds(pos, neg, size(1, *halves), size(0, *halves))
        return {f: float(x) for f, x, p in zip(got["f"], w, pos, strict=True) if x > 0 and p >= 3}

    folds = docs.sparkSession.sparkContext.broadcast([weigh(1), weigh(0)])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        weighers = [Weigher(restorer, w) for w in folds.value]
        for batch in batches:
            found = [weighers[h].vector(t or "") for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])

    seen = sample.mapInArrow(vectors, "y int, x array<double>").toPandas()
    x, y = np.stack(seen["x"].to_list()), seen["y"].to_numpy(float)
    center, scale = x.mean(0), x.std(0) + 1e-9
    coef = fit_logistic((x - center) / scale, y, np.where(y > 0, share, 1.0))
    return model | {"weights": weigh(0, 1), "center": center, "scale": scale, "coef": coef}


def score(docs: DataFrame, model: dict, *, text_col: str = "text", restored: bool = False) -> DataFrame:
    """``docs`` without its text, with ``score`` and ``predicted``; with ``restored``, also the restored text.

    Columns of ``docs`` with these names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text_col, "score", "predicted", "restored")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        m = shared.value
        restorer = Restorer(m["chars"])
        weigher = Weigher(restorer, m["weights"])
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                if m["coef"] is None:
                    found = np.zeros(len(texts))
                else:
                    x = (np.array([weigher.vector(t) for t in texts]) - m["center"]) / m["scale"]
                    found = 1 / (1 + np.exp(-np.clip(x @ m["coef"][:-1] + m["coef"][-1], -30, 30)))
                cols = [batch.column("row"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
                if restored:
                    cols.append(pa.array([restore(t, restorer) for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["row", "score", "predicted", "restored"][: len(cols)])

    schema = StructType([rows.schema["row"]]).add("score", DoubleType()).add("predicted", IntegerType())
    if restored:
        schema = schema.add("restored", StringType())
    return rows.mapInArrow(run, schema).select("row.*", *schema.names[1:])


def fit_and_score(docs: DataFrame, labels: DataFrame, training, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores of all of ``docs`` by a model of the labelled rows where ``training`` holds (a column of ``labels``).

    ``labels`` has the id and ``toxic``; labels of one id that disagree count as toxic.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    y = labels.where(training & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max("toxic").cast("int").alias("y"))
    model = train(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")), y, space)
    return score(docs.select(id_col, text_col, *keep), model, text_col=text_col)
