"""Masked pseudo-likelihood of documents.

Tokens are lower-cased words (runs of letters, digits and non-ASCII bytes) and single marks. All
tokens of the corpus are counted. The ``KNOWN`` most frequent are outputs of their own; any other
is a rare token, told apart by its hash in ``CLASSES`` classes.

A window network predicts each token from the ``SIDE`` tokens on either side: an embedding of each
token for each place of the window, their sum through tanh as the hidden layer, a softmax over
groups of tokens and one over the tokens of the group (rare tokens are group 0). A rare token's
conditional probability is that of its group times its class's counted share of all rare tokens.
A document's pseudo-log-likelihood is the sum of the conditional log-probabilities of its tokens,
each with its neighbours on both sides given.

Training sees every window of the corpus, as often as it occurs, once (``epochs`` times). Each row is in one
of ``ROUNDS`` rounds, and of one of the round's replicas, by a hash of the row: there is one for each ``SHARE``
tokens, and it goes through its texts in the order of their hashes, from the shared start. So neither files nor
tasks decide what a replica sees, and copies of one text are dealt out as other texts are. The replicas'
parameters are averaged by pieces, weighed by windows, ``FAN`` of them at a time; no task or driver holds more
than one network and one sum.

What reaches the driver or is broadcast: ``KNOWN`` tokens with counts, a 2-byte count a class, one network.

Null and empty texts have no tokens, pll 0 and a null mean; a very long text is taken in pieces.
Equal texts have equal scores (to rounding), whatever their ids; rows that repeat an id are scored each. Tokens of equal
frequency are ordered by hash. An empty corpus gives the untrained network and an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PowerTable, Workspace, byte_column, holds, mix, only, slices

#: Neighbours on either side, hidden values, tokens of a group, and groups but for that of rare tokens.
SIDE, HIDDEN, GROUP, GROUPS = 3, 16, 96, 31
KNOWN = GROUP * GROUPS
#: Classes of rare tokens as inputs, and as outputs; classes of a page that one row holds.
INPUTS, CLASSES, PAGE = 1024, 1 << 22, 4096
ROUNDS, BATCH, RATE = 4, 1 << 14, 0.15
#: Tokens that a replica goes through in a round.
SHARE = 2_000_000
#: Distinct tokens that a counting worker holds, pieces that a network is averaged by, and networks that are averaged at a time.
HELD, PIECES, FAN = 1_000_000, 32, 64
OUTSIDE = 0
PIECE_SCHEMA = "replica long, piece long, weight double, net binary"

_WIDE = 2 * SIDE * HIDDEN
_POWER = PowerTable(0x9FB21C651E98DF25, "pseudo")
# 0: space, 1: part of a word, 2: a mark
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each token, and the number of tokens of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off) - 1, np.int64)
    kind = _KIND[raw]
    part = kind == 1
    joins = np.zeros(n + 1, bool)  # whether a byte goes on with the word of the byte before it
    joins[1:n] = part[1:] & part[:-1]
    joins[off] = False
    solid = kind > 0
    starts = np.flatnonzero(solid & ~joins[:-1])
    ends = np.flatnonzero(solid & ~joins[1:]) + 1
    up, down = _POWER.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_LOWER[raw] * up[:n], out=sums[1:])
        found = mix((sums[ends] - sums[starts]) * down[starts])
    return found, np.diff(np.searchsorted(starts, off))


class Vocabulary:
    """Known tokens by hash, most frequent first, and counts of the classes of rare ones."""

    def __init__(self, known: np.ndarray, classes: np.ndarray, rare: int):
        self.known, self.classes, self.rare = known.astype(np.uint64), classes, rare
        # a place for each known token, without a clash
        self.salt = 0
        while True:
            place = self._place(self.known)
            if len(np.unique(place)) == len(place):
                break
            self.salt += 1
        self.table = np.zeros(CLASSES, np.int16)
        self.table[place] = np.arange(len(place), dtype=np.int16)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (mix(h ^ np.uint64(self.salt)) & np.uint64(CLASSES - 1)).astype(np.int64)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """Rank of each token, -1 for rare ones."""
        if not len(self.known):
            return np.full(len(h), -1)
        at = self.table[self._place(h)].astype(np.int64)
        return np.where(self.known[at] == h, at, -1)

    def shares(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-share of rare tokens among the rare, and whether the corpus has them once at most."""
        log = self.classes[(h & np.uint64(CLASSES - 1)).astype(np.int64)].astype(np.float64)
        return np.maximum(log, 0) - np.log(self.rare + 1), log <= 0


def fresh(known: int = KNOWN, seed: int = 3) -> dict[str, np.ndarray]:
    """Untrained parameters for so many known tokens."""
    rng, groups = np.random.default_rng(seed), 1 + -(-known // GROUP)
    draw = lambda scale, *s: (scale * rng.standard_normal(s)).astype(np.float32)
    return {
        "emb": draw(0.1, 1 + known + INPUTS, _WIDE),
        "b": np.zeros(HIDDEN, np.float32),
        "wg": draw(0.1, HIDDEN, groups),
        "bg": np.zeros(groups, np.float32),
        "wt": draw(0.1, groups, HIDDEN, GROUP),
        # the last group may have fewer tokens
        "bt": np.where(np.arange(groups * GROUP).reshape(groups, GROUP) < GROUP + known, 0, -1e9).astype(np.float32),
    }


def lay_out(h: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of all texts with ``SIDE`` outsides around each, ranks beside them, and where the tokens are among them."""
    rank = vocabulary.ranks(h)
    token = np.where(rank >= 0, rank + 1, 1 + len(vocabulary.known) + (h >> np.uint64(40)).astype(np.int64) % INPUTS)
    at = np.arange(len(h)) + np.repeat(SIDE * (np.arange(len(sizes)) + 1), sizes)
    inputs = np.full(len(h) + SIDE * (len(sizes) + 1), OUTSIDE, np.int32)
    inputs[at] = token
    return inputs, rank, at


def _softmax(z: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of one column of each row, and the probabilities (in place of ``z``)."""
    np.minimum(z, 80, out=z)  # no more is needed against overflow, as hidden values are within 1
    own = z[np.arange(len(z)), of]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], np.float32)
    z /= total[:, None]
    return own - np.log(total), z


def _sums(rows: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each token, and the tokens."""
    order = np.argsort(token.astype(np.int16), kind="stable")
    by, rows = token[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))
    count = np.diff(np.append(first, len(by)))
    out = rows[first]
    ones = np.ones(len(rows), rows.dtype)
    for k in np.flatnonzero(count > 8).tolist():
        a, n = first[k], count[k]
        out[k] = ones[:n] @ rows[a : a + n]
    few = np.where(count > 8, 0, count)
    for j in range(1, 8):
        some = np.flatnonzero(few > j)
        out[some] += rows[first[some] + j]
    return out, by[first]


class Network:
    """Forward and backward passes over stretches of tokens."""

    def __init__(self, net: dict[str, np.ndarray], rate: float = 0.0):
        self.net, self.rate = net, np.float32(rate)
        if rate:
            self.net = {k: v.copy() for k, v in net.items()}
            self.power = {k: np.full(v.shape, 1e-6, np.float32) for k, v in net.items()}

    def hidden(self, inputs: np.ndarray) -> np.ndarray:
        """Hidden values at each place of a stretch; those near its ends lack neighbours."""
        rows = self.net["emb"].take(inputs, 0)
        pre = np.repeat(self.net["b"][None], len(inputs), 0)
        for d in range(1, SIDE + 1):
            left, right = (d - 1) * HIDDEN, (SIDE + d - 1) * HIDDEN
            pre[d:] += rows[:-d, left : left + HIDDEN]
            pre[:-d] += rows[d:, right : right + HIDDEN]
        return np.tanh(pre)

    def outputs(self, h: np.ndarray, rank: np.ndarray, dh: np.ndarray | None = None) -> np.ndarray:
        """Log-probabilities of tokens (rare ones: of their group); with ``dh``, gradients go there and parameters take a step."""
        net = self.net
        group = np.where(rank >= 0, 1 + rank // GROUP, 0)
        order = np.argsort(group.astype(np.int16), kind="stable")
        h, rank, group = h[order], rank[order], group[order]
        back = np.empty_like(h)
        log, dz = _softmax(h @ net["wg"] + net["bg"], group)
        if dh is not None:
            dz[np.arange(len(h)), group] -= 1
            np.matmul(dz, net["wg"].T, out=back)
            wg, bg = h.T @ dz, dz.sum(0)
        ends = np.searchsorted(group, np.arange(len(net["bg"]) + 1))
        for g in range(1, len(net["bg"])):
            of = slice(ends[g], ends[g + 1])
            x, place = h[of], rank[of] - (g - 1) * GROUP
            if not len(x):
                continue
            own, dz = _softmax(x @ net["wt"][g] + net["bt"][g], place)
            log[of] += own
            if dh is not None:
                dz[np.arange(len(x)), place] -= 1
                back[of] += dz @ net["wt"][g].T
                self._step("wt", x.T @ dz, g)
                self._step("bt", dz.sum(0), g)
        if dh is not None:
            self._step("wg", wg)
            self._step("bg", bg)
            dh[order] = back
        out = np.empty_like(log)
        out[order] = log
        return out

    def _step(self, name: str, grad: np.ndarray, at=slice(None)) -> None:
        """Adagrad: each parameter's steps shrink with the squares of its gradients so far."""
        self.power[name][at] += grad * grad
        self.net[name][at] -= self.rate * grad / np.sqrt(self.power[name][at])

    def train(self, inputs: np.ndarray, rank: np.ndarray, at: np.ndarray) -> float:
        """One step over the windows of a stretch; the sum of losses before it."""
        hidden = self.hidden(inputs)
        h = hidden[at]
        dh = np.zeros_like(h)
        loss = -float(self.outputs(h, rank, dh).sum())
        pre = np.zeros_like(hidden)
        pre[at] = dh * (1 - h * h)
        back = np.zeros((len(inputs), _WIDE), np.float32)
        for d in range(1, SIDE + 1):
            left, right = (d - 1) * HIDDEN, (SIDE + d - 1) * HIDDEN
            back[:-d, left : left + HIDDEN] = pre[d:]
            back[d:, right : right + HIDDEN] = pre[:-d]
        self._step("emb", *_sums(back, inputs))
        self._step("b", pre.sum(0))
        return loss

    def stretches(self, inputs: np.ndarray, rank: np.ndarray, at: np.ndarray, size: int = BATCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows by ``size``, each with its neighbours: (inputs, ranks, places of the tokens among the inputs)."""
        for start in range(0, len(at), size):
            some = at[start : start + size]
            low = some[0] - SIDE
            yield inputs[low : some[-1] + SIDE + 1], rank[start : start + size], some - low

    def score(self, inputs: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probabilities of all tokens (rare ones: of their group)."""
        return np.concatenate([np.zeros(0, np.float32), *(self.outputs(self.hidden(x)[c], r) for x, r, c in self.stretches(inputs, rank, at))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens; what a worker holds is merged, and handed on when it grows large."""
    only("pseudo")
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h = np.concatenate([a for a, _ in held])
        order = np.argsort(h)
        h, n = h[order], np.concatenate([b for _, b in held])[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(n, first)

    def rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for whole in batches:
        for batch in slices(whole, "text"):
            found, _ = hashes(*byte_column(batch.column("text")))
            if len(found):
                held.append(np.unique(found, return_counts=True))
                waiting += len(held[-1][0])
            if waiting > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield rows(*held.pop())
                waiting = len(held[0][0]) if held else 0
    if held:
        yield rows(*merged())


def vocabulary_of(docs: DataFrame, space: Workspace) -> tuple[Vocabulary, int]:
    """The vocabulary of ``docs`` (text), and the number of its tokens."""
    counts = space.put(docs.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = counts.orderBy(F.desc("n"), "h").limit(KNOWN).collect()
    known = np.array([r.h for r in top], np.int64).view(np.uint64)
    shared = space.spark.sparkContext.broadcast(np.sort(known))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            h, n = b.column("h").to_numpy().view(np.uint64), b.column("n").to_numpy()
            rare = ~np.isin(h, shared.value)
            c, n = (h[rare] & np.uint64(CLASSES - 1)).astype(np.int64), n[rare]
            for page in np.unique(c // PAGE).tolist():
                of = c // PAGE == page
                held.setdefault(page, np.zeros(PAGE, np.int64))
                np.add.at(held[page], c[of] % PAGE, n[of])
        for page, n in held.items():
            log = np.where(n > 0, np.log(np.maximum(n, 1)), -1).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([page]), pa.array([int(n.sum())]), pa.array([log.tobytes()], pa.binary())], ["page", "n", "log"])

    by = F.shiftright(F.col("h").bitwiseAND(F.lit(CLASSES - 1)), PAGE.bit_length() - 1)
    classes, rare = np.full(CLASSES, -1, np.float16), 0
    dealt = counts.withColumn("page", by).repartition("page").sortWithinPartitions("page").select("h", "n")
    for r in dealt.mapInArrow(pages, "page long, n long, log binary").collect():
        classes[r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.log, np.float16)
        rare += r.n
    space.drop("counts")
    return Vocabulary(known, classes, rare), int(total)


def _flat(net: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of pieces by group, which come one after another; a task holds one sum."""
    at, weight, total = None, 0.0, None

    def mean() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["replica", "piece", "weight", "net"])

    for batch in batches:
        for group, piece, own, values in zip(*(batch.column(x) for x in ("group", "piece", "weight", "net")), strict=True):
            if at != (group.as_py(), piece.as_py()):
                if at is not None:
                    yield mean()
                at, weight, total = (group.as_py(), piece.as_py()), 0.0, 0.0
            weight += own.as_py()
            total = total + own.as_py() * np.frombuffer(values.as_buffer(), np.float32).astype(np.float64)
    if at is not None:
        yield mean()


def averaged(pieces: DataFrame, replicas: int) -> DataFrame:
    """(replica, piece, weight, net) of a single replica: the means over all, in layers, each in a fixed order."""
    while True:
        groups = -(-replicas // FAN)
        dealt = pieces.withColumn("group", F.floor(F.col("replica") / FAN)).repartition(PIECES * groups, "group", "piece").sortWithinPartitions("group", "piece", "replica")
        pieces = dealt.select("group", "piece", "weight", "net").mapInArrow(_average, PIECE_SCHEMA)
        if groups == 1:
            return pieces
        replicas = groups


_READ: dict[int, Vocabulary] = {}
holds("pseudo", _READ.clear)


def _own(shared) -> Vocabulary:
    """The worker's copy of the vocabulary."""
    if shared.id not in _READ:
        _READ.clear()
        _READ[shared.id] = Vocabulary(*pickle.loads(shared.shared.value))
    return _READ[shared.id]


class _Shared:
    """A broadcast vocabulary with a name that workers know it by."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.shared = spark.sparkContext.broadcast(pickle.dumps((vocabulary.known, vocabulary.classes, vocabulary.rare)))
        self.id = hash((vocabulary.known.tobytes(), vocabulary.rare))


def train(docs: DataFrame, space: Workspace, *, seed: int = 3, epochs: int = 1) -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """The vocabulary and the network of ``docs`` (text, and further columns that tell rows apart)."""
    spark = docs.sparkSession
    vocabulary, size = vocabulary_of(docs.select("text"), space)
    shared = _Shared(spark, vocabulary)
    net = fresh(len(vocabulary.known), seed)
    replicas = max(1, -(-size // (ROUNDS * SHARE)))
    row = F.xxhash64(*docs.columns)
    rows = docs.select("text", row.alias("row"), F.pmod(row, F.lit(ROUNDS * replicas)).alias("part"))
    for k in range(ROUNDS if size else 0):
        start = spark.sparkContext.broadcast(pickle.dumps(net))
        rate = RATE * 0.6**k
        texts = rows.where(F.col("part") % ROUNDS == k).select("text", "row", F.floor(F.col("part") / ROUNDS).cast("int").alias("replica"))

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            only("pseudo")
            words, replica, network, seen = _own(shared), None, None, 0

            def pieces() -> Iterator[pa.RecordBatch]:
                for piece, part in enumerate(np.array_split(_flat(network.net), PIECES)):
                    yield pa.RecordBatch.from_arrays([pa.array([replica]), pa.array([piece]), pa.array([float(seen)]), pa.array([part.tobytes()], pa.binary())], ["replica", "piece", "weight", "net"])

            for whole in batches:
                own = whole.column("replica").to_numpy()
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if low == high:
                        continue
                    if own[low] != replica:
                        if seen:
                            yield from pieces()
                        replica, network, seen = int(own[low]), Network(pickle.loads(start.value), rate), 0
                    for batch in slices(whole.slice(low, high - low), "text"):
                        h, sizes = hashes(*byte_column(batch.column("text")))
                        laid = lay_out(h, sizes, words)
                        seen += len(h)
                        for _ in range(epochs):
                            for stretch in network.stretches(*laid):
                                network.train(*stretch)
            if seen:
                yield from pieces()

        dealt = texts.repartitionById(replicas, F.col("replica")).sortWithinPartitions("replica", "row", "text").select("text", "replica")
        found = averaged(dealt.mapInArrow(run, PIECE_SCHEMA), replicas).collect()
        start.unpersist()
        if found:
            net = _shaped(np.concatenate([np.frombuffer(p.net, np.float32) for p in sorted(found, key=lambda p: p.piece)]), net)
    return vocabulary, net


def score(docs: DataFrame, vocabulary: Vocabulary, net: dict[str, np.ndarray], *, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_once (tokens that the corpus has once), pll (sum of log-probabilities) and mean_pll; columns of these names give way."""
    shared, given = _Shared(docs.sparkSession, vocabulary), docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_once", "pll", "mean_pll")]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("pseudo")
        words, network = _own(shared), Network(pickle.loads(given.value))
        for whole in batches:
            for batch in slices(whole, "text"):
                h, sizes = hashes(*byte_column(batch.column("text")))
                inputs, rank, at = lay_out(h, sizes, words)
                log = network.score(inputs, rank, at).astype(np.float64)
                share, once = words.shares(h)
                log += np.where(rank < 0, share, 0)
                ends = np.cumsum(sizes)
                total = lambda x: (s := np.concatenate(([0], np.cumsum(x))))[ends] - s[ends - sizes]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sizes), pa.array(total((once & (rank < 0)).astype(np.int64)).astype(np.int64)), pa.array(total(log).astype(np.float64))], ["row", "n_tokens", "n_once", "pll"])

    schema = rows.select("row", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_once"), F.lit(0.0).alias("pll")).schema
    out = rows.mapInArrow(run, schema).select("row.*", "n_tokens", "n_once", "pll")
    return out.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")))


def fit_and_score(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), epochs: int = 1) -> DataFrame:
    """``score`` of ``docs`` by a model of themselves. The columns ``keep`` tell copies of a text apart when they are dealt out, and are no input of the model."""
    space = Workspace(docs.sparkSession, "pseudo")
    own = [F.col(c).alias(f"k{k}") for k, c in enumerate(keep) if c != text_col]
    model = train(docs.select(F.col(text_col).cast("string").alias("text"), *own), space, epochs=epochs)
    return score(docs.select(*keep, text_col), *model, text_col=text_col)
