"""Mixing of sources to target weights by min-cost flow.

A document may belong to several sources. Documents are summed up by membership pattern; a flow
network routes the patterns' words to the sources' quotas:

    start -> pattern   one edge for each repetition up to ``MOST``, of the pattern's words, at a cost that
                       grows with the repetition (convex: nothing is repeated before all is used once)
    pattern -> source  for each source of the pattern
    source -> end      the source's quota

The flow is as great as the network holds, at the least cost: potentials from shortest paths, then blocking
flows over the edges of least cost, as costs are few. The network has a node for each pattern and source,
not for each document, and is solved on the driver; over ``PATTERNS`` patterns are an error. With one source a document no route is open to choice, and the
flow is each source's own quota; it decides where patterns overlap.

A pattern's flow then becomes documents: all of them are taken flow div size times, and the rest is
filled in a seeded order, by hash of the id, up to the last document that fits; the one that comes
nearest to what is still missing closes the gap if that helps. The order's sums are taken over
``BUCKETS`` ranges of the hash first and row by row only in the range where a pattern's rest ends, and
what is known of a pattern is broadcast, so a source that holds a third of all rows is no hot group.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a
target stops at ``MOST`` times its source's words and the excess is shared by weight among the others.
Null and empty texts have no words and are never in the way: they are taken with 0 words. A very
long text is one document, taken whole. Rows without an id are drawn by a hash of their text; ties
of the draw go by id and size. Rows equal in draw, id and size are taken one by one, any of them first. An empty table gives an
empty result. Columns of ``docs`` whose names are used here are read only where they are named.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

MOST = 3
WEIGHTS = (5, 2, 1)
BUCKETS = 4096
#: Membership patterns that the driver solves the flow for, and that are broadcast in a few columns; more are refused.
PATTERNS = 100_000
#: Seeded order: so many hex digits of a digest, 52 bits.
_DIGITS = 13


def words(text: Column) -> Column:
    """Number of runs of bytes other than space and the five controls from tab on; null: 0."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.filter(parts, lambda w: w != "")).cast("long")


def shares(sizes: dict, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> dict:
    """Target of each source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in order if s in stopped)
        scale = sum(weight[s] for s in order if s not in stopped)
        target = {s: float(most * sizes[s]) if s in stopped else float(rest) * weight[s] / scale for s in order}
        over = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not over:
            return target
        stopped |= over


def min_cost_flow(edges: list[tuple[int, int, int, int]], nodes: int, start: int, end: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) of a greatest flow of least cost; costs aren't negative."""
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, cap, c in edges:
        out[a].append(len(to))
        to.append(b), room.append(cap), cost.append(c)
        out[b].append(len(to))
        to.append(a), room.append(0), cost.append(-c)
    potential, level, arc = [0] * nodes, [0] * nodes, [0] * nodes

    def distances() -> bool:
        """Potentials from least costs; whether the end can be reached."""
        far, heap, done = {start: 0}, [(0, start)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for e in out[a]:
                b = to[e]
                if room[e] and b not in done:
                    new = d + cost[e] + potential[a] - potential[b]
                    if new < far.get(b, new + 1):
                        far[b] = new
                        heapq.heappush(heap, (new, b))
        if end not in done:
            return False
        for a in range(nodes):
            potential[a] += min(far.get(a, far[end]), far[end])
        return True

    def open_(e: int, a: int) -> bool:
        return room[e] > 0 and cost[e] + potential[a] == potential[to[e]]

    def levels() -> bool:
        level[:] = [-1] * nodes
        level[start], queue = 0, [start]
        for a in queue:
            for e in out[a]:
                if level[to[e]] < 0 and open_(e, a):
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level[end] >= 0

    def push() -> None:
        """A blocking flow over the edges of least cost that lead one level on."""
        arc[:] = [0] * nodes
        path, a = [], start
        while True:
            if a == end:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                path = path[: next(k for k, e in enumerate(path) if not room[e])]
                a = to[path[-1]] if path else start
            while arc[a] < len(out[a]):
                e = out[a][arc[a]]
                if level[to[e]] == level[a] + 1 and open_(e, a):
                    break
                arc[a] += 1
            else:
                if not path:
                    return
                level[a] = -1
                a = to[path.pop() ^ 1]
                arc[a] += 1
                continue
            path.append(e)
            a = to[e]

    while distances():
        while levels():
            push()
    return [room[2 * k + 1] for k in range(len(edges))]


def route(patterns: dict[tuple, int], quota: dict, most: int = MOST) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources."""
    keys, sources = sorted(patterns, key=repr), sorted(quota, key=repr)
    place = {s: 2 + len(keys) + k for k, s in enumerate(sources)}
    edges = []
    for k, p in enumerate(keys):
        edges += [(0, 2 + k, patterns[p], r) for r in range(most)]
        edges += [(2 + k, place[s], most * patterns[p], 0) for s in p]
    edges += [(place[s], 1, quota[s], 0) for s in sources]
    flow = min_cost_flow(edges, 2 + len(keys) + len(sources), 0, 1)
    back = {v: s for s, v in place.items()}
    out: dict[tuple, dict] = {p: {} for p in keys}
    for (a, b, _, _), f in zip(edges, flow, strict=True):
        if b in back and f:
            out[keys[a - 2]][back[b]] = f
    return out


def mix(docs: DataFrame, *, sources: Column | None = None, weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, the columns of ``keep``, sources, size, source_size and target (of its first source), copies and taken (words, copies counted).

    ``sources`` is an array of names (null is a name too); the column ``source`` alone by default.
    Sources and patterns go to the driver: their number must be far below that of documents.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "mixing")
    member = F.array_distinct(sources) if sources is not None else F.array(F.col("source").cast("string"))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}")).cast("binary")), 1, _DIGITS), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), member.alias("sources"), words(F.col(text_col).cast("string")).alias("size"), draw.alias("draw"), F.struct(F.lit(0).alias("_"), *keep).alias("own"))
    # numbered, so that equal rows can be told apart
    rows = space.put(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.shiftright("draw", 4 * _DIGITS - BUCKETS.bit_length() + 1).cast("int")), "rows")

    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(PATTERNS + 1).collect()
    if len(found) > PATTERNS:
        raise ValueError(f"over {PATTERNS} membership patterns")
    patterns = {tuple(r.sources): r.size for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    target = shares(sizes, weights, most)
    flows = route(patterns, {s: int(t + 0.5) for s, t in target.items()}, most)
    plan = []
    for p, n in patterns.items():
        flow = sum(flows[p].values())
        plan.append((list(p), sizes.get(p[0], 0) if p else 0, target[p[0]] if p else 0.0, flow // n if n else 1, flow % n if n else 0))
    plan = spark.createDataFrame(plan, "sources array<string>, source_size long, target double, base long, rest long")
    names = F.to_json(F.struct("sources"))  # arrays with nulls, compared by value
    # a row a pattern: PATTERNS at most
    rows, plan = rows.withColumn("p", names), F.broadcast(plan.withColumn("p", names).drop("sources"))

    sums = rows.groupBy("p", "bucket").agg(F.sum("size").alias("n"))
    upto = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("bucket"))).join(plan.select("p", "rest"), "p")
    last = space.put(upto.where("upto > rest").groupBy("p").agg(F.min("bucket").alias("last"), F.min(F.col("upto") - F.col("n")).alias("below")), "last")
    ends = rows.join(F.broadcast(last), "p").where("bucket = last").join(plan.select("p", "rest"), "p")
    order = Window.partitionBy("p").orderBy("draw", "i", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    ends = space.put(ends.withColumn("sum", F.col("below") + F.sum("size").over(order)).select("i", "p", "size", "draw", "row", "below", "rest", "sum"), "ends")
    # what the prefix leaves open, and the first document that isn't in it
    stop = ends.groupBy("p").agg(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))).alias("full"), F.min("below").alias("below"), F.max("rest").alias("rest"), F.min(F.when(F.col("sum") > F.col("rest"), F.struct("draw", "i", "size", "row"))).alias("stop"))
    stop = stop.select("p", (F.col("rest") - F.coalesce("full", "below")).alias("gap"), "stop")
    rows = rows.join(plan, "p", "left").join(F.broadcast(stop), "p", "left")
    place = F.struct("draw", "i", "size", "row")
    rows = rows.withColumn("extra", F.coalesce((F.col("rest") > 0) & (F.col("stop").isNull() | (place < F.col("stop"))), F.lit(False)))
    off = F.abs(F.col("gap") - F.col("size"))
    closing = rows.where((~F.col("extra")) & (F.col("gap") > 0) & (off < F.col("gap"))).groupBy("p").agg(F.min(F.struct(off.alias("off"), "draw", "i", "size", "row")).alias("c")).select(F.col("p").alias("cp"), F.col("c.row").alias("cr"))
    closing = F.broadcast(closing.withColumn("closes", F.lit(True)))
    rows = rows.join(closing, (F.col("p") == F.col("cp")) & (F.col("row") == F.col("cr")), "left")
    copies = F.col("base") + F.when(F.col("extra") | F.coalesce("closes", F.lit(False)), 1).otherwise(0)
    return rows.select(F.col("i").alias(id_col), *(F.col(f"own.{c}") for c in keep), "sources", "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
