"""Interaction of filters: what each filter removes in every order that filters can be applied in.

Filters are tests of a row by itself, and one for duplicates: a text that a row of a smaller id has. A
row's failures make a mask, a bit for each filter; whatever an order of filters does is a sum over masks,
so rows are counted once by part and mask, and all orders come from these counters.

Duplicates are found by sorting: rows are dealt out in ranges of a text's fingerprint and the id, and
sorted by fingerprint, full text and id inside a range, so equal texts stand together and each row is
compared with its predecessor. Ranges leave the full text out because their borders are sampled on the
driver, where texts have no place; with the id in them, copies of one text, however many, are dealt
out to as many ranges as they need. Groups of equal texts at a range's border, those of its first and its
last fingerprint, may go on in other ranges: each range reports them with their smallest id, a handful
of rows, and these are joined by fingerprint and full text.

A null text counts as empty, and so does a null part. Very long texts are compared as a whole. A null id
comes after all others, and is no smaller than another null. Rows that repeat an id with the same text
are alike: all of them fail if a smaller id has the text, else none. An id counts as good or toxic if any of
its labels says so; labels of no row, and null ids or values there, count for nothing. An empty table
gives an empty result. Columns are read by name and renamed at once, so further ones may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
MARKS = "[#$%&*|]"

#: Letters of filters in the order of their bits; the last is that of duplicates.
LETTERS = "ABCDE"


def tests(text: Column, words: Column) -> list[Column]:
    """Failure conditions of a row by itself: short, repetitive, many capitals, marks."""
    return [
        F.size(words) < WORDS,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * CAPITALS_PERCENT,
        text.rlike(MARKS),
    ]


def _predecessors(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers the groups of equal (fp, t) of a sorted range and tells each row its group's first id.

    Rows (edge is false) come out without their text; a row with edge tells of a group of the range's first or last fp.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        number, first_fp, fp, text, first = -1, None, None, None, None
        last: list[tuple] = []  # groups of the latest fp

        def edges(groups: list[tuple]) -> pa.RecordBatch:
            g, f, t, i = zip(*groups, strict=True)
            n = len(g)
            values = {"range": [at] * n, "g": g, "i": [None] * n, "part": [None] * n, "mask": [None] * n, "first": i, "edge": [True] * n, "fp": f, "t": t}
            return pa.RecordBatch.from_arrays([pa.array(values[c.name], c.type) for c in schema], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fps, texts, ids = (batch.column(c) for c in ("fp", "t", "i"))
            code = fps.to_numpy()
            new = np.ones(n, bool)
            new[0] = code[0] != fp or texts[0].as_py() != text
            new[1:] = (code[1:] != code[:-1]) | ~pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            groups = number + np.cumsum(new)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            firsts = pa.concat_arrays([pa.array([first], ids.type), ids]).take(pa.array(start + 1))
            if first_fp is None:
                first_fp = code[0]
            begun = lambda k: (int(groups[k]), int(code[k]), texts[k].as_py(), ids[k].as_py())  # noqa: B023, E731
            if found := [begun(k) for k in np.flatnonzero(new & (code == first_fp))]:
                yield edges(found)
            if code[-1] != fp:
                last = []
            last += [begun(k) for k in np.flatnonzero(new & (code == code[-1]))]
            whole = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)  # noqa: B023, E731
            columns = {"range": whole(at, pa.int32()), "g": pa.array(groups, pa.int64()), "i": ids, "part": batch.column("part"), "mask": batch.column("mask"), "first": firsts, "edge": whole(False, pa.bool_()), "fp": whole(None, pa.int64()), "t": whole(None, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c.name].cast(c.type) for c in schema], schema=schema)
            number, fp, text, first = int(groups[-1]), code[-1], texts[n - 1].as_py(), firsts[n - 1].as_py()
        if last and fp != first_fp:
            yield edges(last)

    return run


def failures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(i, part, mask) of each row: bit k is set if it fails the filter of letter k."""
    space = Workspace(docs.sparkSession, "audit")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    order = F.col("i").asc_nulls_last()
    rows = rows.withColumn("fp", fingerprint(F.col("t"))).repartitionByRange("fp", order).sortWithinPartitions("fp", "t", order)
    # masks are made after the exchange, as rows are read twice before it, once for the ranges' borders
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    mask = reduce(lambda a, b: a + b, (F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests(F.col("t"), F.col("w")))))
    rows = rows.select("i", "t", "part", "fp", mask.alias("mask"))
    kind = dict(rows.dtypes)["i"]
    ids = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    out = pa.schema([("range", pa.int32()), ("g", pa.int64()), ("i", ids), ("part", pa.string()), ("mask", pa.int32()), ("first", ids), ("edge", pa.bool_()), ("fp", pa.int64()), ("t", pa.string())])
    found = space.put(rows.mapInArrow(_predecessors(out), f"range int, g long, i {kind}, part string, mask int, first {kind}, edge boolean, fp long, t string"), "sorted")

    edges = found.where("edge").select("range", "g", "fp", "t", "first")
    spread = edges.groupBy("fp", "t").agg(F.min("first").alias("least"), F.count("*").alias("n")).where("n > 1")
    # groups of two fingerprints for each range
    least = edges.join(spread, ["fp", "t"]).select("range", "g", "least")
    rows = found.where("not edge").join(F.broadcast(least), ["range", "g"], "left").withColumn("first", F.coalesce("least", "first"))
    later = F.col("first").isNotNull() & (F.col("i").isNull() | (F.col("i") > F.col("first")))
    return rows.select("i", "part", (F.col("mask") + F.when(later, 1 << len(LETTERS) - 1).otherwise(0)).alias("mask"))


def counters(masks: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, and those of good and of toxic ids. Counters of several tables can be added."""
    said = labels.select(F.col(id_col).alias("i"), "quality", "toxic").groupBy("i").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    # an id that many rows repeat has few masks
    rows = masks.groupBy("i", "part", "mask").agg(F.count("*").alias("n")).join(said, "i", "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of ``letters``.

    A filter comes first of a mask's filters in one of as many orders as the mask has bits, which gives
    shapley without a sum over orders.
    """
    bits = F.create_map(*(x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))))
    bit = [F.element_at(bits, F.substring("filter_order", k + 1, 1)) for k in range(len(letters))]
    step = lambda k: F.struct(F.lit(k + 1).alias("step"), bit[k].alias("bit"), reduce(lambda a, b: a + b, bit[:k], F.lit(0)).alias("before"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("s", F.explode(F.array(*map(step, range(len(letters))))))
    rows = rows.select("*", "s.step", (F.col("mask").bitwiseAND(F.col("s.bit")) != 0).alias("fails"), (F.col("mask").bitwiseAND(F.col("s.before")) != 0).alias("gone"), (F.col("mask") == F.col("s.bit")).alias("only"))
    of = lambda test, value, name: F.sum(F.when(test, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long").alias(name)
    fails, gone = F.col("fails"), F.col("gone")
    return rows.groupBy("part", "filter_order", "step").agg(
        of(~fails & ~gone, "n", "kept"),
        of(fails & ~gone, "n", "removed"),
        of(fails & gone, "n", "redundant"),
        of(F.col("only"), "n", "unique_fails"),
        of(fails & ~gone, "good", "good_lost"),
        of(fails & ~gone, "toxic", "toxic_lost"),
        of(fails, F.col("n") * (F.lit(factorial(len(letters))) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long"), "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``interactions`` of all filters over ``docs``."""
    space = Workspace(docs.sparkSession, "audit")
    masks = failures(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    return interactions(space.put(counters(masks, labels, id_col=id_col), "counters"))
