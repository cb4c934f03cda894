"""Metrics of a page from its n-grams, transitions, word positions and coarse grid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counts as C


def _bits(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(F.when(p > 0, p).otherwise(1.0))).otherwise(0.0)


def ngram_metrics(grams: DataFrame, min_count: int = 5) -> DataFrame:
    """Entropies over frequent n-grams with shares of all (not renormalised), diversity and ratios of totals; null without n-grams."""
    totals = grams.groupBy("folio", "n").agg(F.sum("cnt").alias("total"), F.count_if(F.col("cnt") >= min_count).alias("uniq"), F.collect_list(F.when(F.col("cnt") >= min_count, F.col("cnt"))).alias("cnts"))
    entropy = F.aggregate("cnts", F.lit(0.0), lambda s, c: s + _bits(c / F.col("total")))
    rows = totals.select("folio", "n", "total", "uniq", entropy.alias("entropy"))
    pick = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    out = rows.groupBy("folio").agg(pick("entropy", 1).alias("unigram_entropy"), pick("entropy", 2).alias("bigram_entropy"), pick("uniq", 1).alias("u"), pick("total", 1).alias("t1"), pick("total", 2).alias("t2"), pick("total", 3).alias("t3"))
    return out.select("folio", "unigram_entropy", "bigram_entropy", (F.col("u") / F.greatest("t1", F.lit(1))).alias("token_diversity"), (F.col("t2") / F.col("t1")).alias("bigram_ratio"), (F.col("t3") / F.col("t1")).alias("trigram_ratio"))


def transition_metrics(trans: DataFrame) -> DataFrame:
    """Entropy over all transitions of a page (borders included), their number, and number over total."""
    rows = trans.groupBy("folio").agg(F.sum("n").alias("total"), F.count("*").alias("unique_transitions"), F.collect_list("n").alias("ns"))
    entropy = F.aggregate("ns", F.lit(0.0), lambda s, n: s + _bits(n / F.col("total")))
    return rows.select("folio", entropy.alias("transition_entropy"), "unique_transitions", (F.col("unique_transitions") / F.col("total")).alias("transition_diversity"))


def position_metrics(positions: DataFrame) -> DataFrame:
    """Unweighted means over a page's glyphs."""
    rows = C.position_ratios(positions).where("total > 0")
    entropy = reduce(lambda a, b: a + b, (_bits(F.col(f"{p}_ratio")) for p in C.POSITIONS))
    return rows.groupBy("folio").agg(F.avg(entropy).alias("wordpos_entropy"), F.avg("start_ratio").alias("start_bias"), F.avg("end_ratio").alias("end_bias"))


def grid_metrics(grid: DataFrame, cols: int, rows: int) -> DataFrame:
    """Centre of mass in shares of the grid, and spread in cells."""
    s = lambda e: F.sum(e * F.col("n")).cast("double")
    out = grid.groupBy("folio").agg(F.sum("n").alias("m"), s(F.col("col")).alias("c"), s(F.col("row")).alias("r"), s(F.col("col") * F.col("col")).alias("cc"), s(F.col("row") * F.col("row")).alias("rr"))
    var = lambda v, vv: F.greatest(F.lit(0.0), F.col(vv) / F.col("m") - (F.col(v) / F.col("m")) * (F.col(v) / F.col("m")))
    return out.select("folio", (F.col("c") / F.col("m") / (cols - 1)).alias("page_center_x"), (F.col("r") / F.col("m") / (rows - 1)).alias("page_center_y"), F.sqrt(var("c", "cc") + var("r", "rr")).alias("page_spread"))


#: Columns of ``page_metrics`` by the kind of metrics that they belong to.
KINDS = {
    "ngram": ("unigram_entropy", "bigram_entropy", "token_diversity", "bigram_ratio", "trigram_ratio"),
    "markov": ("transition_entropy", "unique_transitions", "transition_diversity"),
    "wordpos": ("wordpos_entropy", "start_bias", "end_bias"),
    "pagepos": ("page_center_x", "page_center_y", "page_spread"),
}


def page_metrics(sums: DataFrame, cols: int, rows: int) -> DataFrame:
    """All metrics of a page in one row: those of ``ngram_metrics``, ``transition_metrics``, ``position_metrics`` and ``grid_metrics``.

    They follow from a page's ``pages.page_sums``, so each text is normalised and counted once.
    """
    # the sum of -p log p over some counts, with p their shares of t
    entropy = lambda t, f, b: F.when(F.col(t).isNotNull(), F.coalesce((F.col(f) * F.log2(t) - F.col(b)) / F.col(t), F.lit(0.0)))
    var = lambda v, vv: F.greatest(F.lit(0.0), F.col(vv) / F.col("m") - (F.col(v) / F.col("m")) * (F.col(v) / F.col("m")))
    return sums.select(
        "folio",
        entropy("t1", "f1", "b1").alias("unigram_entropy"),
        entropy("t2", "f2", "b2").alias("bigram_entropy"),
        (F.col("u1") / F.greatest("t1", F.lit(1.0))).alias("token_diversity"),
        (F.col("t2") / F.col("t1")).alias("bigram_ratio"),
        (F.col("t3") / F.col("t1")).alias("trigram_ratio"),
        entropy("tt", "tt", "bt").alias("transition_entropy"),
        F.col("ut").alias("unique_transitions"),
        (F.col("ut") / F.col("tt")).alias("transition_diversity"),
        "wordpos_entropy",
        "start_bias",
        "end_bias",
        (F.col("c") / F.col("m") / (cols - 1)).alias("page_center_x"),
        (F.col("r") / F.col("m") / (rows - 1)).alias("page_center_y"),
        F.sqrt(var("c", "cc") + var("r", "rr")).alias("page_spread"),
    )


def join_all(*tables: DataFrame) -> DataFrame:
    """Full join by folio: pages of any of the tables."""
    return reduce(lambda a, b: a.join(b, "folio", "full"), tables)


def join_first(tables: list[DataFrame], attributes: tuple[str, ...]) -> DataFrame:
    """Full join by folio of tables that carry attributes; those of the first table that has the page count."""
    named = [t.withColumnsRenamed({a: f"{a}_{k}" for a in attributes}) for k, t in enumerate(tables)]
    out = join_all(*named).withColumns({a: F.coalesce(*(f"{a}_{k}" for k in range(len(tables)))) for a in attributes})
    return out.drop(*(f"{a}_{k}" for a in attributes for k in range(len(tables))))
