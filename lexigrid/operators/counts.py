"""Counts of glyphs, n-grams, transitions and positions: one explode and one aggregate by page each.

Inputs are the rows of ``Corpus.words``; outputs are long tables keyed by ``folio``. Per-group tables
come from ``groups.roll_up``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Stands before the two tokens of a border's item, and between them; no glyph is one.
_MARK = "\x01"


def _grams(word: Column, n: int) -> Column:
    size = F.length(word) - (n - 1)
    return F.when(size >= 1, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _each(rows: DataFrame, by: tuple[str, ...], array: Column, name: str) -> DataFrame:
    """(*by, name) for every element of an array.

    The explode is an outer one: for an inner one the optimiser tests the array's size in a filter
    below, which makes the array twice.
    """
    return rows.select(*by, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def word_counts(words: DataFrame, by: tuple[str, ...], items: Column | None = None, summed: bool = True) -> DataFrame:
    """(*by, w, m): how often each word (or item) occurs, so that what follows works on distinct words.

    By page there is little to gain, and a stream aggregates once, so there, and where they aren't to be
    ``summed``, each occurrence stays a row with m = 1.
    """
    rows = _each(words, by, F.col("words") if items is None else items, "w")
    return rows.withColumn("m", F.lit(1).cast("long")) if "folio" in by or words.isStreaming or not summed else rows.groupBy(*by, "w").agg(F.count("*").alias("m"))


def ngrams(words: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), by: tuple[str, ...] = ("folio",)) -> DataFrame:
    """(*by, n, ngram, cnt) inside words."""
    return ngrams_of(word_counts(words, by), sizes, by)


def ngrams_of(counted: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), by: tuple[str, ...] = ("folio",)) -> DataFrame:
    """``ngrams`` of ``word_counts``."""
    grams = F.concat(*(_grams(F.col("w"), n) for n in sizes))
    rows = _each(counted, (*by, "m"), grams, "ngram")
    return rows.groupBy(*by, "ngram").agg(F.sum("m").alias("cnt")).withColumn("n", F.length("ngram"))


def frequencies(counts: DataFrame, by: tuple[str, ...], min_count: int = 1) -> DataFrame:
    """Adds total (of all n-grams of a size), freq, and keeps those of ``min_count`` or more, with their number ``unique``."""
    whole = Window.partitionBy(*by, "n")
    rows = counts.withColumn("total", F.sum("cnt").over(whole)).where(F.col("cnt") >= min_count)
    return rows.withColumn("uniq", F.count("*").over(whole)).withColumn("freq", F.col("cnt") / F.col("total"))


def top(counts: DataFrame, by: tuple[str, ...], measure: Column, token: str, k: int) -> DataFrame:
    """The first ``k`` by measure, then by token."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(measure, F.col(token)))
    return counts.withColumn("rank", place).where(F.col("rank") <= k)


def _square(rows: DataFrame, by: tuple[str, ...], tokens: Column, pair: Column, value: Column, ends: tuple[str, str]) -> DataFrame:
    """(*by, *ends, value, total) for all pairs of a group's tokens, 0 where missing.

    A group is one row with its tokens and counts, as alphabets are small and bounded: one aggregate
    gives both, so ``rows`` is made once.
    """
    known = F.sort_array(F.collect_set(tokens)).alias("tokens")
    counts = F.map_from_entries(F.collect_list(F.when(pair.isNotNull(), F.struct(pair, value)))).alias("counts")
    wide = rows.groupBy(*by).agg(known, counts, F.sum(F.when(pair.isNotNull(), value)).alias("total"))
    a, b = ends
    wide = wide.withColumn(a, F.explode("tokens")).withColumn(b, F.explode("tokens"))
    return wide.select(*by, a, b, F.coalesce(F.try_element_at("counts", F.concat(a, F.lit(_MARK), b)), F.lit(0)).cast("long").alias("value"), "total")


def dense_bigrams(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, a, b, cnt, freq) for all pairs of glyphs that occur in a group."""
    one, two = F.when(F.col("n") == 1, F.col("ngram")), F.when(F.col("n") == 2, F.concat(F.substring("ngram", 1, 1), F.lit(_MARK), F.substring("ngram", 2, 1)))
    out = _square(counts.where("n <= 2"), by, one, two, F.col("cnt"), ("a", "b"))
    return out.select(*by, "a", "b", F.col("value").alias("cnt"), F.coalesce(F.col("value") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("freq"))


def dense_transitions(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, from_tok, to_tok, n) for all pairs of tokens that occur on either end in a group."""
    ends = counts.select(*by, "from_tok", "to_tok", "n", F.explode(F.array("from_tok", "to_tok")).alias("tok"))
    pair = F.when(F.col("tok") == F.col("from_tok"), F.concat("from_tok", F.lit(_MARK), "to_tok"))
    out = _square(ends.distinct(), by, F.col("tok"), pair, F.col("n"), ("a", "b"))
    return out.select(*by, F.col("a").alias("from_tok"), F.col("b").alias("to_tok"), F.col("value").alias("n"))


def border(a: Column, b: Column) -> Column:
    """An item that stands for a transition at a border."""
    return F.concat(F.lit(_MARK), a, F.lit(_MARK), b)


def transitions(words: DataFrame, *, by: tuple[str, ...] = ("folio",), word: bool = True, line: bool = True, para: bool = True, page: bool = True) -> DataFrame:
    """(*by, from_tok, to_tok, n): glyph to glyph inside words, and from and to the borders that are asked for.

    Lines, paragraphs and pages count if their line has a glyph; a page ends only if its last line has one.
    ``by`` may be any attributes of pages that lines carry; no table by page is made then. A line's items
    are its words and its borders; they are counted first and parted into pairs of tokens after that.
    """
    return transitions_of(item_counts(words, by, line=line, para=para, page=page), by, word)


def item_counts(words: DataFrame, by: tuple[str, ...] = ("folio",), *, line: bool = True, para: bool = True, page: bool = True, summed: bool = True) -> DataFrame:
    """(*by, w, m): ``word_counts`` with the borders of lines, paragraphs and pages as further items.

    All counts of glyphs, pairs and positions can be had from these sums, which can be added up over
    parts of a corpus.
    """
    none = F.array().cast("array<string>")
    solid = T.solid(F.col("norm"))
    first, last = F.left(solid, F.lit(1)), F.right(solid, F.lit(1))
    full = F.size("words") > 0
    when = lambda c, *x: F.when(c, F.array(*x)).otherwise(none)
    parts = [F.col("words")]
    if line:
        parts.append(when(full, border(F.lit(T.LINE_START), first), border(last, F.lit(T.LINE_END))))
    if para:
        parts.append(when(full & F.col("para_start"), border(F.lit(T.PARA_START), first)))
        parts.append(when(full & F.col("para_end"), border(last, F.lit(T.PARA_END))))
    known = "page_first" in words.columns
    if page and known:
        parts.append(when((F.col("line_idx") == 0) & (F.col("page_first") != ""), border(F.lit(T.PAGE_START), F.col("page_first"))))
        parts.append(when((F.col("line_idx") == 0) & (F.col("page_last") != ""), border(F.col("page_last"), F.lit(T.PAGE_END))))
    items = word_counts(words, by, F.concat(*parts) if len(parts) > 1 else parts[0], summed)
    if page and not known:
        ends = words.groupBy(*dict.fromkeys(("folio", *by))).agg(F.min_by(F.when(full, first), F.when(full, F.col("line_idx"))).alias("first"), F.max_by(last, "line_idx").alias("last"))
        ends = ends.select(*by, F.explode(F.array(F.when(F.col("first") != "", border(F.lit(T.PAGE_START), F.col("first"))), F.when(F.col("last") != "", border(F.col("last"), F.lit(T.PAGE_END))))).alias("w")).where("w is not null")
        items = items.unionByName(ends.withColumn("m", F.lit(1).cast("long")))
    return items


def only_words(items: DataFrame) -> DataFrame:
    """``item_counts`` without borders."""
    return items.where(~F.startswith("w", F.lit(_MARK)))


def transitions_of(items: DataFrame, by: tuple[str, ...] = ("folio",), word: bool = True) -> DataFrame:
    """``transitions`` of ``item_counts``."""
    w = F.concat(F.lit(T.WORD_START), "w", F.lit(T.WORD_END)) if word else F.col("w")
    struct = lambda a, b: F.struct(a.alias("from_tok"), b.alias("to_tok"))
    inside = F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: struct(F.substring(w, i, F.lit(1)), F.substring(w, i + 1, F.lit(1))))
    two = F.split("w", _MARK)
    pairs = F.when(F.startswith("w", F.lit(_MARK)), F.array(struct(two[1], two[2]))).when(F.length(w) > 1, inside)
    rows = _each(items, (*by, "m"), pairs, "p")
    return rows.groupBy(*by, "p.from_tok", "p.to_tok").agg(F.sum("m").alias("n"))


def probabilities(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "from_tok")))


def charset(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(*by, tok, border): the tokens of either end; glyphs sort before borders."""
    ends = counts.select(*by, F.explode(F.array("from_tok", "to_tok")).alias("tok")).distinct()
    return ends.withColumn("border", F.col("tok").isin(*T.BORDERS))


def word_positions(words: DataFrame, by: tuple[str, ...] = ("folio",), min_length: int = 1) -> DataFrame:
    """(*by, glyph, start, middle, end, only, total): where glyphs stand in words."""
    return positions_of(word_counts(words, by), by, min_length)


def positions_of(counted: DataFrame, by: tuple[str, ...] = ("folio",), min_length: int = 1) -> DataFrame:
    """``word_positions`` of ``word_counts``."""
    rows = counted.where(F.length("w") >= min_length)
    rows = rows.select(*by, "m", F.length("w").alias("len"), F.posexplode(T.glyphs(F.col("w"))).alias("pos", "glyph"))
    one, at_start, at_end = F.col("len") == 1, F.col("pos") == 0, F.col("pos") == F.col("len") - 1
    count = lambda c, name: F.sum(F.when(c, F.col("m")).otherwise(0)).alias(name)
    return rows.groupBy(*by, "glyph").agg(count(~one & at_start, "start"), count(~one & ~at_start & ~at_end, "middle"), count(~one & at_end, "end"), count(one, "only"), F.sum("m").alias("total"))


POSITIONS = ("start", "middle", "end", "only")


def position_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({f"{p}_ratio": F.coalesce(F.try_divide(F.col(p), F.col("total")), F.lit(0.0)) for p in POSITIONS})


def length_profile(words: DataFrame, scope: str, most: int, by: tuple[str, ...] = ("folio",)) -> DataFrame:
    """(*by, glyph, length, pos, n): glyphs by their place in words (``word``) or by their word's place in lines (``line``).

    What is longer than ``most`` counts as of that length, without what lies beyond.
    """
    if scope == "word":
        rows = word_counts(words, by).select(*by, "m", F.least(F.length("w"), F.lit(most)).alias("length"), F.posexplode(T.glyphs(F.left(F.col("w"), F.lit(most)))).alias("pos", "glyph"))
    else:
        rows = words.select(*by, F.least(F.size("words"), F.lit(most)).alias("length"), F.posexplode_outer(F.slice("words", 1, most)).alias("pos", "w")).where("w is not null")
        rows = _each(rows.withColumn("m", F.lit(1).cast("long")), (*by, "length", "pos", "m"), T.glyphs(F.col("w")), "glyph")
    return rows.groupBy(*by, "glyph", "length", "pos").agg(F.sum("m").alias("n"))


def dense_profile(counts: DataFrame, most: int, by: tuple[str, ...]) -> DataFrame:
    """Counts over the glyph's total of all lengths, with zeros for every place of every length up to ``most``."""
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.struct(n.cast("int").alias("length"), p.cast("int").alias("pos")))))
    totals = counts.groupBy(*by, "glyph").agg(F.sum("n").alias("total"))
    cells = totals.withColumn("c", F.explode(every)).select(*by, "glyph", "total", "c.*")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return cells.join(counts, [*by, "glyph", "length", "pos"], "left").select(*by, "glyph", "length", "pos", n.alias("n"), (n / F.col("total")).alias("ratio"))


def profile_order(dense: DataFrame, lengths: tuple[int, int], by: tuple[str, ...]) -> DataFrame:
    """(*by, glyph, start_score, end_score, position_score): means over lengths of the first, the last, and first less last ratio."""
    low, high = lengths
    rows = dense.where(F.col("length").between(low, high))
    mean = lambda c: F.sum(F.when(c, F.col("ratio")).otherwise(0.0)) / F.lit(high - low + 1)
    out = rows.groupBy(*by, "glyph").agg(mean(F.col("pos") == 0).alias("start_score"), mean(F.col("pos") == F.col("length") - 1).alias("end_score"))
    return out.withColumn("position_score", F.col("start_score") - F.col("end_score"))
