"""Running counts over an append-only feed of documents: every counter is a sum, so pages can be added as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.profiles import EVA_DISTINCT, Profile
from ..operators.counts import ngrams


def running_ngrams(feed: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), profile: Profile = EVA_DISTINCT) -> DataFrame:
    """(language, ngram, cnt, n) of a streaming DataFrame of documents; for update or complete mode."""
    lines = feed.select(F.coalesce("lang", F.lit("")).alias("language"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    words = lines.select("language", T.split_words(T.normalise(T.part_letters(F.col("line")), profile)).alias("words"))
    return ngrams(words, sizes, ("language",))
