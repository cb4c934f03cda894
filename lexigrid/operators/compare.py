"""Differences between two tables of the same keys, orders, and extents of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.profiles import Profile
from ..sources.shared import new_folder

#: Values that a legend may have.
LEGEND = 10_000
#: How often the cells that ``near_places`` looks into are halved.
LEVELS = 12


def diff(a: DataFrame, b: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Keys of either side; for each measure m: m_a, m_b (0 where missing) and m_diff = m_a - m_b."""
    left = a.select(*keys, *(F.col(m).alias(f"{m}_a") for m in measures))
    right = b.select(*keys, *(F.col(m).alias(f"{m}_b") for m in measures))
    out = left.join(right, keys, "full")
    out = out.withColumns({f"{m}_{s}": F.coalesce(f"{m}_{s}", F.lit(0)) for m in measures for s in "ab"})
    return out.withColumns({f"{m}_diff": F.col(f"{m}_a") - F.col(f"{m}_b") for m in measures})


def diff_of(rows: DataFrame, side: str, sides: tuple[str, str], keys: list[str], measures: list[str]) -> DataFrame:
    """``diff`` of the rows of two values of column ``side``, each with unrepeated keys, in one aggregate: ``rows`` is made once."""
    pick = lambda m, x: F.coalesce(F.max(F.when(F.col(side) == x, F.col(m))), F.lit(0))
    both = rows.where(F.col(side).isin(*sides)).groupBy(*keys).agg(*(pick(m, x).alias(f"{m}_{k}") for m in measures for x, k in zip(sides, "ab", strict=True)))
    return both.withColumns({f"{m}_diff": F.col(f"{m}_a") - F.col(f"{m}_b") for m in measures})


def dense_diff(rows: DataFrame, tokens: DataFrame, token: str, ends: tuple[str, str], measure: str, sides: tuple[str, str]) -> DataFrame:
    """(*ends, m_a, m_b, m_diff) for all pairs of ``tokens``, the union of both sides' alphabets, which is small and bounded; 0 where missing.

    One aggregate of the pairs has both sides, so ``rows`` (language, *ends, measure) is made once.
    """
    pick = lambda x: F.max(F.when(F.col("language") == x, F.col(measure)))
    both = rows.groupBy(*ends).agg(*(pick(x).alias(f"{measure}_{k}") for x, k in zip(sides, "ab", strict=True)))
    every = tokens.select(F.col(token).alias(ends[0])).join(F.broadcast(tokens.select(F.col(token).alias(ends[1]))))
    out = every.join(both, list(ends), "left").fillna(0.0, [f"{measure}_a", f"{measure}_b"])
    return out.withColumn(f"{measure}_diff", F.col(f"{measure}_a") - F.col(f"{measure}_b"))


def carry_selection(before: DataFrame, after: DataFrame, token: str, off: tuple[str, ...]) -> DataFrame:
    """(token, known, enabled) of the new alphabet: tokens that were there keep their state, new ones are on."""
    rows = after.join(before.withColumn("known", F.lit(True)), token, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.withColumn("enabled", ~F.col("known") | ~F.col(token).isin(*off))


def greatest_difference(d: DataFrame, measure: str, floor: float) -> DataFrame:
    """One row: the greatest absolute difference, ``floor`` if there is none."""
    most = F.max(F.abs(F.col(f"{measure}_diff")))
    return d.agg(F.when(F.coalesce(most, F.lit(0.0)) > 0, most).otherwise(F.lit(floor)).alias("max_abs_diff"))


def beyond(d: DataFrame, measure: str, band: float) -> DataFrame:
    """Without differences inside a dead band."""
    return d.where(F.abs(F.col(f"{measure}_diff")) > band)


def tendency(d: DataFrame, measure: str, band: float) -> DataFrame:
    """Labels ``a``, ``b`` or ``same``."""
    v = F.col(f"{measure}_diff")
    return d.withColumn("tendency", F.when(v > band, "a").when(v < -band, "b").otherwise("same"))


def canonical_order(rows: DataFrame, token: str, profile: Profile) -> DataFrame:
    """Adds ``ord``: the token's place in the profile's order, 999 if it has none."""
    place = F.instr(F.lit(profile.order), F.col(token)) - 1
    return rows.withColumn("ord", F.when((F.length(token) == 1) & (place >= 0), place).otherwise(999))


def order_of(rows: DataFrame, by: list[str], measure, token: str) -> DataFrame:
    """Adds ``rank`` from 1, by measure (descending), then token."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(measure), F.col(token))))


def keep_order(b: DataFrame, a_ranked: DataFrame, token: str) -> DataFrame:
    """The second table in the first one's order; tokens that only it has follow, by token."""
    known = a_ranked.select(token, F.col("rank").alias("a_rank"))
    order = Window.orderBy(F.col("a_rank").asc_nulls_last(), F.col(token))  # a row for each glyph of an alphabet
    return b.join(known, token, "left").withColumn("rank", F.row_number().over(order)).drop("a_rank")


def places(rows: DataFrame, by: str, key: str, name: str = "place", parts: int | None = None) -> DataFrame:
    """Adds the row's place in its group, from 1, by an unrepeated key; a group may be large.

    Rows are dealt out in ranges of group and key, numbered within a range, and shifted by the counts
    of the ranges before, of which there is a row for each range and group in it. Ranges are written
    first: their borders are sampled, so rows that are dealt out twice fall into other ranges.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = new_folder(spark, "places")
    rows.repartitionByRange(parts, by, key).withColumn("range", F.spark_partition_id()).write.parquet(at)
    dealt = spark.read.schema(StructType([*rows.schema, StructField("range", IntegerType())])).parquet(at)
    counts = dealt.groupBy("range", by).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("range").alias("in_range"), F.col(by).alias("of"), before.alias("start"))
    local = F.row_number().over(Window.partitionBy("range", by).orderBy(key))
    # a null is a group as any other
    out = dealt.withColumn("local", local).join(starts, (F.col("range") == F.col("in_range")) & F.col(by).eqNullSafe(F.col("of")))
    return out.select(*rows.columns, (F.col("local") + F.col("start")).cast("int").alias(name))


def axis_extent(rows: DataFrame, value: str, padding: float = 0.05) -> DataFrame:
    """One row (low, high): the range with a padding on both sides."""
    out = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    pad = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) * padding).otherwise(F.lit(padding))
    return out.select((F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def nearest_point(rows: DataFrame, x: str, y: str, at: tuple[float, float], radius: float, key: str) -> DataFrame:
    """The point closest to a place, if within the radius; ties to the smaller key."""
    distance = F.sqrt((F.col(x) - at[0]) * (F.col(x) - at[0]) + (F.col(y) - at[1]) * (F.col(y) - at[1]))
    near = rows.select(key, distance.alias("distance")).where(F.col("distance") <= radius)
    return near.agg(F.min(F.struct("distance", key)).alias("p")).where("p is not null").select(f"p.{key}", "p.distance")


def pairs_near(points: DataFrame, places: DataFrame, radius: int, key: str, place: str) -> DataFrame:
    """(place, key, squared): for each place some points within the radius, the closest among them.

    Both have whole-numbered x and y. Of points at one spot the smallest key counts. Cells have the radius' size and
    ``LEVELS`` halves of it. A place takes the finest level at which its own cell or the eight around it hold a point: that
    one is less than three cells away, so the closest is among the cells up to three away, however crowded the rest is.
    """
    spots = points.groupBy("x", "y").agg(F.min(key).alias(key))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    cell = lambda c: F.floor(F.col(c) * F.expr("shiftleft(1L, level)") / radius)

    def looks(rows: DataFrame, reach: int) -> DataFrame:
        around = F.sequence(F.lit(-reach), F.lit(reach))
        wide = rows.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
        return wide.select(place, "level", F.col("x").alias("px"), F.col("y").alias("py"), (cell("x") + F.col("dx")).alias("cx"), (cell("y") + F.col("dy")).alias("cy"))

    at = ["level", "cx", "cy"]
    cells = spots.select(key, "x", "y", levels).withColumns({"cx": cell("x"), "cy": cell("y")})
    finest = looks(places.select(place, "x", "y", levels), 1).join(cells.select(*at).distinct(), at, "left_semi").groupBy(place, F.col("px").alias("x"), F.col("py").alias("y")).agg(F.max("level").alias("level"))
    rows = cells.join(looks(finest, 3), at)
    dx, dy = F.col("x").cast("long") - F.col("px"), F.col("y").cast("long") - F.col("py")
    squared = dx * dx + dy * dy
    return rows.select(place, key, squared.alias("squared")).where(F.col("squared") <= radius * radius)


def near_places(points: DataFrame, places: DataFrame, radius: int, key: str, place: str) -> DataFrame:
    """For each place the closest point within the radius, ties to the smaller key: (place, key, squared)."""
    near = pairs_near(points, places, radius, key, place)
    return near.groupBy(place).agg(F.min(F.struct("squared", key)).alias("p")).select(place, f"p.{key}", "p.squared")


def intern_colours(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, colour): a number for each value by its first appearance; for at most ``LEGEND`` values, as no legend shows more."""
    first = rows.groupBy(value).agg(F.min(order).alias("first"))
    if first.limit(LEGEND + 1).count() > LEGEND:
        raise ValueError(f"over {LEGEND} values of {value}")
    return first.withColumn("colour", F.row_number().over(Window.orderBy("first", value)) - 1).drop("first")
