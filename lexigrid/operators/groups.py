"""Named groups of pages by attributes, and roll-ups of page counts over all of them at once.

A page may be in many groups. Membership is an array of names, made by one projection; counts are
summed by page, or by the attributes that the groups' filters name, then exploded over the names and
summed again: no join for each group, and no group is lost when no page is in it (the definitions are
the left side of the last join).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quire_number


@dataclass(frozen=True)
class Group:
    name: str
    description: str
    where: dict[str, object] = field(default_factory=dict)

    def matches(self) -> Column:
        """All attributes equal, as strings; a numeric quire means its letter's number."""
        tests = [quire_number(F.col(k)) == v if k == "quire" and isinstance(v, int) else F.col(k).cast("string") == str(v) for k, v in self.where.items()]
        return reduce(lambda a, b: a & b, tests, F.lit(True))


# The groups of the annotated manuscript, in the published order.
MANUSCRIPT = (
    Group("all", "All pages"),
    Group("language_a", "Currier Language A", {"language": "A"}),
    Group("language_b", "Currier Language B", {"language": "B"}),
    *(Group(f"hand_{k}", f"Hand {k}", {"hand": str(k)}) for k in range(1, 6)),
    Group("herbal", "Herbal section", {"illustration": "H"}),
    Group("zodiac", "Zodiac section", {"illustration": "Z"}),
    Group("biological", "Biological section", {"illustration": "B"}),
    Group("pharmaceutical", "Pharmaceutical section", {"illustration": "P"}),
    Group("astronomical", "Astronomical section", {"illustration": "A"}),
    Group("cosmological", "Cosmological section", {"illustration": "C"}),
    Group("text_only", "Text only pages", {"illustration": "T"}),
    Group("herbal_lang_a", "Herbal section, Language A", {"illustration": "H", "language": "A"}),
    Group("herbal_lang_b", "Herbal section, Language B", {"illustration": "H", "language": "B"}),
    Group("biological_lang_a", "Biological section, Language A", {"illustration": "B", "language": "A"}),
    Group("biological_lang_b", "Biological section, Language B", {"illustration": "B", "language": "B"}),
    Group("quire_13", "Quire 13", {"quire": 13}),
    Group("quire_20", "Quire 20", {"quire": 20}),
)

# Sections by their code.
ILLUSTRATIONS = {"T": "Text only", "H": "Herbal", "Z": "Zodiac", "B": "Biological", "P": "Pharmaceutical", "A": "Astronomical", "C": "Cosmological", "S": "Stars"}

#: The same kinds of groups for documents; the last is always empty.
DOCUMENTS = (
    Group("all", "All documents"),
    *(Group(f"lang_{x}", f"Language {x}", {"language": x}) for x in ("de", "en", "es", "fr")),
    *(Group(f"hand_{k}", f"Source {k}", {"hand": f"src{k}"}) for k in range(5)),
    *(Group(f"label_{x}", f"Label {x}", {"illustration": x}) for x in ("q0t0", "q0t1", "q1t0", "q1t1")),
    Group("unlabelled", "Without labels", {"illustration": ""}),
    Group("quire_13", "Bucket 13", {"quire": 13}),
    Group("quire_20", "Bucket 20", {"quire": 20}),
    *(Group(f"{x}_good", f"Good documents in {x}", {"language": x, "illustration": "q1t0"}) for x in ("de", "en")),
    Group("en_toxic", "Toxic documents in en", {"language": "en", "illustration": "q1t1"}),
    Group("nowhere", "A language that isn't there", {"language": "xx"}),
)


def select(groups: tuple[Group, ...], names: list[str] | None) -> tuple[Group, ...]:
    """The groups of these names; all without names."""
    return groups if not names else tuple(g for g in groups if g.name in set(names))


def display_order(groups: tuple[Group, ...]) -> tuple[Group, ...]:
    """As viewers list them: groups by one attribute or none in their own order, then those by several."""
    return tuple(sorted(groups, key=lambda g: len(g.where) > 1))


def members(groups: tuple[Group, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(g.matches(), F.lit(g.name)) for g in groups)))


def membership(pages: DataFrame, groups: tuple[Group, ...]) -> DataFrame:
    """``pages`` once for each of their groups, in column ``agg``."""
    return pages.withColumn("agg", F.explode(members(groups)))


def definitions(spark: SparkSession, groups: tuple[Group, ...]) -> DataFrame:
    return spark.createDataFrame([(g.name, g.description, k) for k, g in enumerate(groups)], "agg string, description string, ord int")


def roll_up(counts: DataFrame, pages: DataFrame, groups: tuple[Group, ...], keys: list[str], measures: list[str]) -> DataFrame:
    """Sums of page counts for each group: (agg, *keys, *measures)."""
    tagged = counts.join(pages.select("folio", members(groups).alias("aggs")), "folio")
    return tagged.withColumn("agg", F.explode("aggs")).groupBy("agg", *keys).agg(*(F.sum(m).cast("long").alias(m) for m in measures))


def roll_up_attributes(counts: DataFrame, groups: tuple[Group, ...], keys: list[str], measures: list[str]) -> DataFrame:
    """Sums for each group of counts by the attributes that groups ask for: a few hundred combinations, no row by page."""
    rows = counts.select(*keys, *measures, F.explode(members(groups)).alias("agg"))
    return rows.groupBy("agg", *keys).agg(*(F.sum(m).cast("long").alias(m) for m in measures))


#: A page's groups in one string, a digit for each: counts by it are as many as there are kinds of pages that the groups tell apart.
MARKS = "marks"


def marks(groups: tuple[Group, ...]) -> Column:
    """1 for each of the groups that a page is in, 0 for the others, in their order."""
    return F.concat(*(F.when(g.matches(), "1").otherwise("0") for g in groups)).alias(MARKS)


def roll_up_marks(counts: DataFrame, groups: tuple[Group, ...], keys: list[str], measures: list[str]) -> DataFrame:
    """Sums for each group of counts by ``marks``."""
    names = F.array_compact(F.array(*(F.when(F.substring(MARKS, k, 1) == "1", F.lit(g.name)) for k, g in enumerate(groups, 1))))
    rows = counts.select(*keys, *measures, F.explode(names).alias("agg"))
    return rows.groupBy("agg", *keys).agg(*(F.sum(m).cast("long").alias(m) for m in measures))


def attributes(groups: tuple[Group, ...]) -> tuple[str, ...]:
    """The attributes that the groups' filters name."""
    return tuple(dict.fromkeys(k for g in groups for k in g.where))


def manifest(pages: DataFrame, groups: tuple[Group, ...]) -> DataFrame:
    """(agg, description, page_count) of every group, pages without text and groups without pages included."""
    found = membership(pages, groups).groupBy("agg").agg(F.count("*").alias("page_count"))
    return definitions(pages.sparkSession, groups).join(found, "agg", "left").select("agg", "description", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"))


def overlaps(pages: DataFrame, groups: tuple[Group, ...], names: list[str]) -> DataFrame:
    """(agg, attribute, value, pages, share): pages of a group by each attribute's values.

    Pages are counted by all their attributes once; groups and grouping sets work on these counts.
    """
    combinations = pages.groupBy(*dict.fromkeys((*attributes(groups), *names))).agg(F.count("*").alias("n"))
    rows = combinations.select(F.explode(members(groups)).alias("agg"), *names, "n")
    sets = rows.groupingSets([[F.col("agg"), F.col(a)] for a in names], "agg", *names).agg(F.sum("n").alias("pages"), F.grouping_id().alias("set"))
    # an attribute's bit is 0 in its own set alone
    every = (1 << len(names)) - 1
    own = {a: every ^ (1 << (len(names) - 1 - k)) for k, a in enumerate(names)}
    which = lambda of: F.coalesce(*(F.when(F.col("set") == v, of(a)) for a, v in own.items()))
    rows = sets.select("agg", which(F.lit).alias("attribute"), which(F.col).alias("value"), "pages")
    total = F.sum("pages").over(Window.partitionBy("agg", "attribute"))
    return rows.select("agg", "attribute", "value", "pages", F.round(F.col("pages") / total, 6).alias("share"))


def contents(pages: DataFrame, groups: tuple[Group, ...]) -> DataFrame:
    """(agg, quire, folio): what each group holds, a row for each page, as a group may hold a large part of all."""
    return membership(pages, groups).select("agg", "quire", "folio")


def domains(pages: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, value): the values that occur, but for ""."""
    long = pages.select(F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes))).alias("x")).select("x.*")
    return long.where("value <> ''").distinct()
