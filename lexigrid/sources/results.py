"""Result tables: Parquet as the canonical form, nested JSON in the shape that viewers read, and back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.profiles import EVA_DISTINCT, PROFILES, Profile
from ..functions.text import BORDERS
from ..operators.groups import ILLUSTRATIONS, MANUSCRIPT, Group, display_order


def nested_transitions(counts: DataFrame, key: str) -> DataFrame:
    """(key, transitions): a map from ``from|to`` to the count; pages of an alphabet's square at most."""
    pair = F.concat_ws("|", "from_tok", "to_tok")
    return counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(pair.alias("pair"), "n")))).alias("transitions"))


def long_transitions(nested: DataFrame, key: str) -> DataFrame:
    """The reverse: (key, from_tok, to_tok, n)."""
    rows = nested.select(key, F.explode("transitions").alias("pair", "n"))
    part = F.split("pair", r"\|")
    return rows.select(key, part[0].alias("from_tok"), part[1].alias("to_tok"), F.col("n").cast("long").alias("n"))


def nested_ngrams(freq: DataFrame, key: str) -> DataFrame:
    """(key, n, total, uniq, counts, frequencies) with maps by n-gram."""
    sorted_map = lambda v: F.map_from_entries(F.sort_array(F.collect_list(F.struct("ngram", v))))
    return freq.groupBy(key, "n").agg(F.max("total").alias("total"), F.max("uniq").alias("uniq"), sorted_map("cnt").alias("counts"), sorted_map("freq").alias("frequencies"))


def nested_positions(ratios: DataFrame, key: str) -> DataFrame:
    """(key, characters): a map from glyph to counts and ratios."""
    names = ("start", "middle", "end", "only")
    entry = F.struct(*names, "total", F.struct(*(F.col(f"{p}_ratio").alias(p) for p in names)).alias("ratios"))
    return ratios.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("glyph", entry.alias("v"))))).alias("characters"))


def nested_profile(dense: DataFrame, key: str) -> DataFrame:
    """(key, glyph, profile): for each length the ratios by place."""
    by_length = dense.groupBy(key, "glyph", "length").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ratio"))), lambda s: s["ratio"]).alias("ratios"))
    return by_length.groupBy(key, "glyph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("length").cast("string").alias("length"), "ratios")))).alias("profile"))


def ragged_profile(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, glyph, profile): for each length its counts by place, as many as the length has, zeros included."""
    by_place = counts.groupBy(*keys, "glyph", "length").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("m"))  # a place occurs once
    places = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    rows = by_place.select(*keys, "glyph", F.struct(F.col("length").cast("string").alias("length"), places.alias("counts")).alias("entry"))
    return rows.groupBy(*keys, "glyph").agg(F.map_from_entries(F.sort_array(F.collect_list("entry"))).alias("profile"))


def long_profile(nested: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """The reverse of ``ragged_profile`` and ``nested_profile``: (*keys, glyph, length, pos, value), zeros left out."""
    rows = nested.select(*keys, "glyph", F.explode("profile").alias("length", "values"))
    rows = rows.select(*keys, "glyph", F.col("length").cast("int").alias("length"), F.posexplode("values").alias("pos", value))
    return rows.where(F.col(value) != 0)


def merged_profiles(nested: DataFrame, keys: list[str]) -> DataFrame:
    """Ragged profiles of many pages added up by ``keys``, place by place; their arrays need not be of one length."""
    sums = long_profile(nested, keys).groupBy(*keys, "glyph", "length", "pos").agg(F.sum("n").alias("n"))
    return ragged_profile(sums, keys)


def matrix(counts: DataFrame, row: str, col: str, value: str, tokens: tuple[str, ...], by: list[str]) -> DataFrame:
    """(*by, row, to_0, to_1, ...): a column for each of ``tokens``, 0 where missing. Columns are numbered, as glyphs differ by case."""
    names = [f"to_{k}" for k in range(len(tokens))]
    wide = counts.groupBy(*by, row).pivot(col, list(tokens)).agg(F.sum(value))
    return wide.toDF(*by, row, *names).fillna(0, names)


def long_matrix(wide: DataFrame, row: str, col: str, value: str, tokens: tuple[str, ...], by: list[str]) -> DataFrame:
    """The reverse, zeros left out."""
    names = [f"to_{k}" for k in range(len(tokens))]
    rows = wide.unpivot([*by, row], names, "to", value).where(F.col(value) != 0)
    token = F.element_at(F.array(*map(F.lit, tokens)), F.substring("to", 4, 9).cast("int") + 1)
    return rows.select(*by, row, token.alias(col), F.col(value).cast("long").alias(value))


def nested_grid(grid: DataFrame, key: str) -> DataFrame:
    """(key, glyph, cells): a map from ``col,row`` to the count."""
    cell = F.concat_ws(",", "col", "row")
    return grid.groupBy(key, "glyph").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(cell.alias("cell"), "n")))).alias("cells"))


def long_grid(nested: DataFrame, key: str) -> DataFrame:
    rows = nested.select(key, "glyph", F.explode("cells").alias("cell", "n"))
    part = F.split("cell", ",")
    return rows.select(key, "glyph", part[0].cast("int").alias("col"), part[1].cast("int").alias("row"), F.col("n").cast("long").alias("n"))


class Catalogue:
    """What a run published: tables of groups below one path, as viewers ask for them.

    A group's part of a table is kept once it was read, and read anew when its files have changed; only
    that part of the table is read. Files and their times are listed through Spark's file systems.
    """

    def __init__(self, spark: SparkSession, path: str, by: str = "agg"):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.kept: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}

    def _files(self, at: str) -> tuple:
        """(path, time, length) of the files below a folder, none if it isn't there."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(at)
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(folder):
            return ()
        found, listed = [], system.listFiles(folder, True)
        while listed.hasNext():
            f = listed.next()
            found.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
        return tuple(sorted(f for f in found if not f[0].rsplit("/", 1)[1].startswith(("_", "."))))

    def groups(self) -> list[str]:
        """Names from the manifest, in its order; it has a row for each of the few groups."""
        rows = self.spark.read.json(f"{self.path}/manifest")
        return [r[0] for r in rows.orderBy(*(["ord"] if "ord" in rows.columns else [])).select(self.by).collect()]

    def read(self, table: str, group: str) -> DataFrame | None:
        """The rows of a group; None if the table has none for it."""
        at = f"{self.path}/{table}/{self.by}={group}"
        files, key = self._files(at), (table, group)
        if key in self.kept and self.kept[key][0] == files:
            return self.kept[key][1]
        if key in self.kept:
            self.kept.pop(key)[1].unpersist()
        if not files:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/{table}").parquet(at).persist()
        self.kept[key] = (files, rows)
        return rows

    def preload(self, table: str, groups: list[str] | None = None) -> int:
        """Reads groups (all without names) ahead; how many have rows."""
        found = [self.read(table, g) for g in (groups or self.groups())]
        return sum(rows.count() >= 0 for rows in found if rows is not None)

    def clear(self) -> None:
        for _, rows in self.kept.values():
            rows.unpersist()
        self.kept.clear()


def write(rows: DataFrame, path: str, kind: str = "parquet", by: str | None = None, mode: str = "overwrite") -> None:
    """One folder for each value of ``by``, so that a reader of one group prunes the others."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def shared_config(profile: Profile = EVA_DISTINCT, groups: tuple[Group, ...] = MANUSCRIPT) -> dict:
    """What viewers need besides results: orders, names, groups."""
    return {
        "collapse_mode": profile.name.removeprefix("eva_"),
        "char_order": list(profile.order),
        "char_order_with_boundaries": [*profile.order, *BORDERS],
        "char_display": profile.display,
        "boundary_tokens": {k: {"name": a, "short": b} for k, (a, b) in BORDERS.items()},
        "aggregations": {g.name: {"description": g.description, "filter": g.where} for g in groups},
        "aggregation_order": [g.name for g in display_order(groups)],
        "illustration_types": ILLUSTRATIONS,
        "valid_chars": sorted(profile.alphabet),
    }


def write_config(path: str, profile_name: str = "eva_distinct") -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(shared_config(PROFILES[profile_name]), file, indent=2, ensure_ascii=False)
