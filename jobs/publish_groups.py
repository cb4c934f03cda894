"""Publishes the statistics of named groups of documents, for viewers that show and compare groups.

    python -m jobs.publish_groups --documents /data/documents.parquet --labels /data/labels.parquet --output /data/groups

The settings name the groups by attributes of their documents. Texts are read once: words and borders
are counted by the attributes that the groups ask for, and all other tables come from these counts,
which are written first.

    items         counts of words and borders by attributes (Parquet)
    ngrams, transitions, positions   by group, a folder for each (Parquet)
    viewer        transitions and positions of a group as maps, a folder for each (JSON)
    manifest      every group with its description, pages and glyphs, groups without pages included (JSON)
    metadata      one row: pages, values of attributes, the settings and the groups (JSON)

Each table replaces what was there, so a run that is done again, also after one that broke off, leaves the
same tables. A document is a page; an id with several labels counts by their greatest values. Null texts are empty, null languages and sources are "".
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.profiles import PROFILES
from lexigrid.operators import counts as C
from lexigrid.operators import groups as R
from lexigrid.sources import corpus, results

log = logging.getLogger("jobs.publish_groups")
CONFIG = Path(__file__).with_suffix(".toml")
GROUP, MARKS = ("agg",), (R.MARKS,)


def settings(path: str | Path = CONFIG) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def groups_of(config: dict) -> tuple[R.Group, ...]:
    groups = tuple(R.Group(g["name"], g["description"], g.get("where", {})) for g in config["groups"])
    if len({g.name for g in groups}) < len(groups):
        raise ValueError("two groups of one name")
    return groups


def _write(rows: DataFrame, at: str, kind: str = "parquet", by: str | None = None) -> DataFrame:
    """The table as it was written."""
    results.write(rows, at, kind, by)
    written = rows.sparkSession.read.schema(rows.schema).format(kind).load(at)
    log.info("wrote %d rows to %s", written.count(), at)
    return written


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> None:
    config = settings() | (config or {})
    groups = groups_of(config)
    by = R.attributes(groups)
    docs, known = spark.read.parquet(documents), spark.read.parquet(labels)
    log.info("read %d documents from %s and %d labels from %s", docs.count(), documents, known.count(), labels)
    source = corpus.from_documents(docs, known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), spread=False)
    items = _write(C.item_counts(source.words(PROFILES[config["profile"]]), by), f"{out}/items")
    # an item once for each kind of pages that the groups tell apart, which are few, and not for all values of attributes
    marked = items.groupBy(R.marks(groups), "w").agg(F.sum("m").alias("m")).persist()
    try:
        words = C.only_words(marked)
        grams = R.roll_up_marks(C.ngrams_of(words, tuple(config["sizes"]), MARKS), groups, ["n", "ngram"], ["cnt"])
        pairs = R.roll_up_marks(C.transitions_of(marked, MARKS), groups, ["from_tok", "to_tok"], ["n"])
        places = R.roll_up_marks(C.positions_of(words, MARKS), groups, ["glyph"], [*C.POSITIONS, "total"])
        tables = {"ngrams": C.frequencies(grams, GROUP, config["min_count"]), "transitions": C.probabilities(pairs, GROUP), "positions": C.position_ratios(places)}
        made = {name: _write(rows, f"{out}/{name}", by="agg") for name, rows in tables.items()}
    finally:
        marked.unpersist()
    viewer = results.nested_transitions(made["transitions"], "agg").join(results.nested_positions(made["positions"], "agg"), "agg", "full")
    _write(viewer, f"{out}/viewer", "json", "agg")

    attributes = source.pages.groupBy(*by).agg(F.count("*").alias("page_count"))
    pages = R.roll_up_attributes(attributes, groups, [], ["page_count"])
    glyphs = made["positions"].groupBy("agg").agg(F.sum("total").alias("char_count"))
    manifest = R.definitions(spark, groups).join(pages, "agg", "left").join(glyphs, "agg", "left").fillna(0, ["page_count", "char_count"])
    _write(manifest.orderBy("ord").coalesce(1), f"{out}/manifest", "json")

    values = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) != "", F.col(c)))).alias(c)
    run_of = source.pages.groupBy("language", "hand", "illustration").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total_pages"), *(values(c) for c in ("language", "hand", "illustration")))
    own = {k: v for k, v in config.items() if k != "groups"}
    _write(run_of.select("*", F.lit(json.dumps(own, sort_keys=True)).alias("config"), F.array(*(F.lit(g.name) for g in groups)).alias("groups")), f"{out}/metadata", "json")


def read(spark: SparkSession, out: str) -> DataFrame:
    """What is published by group in one table: (agg, kind, item, n, share)."""
    table = lambda name, schema: spark.read.schema(f"{schema}, agg string").parquet(f"{out}/{name}")
    grams = table("ngrams", "ngram string, cnt long, freq double").select("agg", F.lit("ngram").alias("kind"), F.col("ngram").alias("item"), F.col("cnt").alias("n"), F.col("freq").alias("share"))
    pairs = table("transitions", "from_tok string, to_tok string, n long, prob double").select("agg", F.lit("transition").alias("kind"), F.concat_ws("|", "from_tok", "to_tok").alias("item"), "n", F.col("prob").alias("share"))
    places = table("positions", "glyph string, " + ", ".join(f"`{p}` long, {p}_ratio double" for p in C.POSITIONS))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("kind"), F.col(p).alias("n"), F.col(f"{p}_ratio").alias("share")) for p in C.POSITIONS)))
    places = places.select("agg", "glyph", each.alias("x")).select("agg", "x.kind", F.col("glyph").alias("item"), "x.n", "x.share")
    sizes = spark.read.schema("agg string, description string, page_count long, char_count long").json(f"{out}/manifest")
    none = F.lit(None).cast("double").alias("share")
    sizes = [sizes.select("agg", F.lit(kind).alias("kind"), F.col("description").alias("item"), F.col(c).alias("n"), none) for kind, c in (("pages", "page_count"), ("glyphs", "char_count"))]
    return grams.unionByName(pairs).unionByName(places).unionByName(sizes[0]).unionByName(sizes[1])


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.publish_groups", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("publish_groups").getOrCreate()
    try:
        run(spark, args.documents, args.labels, args.output, settings(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
