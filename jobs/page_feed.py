"""Keeps the statistics of a growing folder of documents: n-grams, transitions and positions of glyphs by language.

    python -m jobs.page_feed --input /data/documents.parquet --output /data/stats --checkpoint /data/stats-state

A run takes the files that no earlier run has taken, which the checkpoint of the stream knows, and
reads no other text. What a batch adds is kept as sums, in a partition of the batch's number:

    repeated/batch_id=N ids that had come before (known), or that came more than once
    pages/batch_id=N    the pages that the batch brought: doc_id, language, hand, n_chars
    items/batch_id=N    how often words and borders of lines, paragraphs and pages occur in them

A batch that is taken again after a failure has the same files and the same number, and replaces its own
partitions. After the stream has ended, the sums of all batches become the published tables ngrams,
transitions and positions, a folder for each language; they depend on nothing but the sums, so they are
made anew by each run.

A page counts once: the first text that an id comes with. Rows of an id that an earlier batch has are
left out; of several rows of an id in a batch, the least by text, language and source counts. Rows
without an id are pages of their own. Null texts are empty, null languages and sources are "".
"""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.functions.profiles import PROFILES
from lexigrid.operators import counts as C
from lexigrid.sources import corpus

log = logging.getLogger("jobs.page_feed")
CONFIG = Path(__file__).with_suffix(".toml")
DOCUMENTS = "doc_id long, text string, lang string, source string"
STATE = {
    "repeated": "doc_id long, known boolean, batch_id long",
    "pages": "doc_id long, language string, hand string, n_chars long, batch_id long",
    "items": "language string, hand string, w string, m long, batch_id long",
}
LANGUAGE = ("language",)


def settings(path: str | Path = CONFIG) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def _pattern(path: str) -> str:
    """A stream takes folders and patterns; as a pattern, the path may also be a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _state(spark: SparkSession, out: str, name: str) -> DataFrame:
    rows = spark.read.schema(STATE[name]).parquet(f"{out}/{name}")
    return rows.fillna("", [c for c in ("language", "hand") if c in rows.columns])


def doubtful(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, known): ids that come more than once, in these rows or in ``known``; found from the ids alone."""
    ids = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    found = ids.join(known.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return found.where("n > 1 or known").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


def admitted(rows: DataFrame, again: DataFrame) -> DataFrame:
    """The rows that count as pages: no id that is known, and one row of each id.

    ``again`` (``doubtful``, written) is small as a rule: Spark then broadcasts it by the size of its files, and
    texts stay where they are but for those of its ids.
    """
    sure = rows.join(again, "doc_id", "left_anti")
    one = rows.join(again.where("not known"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("one"))
    return sure.unionByName(one.select("doc_id", "one.*"))


def add(batch: DataFrame, batch_id: int, out: str, config: dict) -> None:
    """Writes what a batch adds, in place of what an earlier try of the same batch wrote."""
    spark = batch.sparkSession
    known = _state(spark, out, "pages").where((F.col("batch_id") < batch_id) & F.col("doc_id").isNotNull())

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/{name}")
        return _state(spark, out, name).where(F.col("batch_id") == batch_id)

    again = put(doubtful(batch, known), "repeated")
    pages = admitted(batch, again.drop("batch_id"))
    own = pages.select("doc_id", F.coalesce("lang", F.lit("")).alias("language"), F.coalesce("source", F.lit("")).alias("hand"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    words = corpus.from_documents(pages, spread=False).words(PROFILES[config["profile"]])
    added = put(own, "pages")
    put(C.item_counts(words, ("language", "hand")), "items")
    log.info("batch %d: read %d rows, %d ids had come before or came more than once, added %d pages", batch_id, batch.count(), again.count(), added.count())


def published(items: DataFrame, config: dict) -> dict[str, DataFrame]:
    """The published tables from summed items."""
    words = C.only_words(items)
    return {
        "ngrams": C.frequencies(C.ngrams_of(words, tuple(config["sizes"]), LANGUAGE), LANGUAGE, config["min_count"]),
        "transitions": C.probabilities(C.transitions_of(items, LANGUAGE), LANGUAGE),
        "positions": C.position_ratios(C.positions_of(words, LANGUAGE)),
    }


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> None:
    """Takes the new files of ``source`` (a file, folder or pattern of Parquet files) and publishes the statistics anew."""
    config = settings() | (config or {})
    for name, schema in STATE.items():  # so that the first batch finds them
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch_id").parquet(f"{out}/{name}")
    feed = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_pattern(source))
    stream = feed.writeStream.foreachBatch(partial(add, out=out, config=config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    items = _state(spark, out, "items").groupBy("language", "w").agg(F.sum("m").alias("m"))
    for name, rows in published(items, config).items():
        rows.write.mode("overwrite").partitionBy("language").parquet(f"{out}/{name}")
        log.info("wrote %d rows to %s/%s", spark.read.schema(rows.schema).parquet(f"{out}/{name}").count(), out, name)


def read(spark: SparkSession, out: str) -> DataFrame:
    """All that is published in one table: (language, kind, item, n, share)."""
    table = lambda name, schema: spark.read.schema(f"{schema}, language string").parquet(f"{out}/{name}").fillna("", ["language"])
    grams = table("ngrams", "ngram string, cnt long, freq double").select("language", F.lit("ngram").alias("kind"), F.col("ngram").alias("item"), F.col("cnt").alias("n"), F.col("freq").alias("share"))
    pairs = table("transitions", "from_tok string, to_tok string, n long, prob double").select("language", F.lit("transition").alias("kind"), F.concat_ws("|", "from_tok", "to_tok").alias("item"), "n", F.col("prob").alias("share"))
    places = table("positions", "glyph string, " + ", ".join(f"`{p}` long, {p}_ratio double" for p in C.POSITIONS))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("kind"), F.col(p).alias("n"), F.col(f"{p}_ratio").alias("share")) for p in C.POSITIONS)))
    places = places.select("language", "glyph", each.alias("x")).select("language", "x.kind", F.col("glyph").alias("item"), "x.n", "x.share")
    pages = _state(spark, out, "pages").groupBy("language").agg(F.count("*").alias("n")).select("language", F.lit("pages").alias("kind"), F.lit("").alias("item"), "n", F.lit(None).cast("double").alias("share"))
    return grams.unionByName(pairs).unionByName(places).unionByName(pages)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.page_feed", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--input", required=True, help="Parquet files of documents: a file, a folder that grows, or a pattern")
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True, help="folder of the stream's state; one for each output")
    p.add_argument("--config", default=str(CONFIG))
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("page_feed").getOrCreate()
    try:
        run(spark, args.input, args.output, args.checkpoint, settings(args.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
