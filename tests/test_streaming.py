from datetime import datetime, timedelta, timezone
from pathlib import Path

from lexigrid.operators import counts as C
from lexigrid.operators.counts import ngrams
from lexigrid.plans import further_queries
from lexigrid.sources import corpus
from lexigrid.streaming.counters import running_ngrams
from lexigrid.streaming.pages import prepared, running_items

from .conftest import SF


def test_running_counts_equal_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    query = running_ngrams(feed, (1, 2)).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    batch = ngrams(corpus.from_documents(docs).words(), (1, 2), ("language",))
    running = spark.table("running").select(batch.columns)
    assert running.exceptAll(batch).isEmpty()
    assert batch.exceptAll(running).isEmpty()


LINES = "folio string, at timestamp, line_idx int, para_start boolean, para_end boolean, text string"


def minutes(n):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=n)


def feed_lines():
    """Three batches of lines (folio, minute, line_idx, text): pages that go on over batches, out of order and twice."""
    a = [("p", 0, 0, "abc de"), ("p", 1, 2, "fg"), ("q", 1, 0, "..."), ("q", 2, 1, "x")]
    b = [("p", 2, 1, "late but in time"), ("p", 1, 2, "fg"), ("q", 3, 2, "-"), ("r", 4, 0, "mn o")]
    c = [("r", 5, 1, "yz"), ("r", 4, 0, "mn o"), ("s", 6, 0, "12")]
    return a, b, c


def run_feed(spark, at, batches, extra=()):
    """Items that the stream has put out after all batches and one later line that closes all pages."""
    rows = lambda x: [(f, minutes(m), k, k == 0, False, t) for f, m, k, t in x]
    source = str(at / "lines")
    stream = None
    for k, batch in enumerate([*batches, [("end", 600, 0, "")], *extra, [("end2", 1200, 0, "")]]):
        spark.createDataFrame(rows(batch), LINES).coalesce(1).write.mode("append").parquet(source)
        items = running_items(spark.readStream.schema(LINES).parquet(source), delay="30 minutes", gap="20 minutes")
        stream = items.writeStream.format("parquet").option("path", str(at / "items")).option("checkpointLocation", str(at / "state")).trigger(availableNow=True).start()
        stream.awaitTermination()
    return spark.read.parquet(str(at / "items"))


def test_page_feed_equals_batch(spark, tmp_path):
    """Over restarts of the stream; the state lives in the checkpoint."""
    batches = feed_lines()
    items = run_feed(spark, tmp_path, batches)
    whole = sorted({x for b in batches for x in b})
    lines = spark.createDataFrame([(f, minutes(m), k, k == 0, False, t) for f, m, k, t in whole], LINES)
    want = C.transitions(prepared(lines))
    got = C.transitions_of(items)
    as_rows = lambda df: sorted(map(tuple, df.select("folio", "from_tok", "to_tok", "n").collect()))
    assert as_rows(got) == as_rows(want)
    assert {("p", "^^^^", "a", 1), ("p", "g", "$$$$", 1), ("q", "^^^^", "x", 1), ("r", "y", "$$$$", 1)} <= set(as_rows(got))
    # the last line of q has no glyph, so q has no end
    assert not [r for r in as_rows(got) if r[0] == "q" and r[2] == "$$$$"]


def test_lines_behind_the_watermark_are_dropped(spark, tmp_path):
    batches = feed_lines()
    once = run_feed(spark, tmp_path / "a", batches)
    again = run_feed(spark, tmp_path / "b", batches, extra=[[("p", 3, 3, "much too late")]])
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()


def test_batches_follow_the_size_of_the_feed(spark):
    """A feed of many small files is one batch, and one that closes the pages."""
    at = Path(spark.conf.get("spark.checkpoint.dir"))
    known = set(at.glob("feed-*"))
    rows = further_queries.feed_transitions(spark, SF)
    (new,) = set(at.glob("feed-*")) - known
    assert len(list(new.glob("lines/*.parquet"))) > 4 and len(list(new.glob("state/commits/[0-9]*"))) <= 2
    assert rows.where("from_tok = '^^^^'").agg({"n": "sum"}).first()[0] > 0
