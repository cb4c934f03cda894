"""The jobs, run as a user runs them, against SQL and over input that grows."""

import glob
import json
import logging
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import page_feed, publish_groups
from jobs.queries import ORACLE_SQL, QUERIES

from .conftest import SF

ROOT = Path(__file__).resolve().parent.parent


def show(values):
    return tuple(f"{v:.6f}" if isinstance(v, float) else v for v in values)


def bag(df):
    return Counter(show(r) for r in df.collect())


def wanted(con, name):
    return Counter(show(r) for r in con.sql(ORACLE_SQL[name]).fetchall())


def duck(documents, labels=f"{SF}/labels.parquet"):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet({glob.glob(documents)})")
    con.sql(f"CREATE VIEW labels AS SELECT * FROM '{labels}'")
    return con


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("name", QUERIES)
def test_query_against_sql(spark, name):
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()} | {k: spark.conf.get(k) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = QUERIES[name](spark, SF)
    want = duck(f"{SF}/documents.parquet").sql(ORACLE_SQL[name])
    assert df.columns == want.columns
    assert bag(df) == Counter(show(r) for r in want.fetchall())
    assert not spark.streams.active
    assert all(spark.conf.get(k) == v for k, v in before.items() if k.startswith("spark.sql"))


def test_jobs_need_nothing_of_the_optional_part():
    code = "import sys; import jobs.queries; assert not [m for m in sys.modules if m.startswith('lexigrid.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


# page feed


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that grows, with the documents in three parts, and where the job writes."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k in range(3):
        docs.where(F.pmod(F.col("doc_id"), F.lit(3)) == k).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    (tmp_path / "in").mkdir()

    def grow(k, name=None):
        shutil.copy(glob.glob(f"{tmp_path}/part{k}/*.parquet")[0], tmp_path / "in" / f"{name or k}.parquet")

    def run(**config):
        page_feed.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), config)
        return bag(page_feed.read(spark, str(tmp_path / "out")).withColumn("share", F.round("share", 6)))

    return tmp_path, grow, run


def test_feed_takes_only_what_is_new(feed):
    at, grow, run = feed
    grow(0)
    first = run()
    assert first == wanted(duck(f"{at}/in/*.parquet"), "job1_page_feed")
    state = files(at / "out/items") | files(at / "out/pages")
    grow(1)
    grow(2)
    second = run()
    assert second == wanted(duck(f"{at}/in/*.parquet"), "job1_page_feed")
    assert second == wanted(duck(f"{SF}/documents.parquet"), "job1_page_feed")
    later = files(at / "out/items") | files(at / "out/pages")
    assert state.items() <= later.items() and len(later) > len(state)
    assert {p.name for p in (at / "out/items").glob("batch_id=*")} == {"batch_id=0", "batch_id=1"}
    # nothing new
    assert run() == second
    assert files(at / "out/items") | files(at / "out/pages") == later


def test_feed_in_batches_of_a_file(feed):
    at, grow, run = feed
    for k in range(3):
        grow(k)
    assert run(files_per_batch=1) == wanted(duck(f"{SF}/documents.parquet"), "job1_page_feed")
    assert len(list((at / "out/items").glob("batch_id=*"))) == 3


def test_feed_counts_a_page_once(feed, caplog):
    at, grow, run = feed
    grow(0)
    grow(1)
    once = run()
    grow(1, "again")
    with caplog.at_level(logging.INFO, "jobs.page_feed"):
        assert run() == once
    assert any("added 0 pages" in r.getMessage() for r in caplog.records)
    grow(1, "and-again")
    grow(2, "new")
    grow(2, "new-twice")
    assert run() == wanted(duck(f"{SF}/documents.parquet"), "job1_page_feed")


def test_a_batch_that_broke_off_is_taken_again(feed, monkeypatch):
    at, grow, run = feed
    grow(0)
    run()
    grow(1)
    whole = page_feed.add

    def breaks(batch, batch_id, out, config):
        whole(batch, batch_id, out, config)
        raise RuntimeError("lost after writing")

    monkeypatch.setattr(page_feed, "add", breaks)
    with pytest.raises(Exception, match="lost after writing"):
        run()
    monkeypatch.setattr(page_feed, "add", whole)
    grow(2)
    assert run() == wanted(duck(f"{SF}/documents.parquet"), "job1_page_feed")


def test_feed_of_odd_rows(spark, tmp_path):
    rows = [(1, "abc de", "en", "s"), (1, "abc de", "en", "s"), (1, "aaa", "en", "s"), (None, "xy", None, None), (None, "xy", None, None), (2, None, "", "s"), (3, "", "en", None)]
    docs = spark.createDataFrame(rows, page_feed.DOCUMENTS).withColumn("batch_id", F.lit("x"))
    docs.write.parquet(str(tmp_path / "in"))
    page_feed.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), {"min_count": 1})
    out = page_feed.read(spark, str(tmp_path / "out"))
    assert {(r.language, r.n) for r in out.where("kind = 'pages'").collect()} == {("en", 2), ("", 3)}
    grams = {(r.language, r.item): r.n for r in out.where("kind = 'ngram' and length(item) = 1").collect()}
    assert grams == {("en", "a"): 3, ("", "x"): 2, ("", "y"): 2}
    empty = tmp_path / "empty"
    docs.where("doc_id = -1").write.parquet(str(empty / "in"))
    page_feed.run(spark, str(empty / "in"), str(empty / "out"), str(empty / "state"))
    assert page_feed.read(spark, str(empty / "out")).isEmpty()


# groups


def test_groups_again_and_after_other_settings(spark, tmp_path):
    out = str(tmp_path / "out")
    args = (spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", out)
    publish_groups.run(*args)
    first = bag(publish_groups.read(spark, out))
    publish_groups.run(*args, {"groups": [{"name": "french", "description": "French", "where": {"language": "fr"}}], "min_count": 1})
    assert {r.agg for r in publish_groups.read(spark, out).select("agg").distinct().collect()} == {"french"}
    publish_groups.run(*args)
    assert bag(publish_groups.read(spark, out)) == first


def test_items_are_parted_once_for_each_kind_of_pages(spark, tmp_path, monkeypatch):
    """Quires that no group tells apart don't multiply the items from which n-grams, transitions and positions come."""
    seen = {}
    for name in ("ngrams_of", "transitions_of", "positions_of"):
        monkeypatch.setattr(publish_groups.C, name, lambda rows, *args, of=getattr(publish_groups.C, name), name=name: seen.update({name: rows.count()}) or of(rows, *args))
    docs = [(k, "one two two", "en", "src1", 0) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    publish_groups.run(spark, f"{tmp_path}/documents", f"{tmp_path}/labels", f"{tmp_path}/out")
    # quire 13 and the other 19; two words, and eight borders less those that are alike
    assert seen["ngrams_of"] == seen["positions_of"] == 4 and seen["transitions_of"] <= 20
    assert spark.read.parquet(f"{tmp_path}/out/ngrams").where("agg = 'all' and ngram = 'o'").first().cnt == 120


def test_what_viewers_read(spark, tmp_path):
    out = str(tmp_path / "out")
    publish_groups.run(spark, f"{SF}/documents.parquet", f"{SF}/labels.parquet", out)
    page = json.loads(Path(glob.glob(f"{out}/viewer/agg=english/*.json")[0]).read_text())
    pairs = {r["from_tok"] + "|" + r["to_tok"]: r["n"] for r in spark.read.parquet(f"{out}/transitions").where("agg = 'english'").collect()}
    assert page["transitions"] == pairs
    assert set(page["characters"]["o"]) == {"start", "middle", "end", "only", "total", "ratios"}
    manifest = {r.agg: r for r in spark.read.json(f"{out}/manifest").collect()}
    assert list(manifest) == [g["name"] for g in publish_groups.settings()["groups"]]
    assert (manifest["all"].page_count, manifest["nowhere"].page_count, manifest["nowhere"].char_count) == (200, 0, 0)
    about = spark.read.json(f"{out}/metadata").first()
    assert about.total_pages == 200 and json.loads(about.config)["min_count"] == 5 and about.groups == list(manifest)


def test_groups_of_repeated_labels_and_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc", "en", "s"), (2, None, None, None)], page_feed.DOCUMENTS)
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    for rows, want in ((docs, {"all": 2, "good": 1, "unlabelled": 1, "english": 1, "english_good": 1}), (docs.limit(0), {})):
        at = str(tmp_path / f"{len(want)}")
        rows.write.parquet(f"{at}/documents")
        labels.write.parquet(f"{at}/labels")
        publish_groups.run(spark, f"{at}/documents", f"{at}/labels", f"{at}/out")
        assert {r.agg: r.n for r in publish_groups.read(spark, f"{at}/out").where("kind = 'pages' and n > 0").collect()} == want


@pytest.mark.parametrize("job", ["page_feed", "publish_groups"])
def test_command_line(tmp_path, job):
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    args = {"page_feed": ["--input", f"{SF}/documents.parquet", "--checkpoint", str(tmp_path / "state")], "publish_groups": ["--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet"]}[job]
    config = tmp_path / "own.toml"
    config.write_text((ROOT / f"jobs/{job}.toml").read_text().replace("min_count = 5", "min_count = 50"))
    said = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--output", str(tmp_path / "out"), "--config", str(config)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "wrote" in said.stderr and "read" in said.stderr
    least = duckdb.sql(f"SELECT min(cnt) FROM read_parquet('{tmp_path}/out/ngrams/*/*.parquet')").fetchall()[0][0]
    assert least >= 50
