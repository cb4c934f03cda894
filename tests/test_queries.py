"""Every query against its SQL, and the invariants of the counts."""

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.operators import counts as C
from lexigrid.operators import grids as G
from lexigrid.plans import further_oracle, further_queries, more_oracle, more_queries, source_oracle, source_queries  # noqa: F401  they add to the tables
from lexigrid.plans.oracle import ORACLE_SQL
from lexigrid.plans.queries import QUERIES, document_boxes
from lexigrid.sources import corpus

from .conftest import SF


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(v[k]) for k in order) for v in values)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.fixture(scope="module")
def words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return corpus.from_documents(docs).words().cache()


def total(df, c):
    return df.agg(F.sum(c)).first()[0]


def test_invariants(words):
    n_words, n_glyphs = total(words, F.size("words")), total(words, F.length(F.array_join("words", "")))
    trans = C.transitions(words)
    full = words.where(F.size("words") > 0)
    pages = full.select("folio").distinct().count()
    last = words.groupBy("folio").agg(F.max_by(F.size("words"), "line_idx").alias("k")).where("k > 0").count()
    borders = 2 * full.count() + full.where("para_start").count() + full.where("para_end").count() + pages + last
    assert total(trans, "n") == (n_glyphs - n_words) + 2 * n_words + borders
    assert total(trans.where("from_tok = '^'"), "n") == total(trans.where("to_tok = '$'"), "n") == n_words
    p = C.word_positions(words)
    assert total(p, "start") == total(p, "end")
    assert total(p, "only") + total(p, "start") == n_words
    assert total(p, "total") == n_glyphs == total(C.ngrams(words, (1,)), "cnt")
    sums = C.probabilities(trans, ("folio",)).groupBy("folio", "from_tok").agg(F.sum("prob").alias("s"))
    assert sums.where("abs(s - 1) > 1e-9").isEmpty()
    grid = G.histogram(G.place(words), "x_page", "y_page", 5, 10)
    assert total(grid, "n") == n_glyphs


def executed(spark, name):
    """The physical plan as it is laid out before it runs, without what other tests have cached."""
    spark.catalog.clearCache()
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_filters_reach_the_scan(spark):
    """Rows of other languages are left out by the scan, and no column is read that isn't needed."""
    spark.catalog.clearCache()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus.from_documents(docs, spread=False).words().where("language = 'en'")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(?:DataFilters|PartitionFilters): \[[^\]]*lang", plan)
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


@pytest.mark.parametrize("name", ["markov_diff", "ngram_diff_topk", "wordpos_diff", "pagepos_diff", "pagepos_blur_diff", "unigram_diff", "markov_max_abs_diff", "bigram_matrix_dense", "markov_matrix_dense"])
def test_texts_are_read_once(spark, name):
    plan = executed(spark, name)
    assert plan.count("FileScan parquet") == 1
    assert not re.search(r"ReadSchema: struct<[^>]*n_chars", plan)


def test_overlaps_scan_each_table_once(spark):
    plan = executed(spark, "group_overlap_stats")
    assert plan.count("FileScan parquet") == 2
    assert "Expand" in plan


def test_page_metrics_read_each_text_once(spark):
    plan = executed(spark, "page_metrics_full_join")
    assert plan.count("FileScan parquet") == 1
    assert plan.count("Exchange hashpartitioning(folio") <= 2


@pytest.mark.parametrize("name", ["cell_pixels", "physpos_grid_manuscript", "physpos_raw_grid", "physpos_interpolate"])
def test_boxes_wait_for_no_other_rows(spark, name):
    """Words find their places in their own line: no task sorts lines or words of many pages."""
    assert "Window" not in executed(spark, name)


@pytest.mark.parametrize("name", ["page_metrics_entropy", "page_metrics_transition", "page_metrics_full_join", "metric_axis_extent"])
def test_metrics_of_a_page_make_no_row_for_an_item(spark, name):
    """What is counted within a page is summed there: the one exchange by page is that of its text."""
    plan = executed(spark, name)
    assert "kind#" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert ("Aggregate" in plan) == (name == "metric_axis_extent")


@pytest.mark.parametrize("name", ["page_metrics_transition", "metric_axis_extent", "charpos_total_chars"])
def test_texts_are_dealt_out_before_they_are_normalised(spark, name):
    """Every core normalises and counts, also where one task reads the whole table, and parts aren't merged by their bytes."""
    above, below = re.split(r"Exchange hashpartitioning\(folio[^)]*\), REPARTITION_BY_NUM", executed(spark, name))
    assert "regexp_replace" in above and "regexp_replace" not in below and below.count("Exchange") == 0


@pytest.mark.parametrize("name", ["physpos_grid_manuscript", "physpos_raw_grid"])
def test_sizes_of_pages_take_no_row_for_a_box(spark, name):
    """Words and their glyphs are exploded for the grid alone, not for the largest page's size as well."""
    plan = executed(spark, name)
    assert plan.count("Generate posexplode") == 3 and "aggregate(" not in plan


def test_words_of_long_lines_find_their_places(spark):
    """What is kept of a line grows with its length, not with the words before each of its words."""
    words = [["ab"[: 1 + k % 2] * (1 + k % 3) for k in range(n)] for n in (20000, 0, 1, 5)]
    rows = [(1, "en", k, 9, 9, w) for k, w in enumerate([*words, None])]
    lines = spark.createDataFrame(rows, "folio int, language string, line_idx int, boxes_width int, boxes_height int, words array<string>")
    boxes = document_boxes(lines)
    want = []
    for line, ws in enumerate(words):
        at = 0
        for k, w in enumerate(ws):
            want.append((line * 100000 + k, at * 12, line * 40, len(w) * 12, w))
            at += len(w) + 1
    assert sorted(map(tuple, boxes.select("word_idx", "x", "y", "width", "text").collect())) == want
    assert "aggregate(" not in boxes._jdf.queryExecution().optimizedPlan().toString()
