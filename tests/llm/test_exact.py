import hashlib
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import exact
from lexigrid.llm.exact_sql import EXACT_SQL
from lexigrid.llm.queries import ORACLE_SQL, op11_exact_dedup
from tests.conftest import SF

LAST = float("inf")


def plain(rows):
    """The result for (doc_id, text), one row after another."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: LAST if i is None else i)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_query_against_sql_and_a_plain_version(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = got(op11_exact_dedup(spark, SF))
    assert rows == sorted(con.sql(ORACLE_SQL["op11_exact_dedup"]).fetchall(), key=str)
    assert rows == plain(pairs(spark.read.parquet(f"{SF}/documents.parquet")))


def test_no_python_in_the_plan(spark):
    plan = op11_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_documents(spark, odd):
    assert got(exact.duplicates(odd)) == plain(pairs(odd))
    con = duckdb.connect()
    documents = odd.select("doc_id", "text").toPandas()  # noqa: F841  DuckDB reads it by name
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
    assert got(exact.duplicates(odd)) == sorted(con.sql(EXACT_SQL).fetchall(), key=str)


def test_white_space(spark):
    texts = [(3, "a b"), (1, "a \t\n\x0b\x0c\r b"), (2, " a b"), (5, "  a b"), (4, "a b"), (6, "a b "), (None, "\n"), (7, " "), (8, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = got(exact.duplicates(docs))
    assert rows == plain(texts)
    keep = {r[0]: r[1] for r in rows}
    assert (keep[3], keep[5], keep[4], keep[6], keep[None], keep[8]) == (1, 2, 4, 6, 7, 8)


@pytest.mark.parametrize("weak", [lambda t: F.substring(t, 1, 1).cast("binary"), lambda t: F.lit(b"x"), lambda t: F.unhex(F.substring(F.md5(t.cast("binary")), 1, 2))])
@pytest.mark.parametrize("most", [exact.REPEATED, 0])
def test_bytes_decide_where_hashes_collide(spark, odd, monkeypatch, weak, most):
    """Whether the repeated hashes are broadcast or not."""
    monkeypatch.setattr(exact, "REPEATED", most)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    assert got(exact.duplicates(docs, digest=weak)) == plain(pairs(docs))


def test_columns_of_clashing_names(spark, odd):
    docs = odd.withColumns({n: F.lit("y") for n in ("h", "t", "i", "row", "all", "sha", "first", "k0", "group_size", "keep_id")})
    assert got(exact.duplicates(docs)) == plain(pairs(docs))
    rows = exact.duplicates(docs, keep=("lang", "row"))
    assert rows.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "lang", "row"]
    assert {r["row"] for r in rows.collect()} == {"y"}


def test_one_row_of_a_repeated_id_stays(spark):
    docs = spark.createDataFrame([(1, "a  b", "x"), (1, "a b", "y"), (1, "a b", "y"), (2, "a b", "z")], "doc_id long, text string, lang string")
    for parts in (1, 3):
        rows = exact.duplicates(docs.repartition(parts), keep=("lang",)).where("kept").collect()
        assert [(r.doc_id, r.group_size, r.lang) for r in rows] == [(1, 4, rows[0].lang)]
        assert rows[0].lang == exact.duplicates(docs.repartition(2), keep=("lang",)).where("kept").first().lang


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "y")], "name string, body string")
    rows = {r.name: (r.keep_id, r.group_size, r.kept) for r in exact.duplicates(docs, id_col="name", text_col="body").collect()}
    assert rows == {"b": ("a", 2, False), "a": ("a", 2, True), None: (None, 1, True)}


def test_a_hot_group_and_a_long_text(spark, prose):
    hot, long_text = prose(7, 300), prose(8, 200_000)
    docs = spark.range(3000).selectExpr("id as doc_id").withColumn("text", F.when(F.col("doc_id") % 3 == 0, hot).otherwise(F.concat(F.lit("t"), F.col("doc_id"))))
    docs = docs.unionByName(spark.createDataFrame([(3000, long_text), (3001, long_text + " "), (3002, long_text.replace(" ", "\n"))], docs.schema))
    assert got(exact.duplicates(docs)) == plain(pairs(docs))


def test_empty_table(none):
    assert exact.duplicates(none).isEmpty()
    assert exact.duplicates(none).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
