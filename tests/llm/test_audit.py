import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import audit
from lexigrid.llm.audit_sql import AUDIT_SQL
from lexigrid.llm.queries import ORACLE_SQL, op12_filter_interaction_audit
from tests.conftest import SF

NAMES = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(rows):
    """For rows (doc_id, text, lang): (doc_id, lang, letters of the filters it fails)."""
    ids = defaultdict(list)
    for i, text, _ in rows:
        ids[text or ""].append(i)
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        smaller = [x for x in ids[text] if x is not None and (i is None or x < i)]
        tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text), smaller)
        out.append((i, lang or "", "".join(c for c, t in zip("ABCDE", tests, strict=True) if t)))
    return out


def plain(rows, labels):
    """Each order applied to each part, one document after another."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, part, fails in failing(rows):
        parts[part].append((i, fails))
    out = {}
    for part, docs in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, c in enumerate(order, 1):
                removed = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                lost = [len([i for i, _ in removed if i in x]) for x in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(removed), len([d for d in gone if c in d[1]]), len([d for d in docs if d[1] == c]), *lost]
                gone += removed
                shapley[c] += len(removed)
        for order in permutations("ABCDE"):
            for step, c in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[c])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in NAMES[3:]) for r in rows}
    assert len(out) == len(rows)
    return out


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def masks(df):
    return Counter((r.i, r.part, "".join(c for k, c in enumerate("ABCDE") if r.mask >> k & 1)) for r in df.collect())


def test_query_against_sql_and_a_plain_version(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    df = op12_filter_interaction_audit(spark, SF)
    assert df.columns == NAMES
    want = con.sql(ORACLE_SQL["op12_filter_interaction_audit"])
    assert want.columns == NAMES
    rows = got(df)
    assert rows == {r[:3]: r[3:] for r in want.fetchall()}
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    assert rows == plain(tuples(docs, "doc_id", "text", "lang"), tuples(labels, "doc_id", "quality", "toxic"))
    assert len(rows) == 600 * len({k[0] for k in rows})


@pytest.fixture
def labels(spark):
    """Repeated ids that disagree, ids and values that are null, ids of no document, and a further column."""
    rows = [(1, 1, 0, "x"), (1, 0, 1, "x"), (1, 1, 1, "x"), (2, 1, None, "x"), (3, None, 1, "x"), (None, 1, 1, "x"), (8, 1, 0, "x"), (99, 1, 1, "x"), (4, 1, 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, n string")


def test_odd_documents(spark, odd, labels):
    rows, said = tuples(odd, "doc_id", "text", "lang"), tuples(labels, "doc_id", "quality", "toxic")
    assert got(audit.audit(odd, labels)) == plain(rows, said)
    con = duckdb.connect()
    documents = odd.select("doc_id", "text", "lang").toPandas()  # noqa: F841  DuckDB reads them by name
    given = labels.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang FROM documents")
    con.sql("CREATE TABLE labels AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(quality AS INT) AS quality, CAST(toxic AS INT) AS toxic FROM given")
    assert {r[:3]: r[3:] for r in con.sql(AUDIT_SQL).fetchall()} == plain(rows, said)


def test_borders_of_the_filters(spark):
    w = lambda n: " ".join(f"w{k}" for k in range(n))
    texts = [w(199), w(200), " ".join(["a", "b"] * 100), "a " * 200 + w(200), "a " * 201 + w(199), "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "É" * 50, "x|y", "x\x1fy", "a\xa0b　c", "", None]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert masks(audit.failures(docs)) == Counter(failing(rows))


@pytest.fixture
def copies(spark, prose):
    """A text that a third of all rows have, one that is repeated here and there, repeated ids and null ids."""
    hot, other = prose(11, 40), prose(12, 250)
    rows = [(k * 7 % 901, hot if k % 3 == 0 else other if k % 50 == 1 else f"{prose(k, 6)} {k // 4}", f"l{k % 3}") for k in range(900)]
    rows += [(0, hot, "l0"), (0, hot, "l0"), (5, hot, None), (None, hot, "l1"), (None, hot, "l1"), (None, "only here", "l1"), (None, "only here", "l2"), (-4, other, "l2"), (-4, other, "l2")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("weak", [None, lambda t: F.lit(7).cast("long"), lambda t: F.length(t).cast("long") % 3])
def test_groups_over_many_ranges(spark, copies, parts, weak):
    """Also where different texts share a fingerprint, and where all rows have the same one."""
    rows, docs = copies
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert masks(audit.failures(docs, **({"fingerprint": weak} if weak else {}))) == Counter(failing(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_copies_in_small_batches(spark, copies):
    rows, docs = copies
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert masks(audit.failures(docs)) == Counter(failing(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_counters_add_up(spark, odd, labels):
    """Counters of parts of a table sum to those of the whole, once the duplicates are known."""
    found = audit.failures(odd).cache()
    keys, sums = ("part", "mask"), ("n", "good", "toxic")
    whole = audit.counters(found, labels)
    split = [audit.counters(found.where(F.col("part") < "en"), labels), audit.counters(found.where(F.col("part") >= "en"), labels)]
    added = split[0].unionByName(split[1]).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    assert Counter(tuples(whole, *keys, *sums)) == Counter(tuples(added, *keys, *sums))


def test_ids_are_text(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "name string, text string").withColumn("lang", F.lit("en"))
    rows = audit.failures(docs, id_col="name")
    assert {r.i: r.mask for r in rows.collect()} == {"a": 1, "b": 17, "c": 1}


def test_a_very_long_text(spark, prose):
    rows = [(k, prose(9, 300_000) + tail, "en") for k, tail in enumerate(("", "", "x"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert masks(audit.failures(docs)) == Counter(failing(rows))


def test_empty_tables(spark, none, odd, labels):
    assert audit.audit(none, labels).isEmpty()
    rows = got(audit.audit(odd, labels.where("doc_id = -1")))
    assert {v[4:6] for v in rows.values()} == {(0, 0)}
