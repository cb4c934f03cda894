import pytest
from pyspark.sql import functions as F

from lexigrid.functions import scale as S
from lexigrid.functions import text as T
from lexigrid.functions.profiles import EVA_COLLAPSED, EVA_DISTINCT, IDENTITY


def apply(spark, fn, *values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", fn(F.col("v")).alias("x")).orderBy("k").collect()]


def test_normalise(spark):
    assert apply(spark, T.normalise, "iiiii", "eeeeeeeee", "chcthshckhcphcfh", "Fachys.Ykal", "ok!eedy") == ["41", "996", "CTSKPF", "faCys.ykal", "ok7dy"]
    assert apply(spark, lambda c: T.normalise(c, EVA_COLLAPSED), "iiiii", "chii.eeee") == ["II", "CI.E"]
    assert apply(spark, lambda c: T.normalise(c, IDENTITY), "Größe, x") == ["gre,x"]


def test_rewrites_come_before_the_alphabet(spark):
    # dropping the mark first would make a digraph
    assert apply(spark, T.normalise, "c'th", "chcr") == ["t", "Cr"]


def test_words_and_tokens(spark):
    assert apply(spark, T.split_words, ".ar,,ol/r\\", "...", "") == [["ar", "ol", "r"], [], []]
    assert apply(spark, T.tokens, "Sh.o") == [["S", ".", "o"]]
    assert apply(spark, T.glyphs, "", "ab") == [[], ["a", "b"]]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("a[?:???]b[?:ch]c[r:s:d]d", "abchcrd"),
        ("{c'th}e", "cthe"),
        ("c'th", "c'th"),
        ("c'th{o'y}e'", "c'th" + "oye'"),
        ("  <%>fachys.ykal<!a <b> c>x<->r-/s<$> <~>", "fachys.ykal c>x.r/s"),
        ("ok<!note>eedy.@254;chi@12", "okeedy.chi"),
    ],
)
def test_clean_line(spark, raw, clean):
    assert apply(spark, T.clean_line, raw) == [clean]


def test_names(spark):
    assert apply(spark, T.expand, "C", "2", "o") == ["ch", "ii", "o"]
    assert apply(spark, lambda c: T.expand(c, EVA_COLLAPSED), "2", "T") == ["2", "cth"]
    assert apply(spark, T.border_name, "^^", "o") == ["Line Start", "o"]
    assert apply(spark, T.border_label, "$$$$") == ["◂PAGE"]
    assert apply(spark, T.quire_number, "M", "T", "U", "") == [13, 20, None, None]
    assert apply(spark, T.folio_base, "f70v2", "f1r") == ["f70", "f1"]
    assert apply(spark, lambda c: T.folio_base(c, "trailing"), "f70v2", "f1r") == ["f70v2", "f1"]


def test_state(spark):
    (state,) = apply(spark, T.parse_state, "#view=diff&a=x%20y&&log=1")
    assert state == {"view": "diff", "a": "x y", "log": "1"}
    rows = spark.range(1).select(T.format_state(F.create_map(F.lit("a"), F.lit("x y"), F.lit("b"), F.lit(""))).alias("s"), T.state_flag(F.lit("true")).alias("t"), T.state_flag(F.lit(None).cast("string"), True).alias("d"))
    assert rows.first() == ("a=x+y", True, True)


def test_scales(spark):
    assert apply(spark, lambda v: S.ratio_scale(v, "log"), 1.0, 0.01, 0.0, 1e-9, kind="double") == [1.0, 0.5, 0.0, 0.0]
    assert apply(spark, lambda v: S.log_scale(v, F.lit(9.0)), 9.0, -1.0, kind="double") == [1.0, 0.0]
    assert apply(spark, lambda v: S.clamp(v), -2.0, 0.3, 4.0, kind="double") == [0.0, 0.3, 1.0]
    label = spark.createDataFrame([(0, 0), (9, 19), (5, 10)], "c int, r int").select(S.region_label(F.col("c"), F.col("r"), 10, 20).alias("x"))
    assert [r.x for r in label.collect()] == ["Top, Left", "Bottom, Right", "Middle, Center"]
    assert apply(spark, lambda v: S.ramp(v, [(0.0, (0, 0, 0)), (1.0, (10, 20, 30))]), 0.5, 2.0, kind="double") == [[5, 10, 15], [10, 20, 30]]
    assert apply(spark, lambda v: S.cell_pixel(v, 100, F.lit(1090)), 50, kind="int") == [545]


def test_profiles():
    assert len(EVA_DISTINCT.alphabet) == 31
    assert len(EVA_COLLAPSED.alphabet) == 25
