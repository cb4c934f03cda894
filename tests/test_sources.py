import random
import re
import shutil
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexigrid import cli
from lexigrid.operators import counts as C
from lexigrid.operators import grids as G
from lexigrid.operators import groups as R
from lexigrid.plans import source_queries
from lexigrid.sources import boxes, corpus, results, transcription

from .conftest import SF

TEXT = """# header comment before any page (ignored)
<f1r>  <! $Q=A $P=A $I=H $L=A $H=1 >
<f1r.1,@P0>  <%>fachys.ykal.ar,ataiin
<f1r.2,+P0>  sh[o:a]l.{c'th}res<->kor<$>
<f1r.3,@Lf>  label

<f1v>  <! $Q=A $I=H >
# Currier's language B, hand 2
<f1v.1,*P0>  ok<!note>eedy.@254;chiiiiin
<f2r>
<fRos>  <! $Q=M >
<f9r.1,~P0>not.a.locus
"""
PAGE = '<folio name="f1r" wordCount="1" width="1090" height="1500"><word index="0" x="97" y="128" width="106" height="96">fachys</word></folio>'


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("text") / "corpus.txt"
    file.write_text(TEXT, encoding="utf-8")
    return str(file)


@pytest.fixture(scope="module")
def source(spark, path):
    return corpus.from_transcription(spark, path)


def test_pages(spark, path):
    rows = {r.folio: r for r in transcription.read_pages(spark, path).collect()}
    assert set(rows) == {"f1r", "f1v", "f2r"}
    assert (rows["f1r"].language, rows["f1r"].hand, rows["f1r"].page_in_quire) == ("A", "1", "A")
    assert (rows["f1v"].language, rows["f1v"].hand, rows["f1v"].bifolio) == ("B", "2", "")
    assert rows["f2r"].quire == ""


def test_lines(spark, path):
    rows = transcription.read_lines(spark, path).orderBy("page_idx", "line_idx").collect()
    assert [(r.folio, r.line_num, r.para_start, r.para_end) for r in rows] == [("f1r", 1, True, False), ("f1r", 2, False, True), ("f1v", 1, True, False)]
    assert rows[1].text == "shol.cthres.kor"


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 100 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plain(text):
    """Pages and lines of a file, one line after another."""
    pages, lines = [], []
    for line in text.splitlines():
        if head := re.match(transcription.HEADER, line):
            said = dict(re.findall(r"\$([A-Z])=([A-Za-z0-9]+)", head[2] or ""))
            pages.append([head[1], said.get("Q", ""), said.get("L", ""), said.get("H", "")])
        elif pages and (own := re.match(transcription.OVERRIDE, line)):
            pages[-1][2:] = [own[1].upper(), own[2]]
        elif pages and (locus := re.match(transcription.LOCUS, line)) and locus[3].startswith("P") and locus[4].strip():
            lines.append((len(pages), pages[-1][0], sum(x[0] == len(pages) for x in lines), int(locus[1].split(".")[1]), locus[4].strip()))
    return sorted(map(tuple, pages)), sorted(lines)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_in_many_blocks(spark, tmp_path, small_blocks, end):
    """Pages begin and go on in any block; some blocks have no header, some many, and some are a part of one long line."""
    rng, texts = random.Random(5), {}
    for name in ("one.txt", "two.txt"):
        out = ["# nothing yet", "<f0r.1,@P0>before any page"]
        for k in range(120):
            out.append(f"<f{k}r> <! $Q={chr(65 + k % 20)} $L={'AB'[k % 2]} $H={k % 5} >" if k % 7 else f"<f{k}r>")
            for n in range(rng.choice([0, 0, 1, 3, 20])):
                out += [f"<f{k}r.{n + 1},{rng.choice('+*@=')}{rng.choice(['P0', 'P0', 'Lf'])}>{'ok.' * rng.choice([0, 1, 5, 150])}", rng.choice(["", "# a note", f"# Currier's language {rng.choice('ABab')}, hand {n}"])]
        texts[name] = end.join(out) + rng.choice(["", end])
        (tmp_path / name).write_bytes(texts[name].encode())
    (tmp_path / "empty.txt").write_text("")
    lines = transcription.scan(spark, str(tmp_path))
    assert lines.select("file", "block").distinct().count() > 100 and lines.rdd.getNumPartitions() > 50
    for name, text in texts.items():
        pages, rows = plain(text)
        at = str(tmp_path / name)
        assert sorted(tuple(r) for r in transcription.read_pages(spark, at).select("folio", "quire", "language", "hand").collect()) == pages
        assert sorted(tuple(r) for r in transcription.read_lines(spark, at).select("page_idx", "folio", "line_idx", "line_num", "text").collect()) == rows
    assert transcription.read_pages(spark, str(tmp_path)).count() == 240
    assert transcription.read_lines(spark, str(tmp_path / "empty.txt")).isEmpty()


def test_words(source):
    rows = source.words().orderBy("folio", "line_idx").collect()
    assert [r.norm for r in rows] == ["faCys.ykal.ar,ata2n", "Sol.Tr6s.kor", "ok7dy.C41n"]


def test_transitions(source):
    rows = C.transitions(source.words())
    totals = {r.folio: (r.n, r.kinds) for r in rows.groupBy("folio").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    assert totals == {"f1r": (41, 37), "f1v": (16, 16)}
    ends = {(r.folio, r.from_tok, r.to_tok) for r in rows.where("from_tok = '^^^^' or to_tok = '$$$$'").collect()}
    assert ends == {("f1r", "^^^^", "f"), ("f1r", "r", "$$$$"), ("f1v", "^^^^", "o"), ("f1v", "n", "$$$$")}


def test_counts(source):
    words = source.words()
    grams = {(r.folio, r.ngram): r.cnt for r in C.ngrams(words, (1,)).collect()}
    assert (grams["f1r", "a"], grams["f1r", "r"]) == (5, 3)
    r = C.word_positions(words).where("folio = 'f1r' and glyph = 'r'").first()
    assert (r.start, r.middle, r.end, r.only, r.total) == (0, 1, 2, 0, 3)


def test_grids(source):
    words = source.words()
    e = {r.folio: r for r in G.extents(words).collect()}
    assert (e["f1r"].min_line, e["f1r"].max_line, e["f1r"].max_width) == (1, 2, 16)
    assert (e["f1v"].min_line, e["f1v"].max_line, e["f1v"].max_width) == (1, 1, 9)
    cells = {(r.folio, r.glyph, r.col, r.row): r.n for r in G.histogram(G.place(words), "x_page", "y_page", *G.TEXT_GRIDS["coarse"]).collect()}
    assert {k[2:]: n for k, n in cells.items() if k[:2] == ("f1r", "a")} == {(0, 0): 1, (2, 0): 2, (3, 0): 1, (4, 0): 1}
    assert {k[2:]: n for k, n in cells.items() if k[:2] == ("f1r", "o")} == {(0, 9): 1, (2, 9): 1}
    assert {k[2:]: n for k, n in cells.items() if k[:2] == ("f1v", "o")} == {(0, 5): 1}


def test_groups_without_pages_survive(source):
    rows = {r.agg: r.page_count for r in R.manifest(source.pages, R.MANUSCRIPT).collect()}
    assert len(rows) == 21
    assert (rows["all"], rows["herbal"], rows["language_b"], rows["zodiac"], rows["quire_13"]) == (3, 2, 1, 0, 0)


def test_find_pages(spark, source):
    names = spark.createDataFrame([("1r",), ("f1v",), ("f77r",)], "name string")
    rows = {r.name: r.folio for r in transcription.find_pages(names, source.pages).collect()}
    assert rows == {"1r": "f1r", "f1v": "f1v", "f77r": None}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("boxes")
    (at / "f1r.xml").write_text(PAGE)
    (at / "f1v.xml").write_text('<folio name="f1v" width="10" height="10"></folio>')
    with zipfile.ZipFile(at / "boxes.zip", "w") as z:
        z.writestr("d/f1r.xml", PAGE)
        z.writestr("__MACOSX/f1r.xml", "junk")
        z.writestr("d/bad.xml", b"\xff\xfe")
    return at


@pytest.mark.parametrize("name", ["", "boxes.zip"])
def test_boxes(spark, folder, name):
    found = boxes.read_boxes(spark, str(folder / name) if name else str(folder))
    glyphs = G.glyph_boxes(found)
    assert [(r.glyph, round(r.x, 1), r.y) for r in glyphs.orderBy("x").collect()] == [("f", 107.6, 176.0), ("a", 128.8, 176.0), ("C", 150.0, 176.0), ("y", 171.2, 176.0), ("s", 192.4, 176.0)]
    placed = G.place_boxes(glyphs, found)
    coarse = {(r.glyph, r.col, r.row) for r in G.histogram(placed, "x_page", "y_page", *G.PIXEL_GRIDS["coarse"]).collect()}
    assert coarse == {("f", 0, 1), ("a", 1, 1), ("C", 1, 1), ("y", 1, 1), ("s", 1, 1)}
    raw = G.raw_pixel_grid(placed).orderBy("col").collect()
    assert [r.col for r in raw] == [9, 11, 13, 15, 17]
    assert {r.row for r in raw} == {17}


@pytest.fixture(scope="module")
def broken(tmp_path_factory):
    """A folder and an archive with the same pages: good, without words, cut off, no number, no XML, empty, not UTF-8."""
    at = tmp_path_factory.mktemp("broken")
    pages = {"a": PAGE, "b": '<folio name="b"></folio>', "c": PAGE[:-20], "d": PAGE.replace('"1090"', '"wide"'), "e": "no page", "f": "", "g": b"<folio name='\xff'/>", "h": PAGE.replace("f1r", "h1r")}
    with zipfile.ZipFile(at / "pages.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, page in pages.items():
            page = page if isinstance(page, bytes) else page.encode()
            (at / f"{name}.xml").write_bytes(page)
            z.writestr(f"x/{name}.xml", page)
        z.writestr("x/.hidden.xml", "junk")
        z.writestr("x/readme.txt", "junk")
        z.writestr("x/z.xml", PAGE * 50)
    raw = bytearray((at / "pages.zip").read_bytes())
    begin = raw.index(b"x/z.xml") + len("x/z.xml")
    raw[begin + 2 : begin + 20] = bytes(18)  # z can't be unpacked
    (at / "pages.zip").write_bytes(raw)
    return at


def test_pages_that_cannot_be_read_are_named(spark, broken):
    # Spark's readers pass over files of no bytes
    for path, bad, n in ((str(broken), "cdeg", 7), (str(broken / "pages.zip"), "cdefgz", 9)):
        seen = Observation("pages")
        rows = boxes.counted(boxes.read_pages(spark, path), seen)
        assert sorted(r.folio for r in boxes.boxes_in(rows).collect()) == ["f1r", "h1r"]
        assert seen.get == {"pages": n, "skipped": len(bad)}
        named = boxes.unreadable(boxes.read_pages(spark, path)).collect()
        assert sorted((r.member or r.file)[-5] for r in named) == list(bad)
        assert all(r.error for r in named)


def test_archives_by_member(spark, broken, tmp_path):
    shutil.copy(broken / "pages.zip", tmp_path / "one.zip")
    with zipfile.ZipFile(tmp_path / "two.ZIP", "w") as z:
        for k in range(40):
            z.writestr(f"{k}.xml", PAGE.replace("f1r", f"f{k}v"))
    (tmp_path / "three.zip").write_text("no archive")
    boxes.archives.register(spark)
    rows = spark.read.format("zip_members").option("partBytes", 3 * len(PAGE)).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 13
    by = {r.file.rsplit("/", 1)[1]: (r.n, r.bad) for r in rows.groupBy("file").agg(F.count("*").alias("n"), F.count("error").alias("bad")).collect()}
    assert by == {"one.zip": (9, 2), "two.ZIP": (40, 0), "three.zip": (1, 1)}
    assert rows.where("member is null").first().error
    # the same by way of Spark's reader
    name = lambda df: sorted((r.file.rsplit("/", 1)[1], r.member or "", r.xml or "", bool(r.error)) for r in df.collect())
    assert name(boxes.whole_archives(spark, f"{tmp_path}/*.zip")) == name(rows.where("file not like '%ZIP'"))
    assert name(spark.read.format("zip_members").load(f"file:{tmp_path}/one.zip")) == name(rows.where("file like '%one.zip'"))


def test_archives_written_and_read(spark, tmp_path):
    at = str(tmp_path / "out")
    boxes.archives.register(spark)
    pages = spark.range(30).selectExpr("concat('p/', id, '.xml') as member", "concat('<folio name=\"é', id, '\"/>') as xml").repartition(4)
    pages.write.format("zip_members").mode("append").save(at)
    read = lambda: sorted((r.member, r.xml) for r in spark.read.format("zip_members").load(at).collect())
    once = sorted((r.member, r.xml) for r in pages.collect())
    assert read() == once and len(list(Path(at).glob("*.zip"))) == 4
    pages.write.format("zip_members").mode("append").save(at)
    assert read() == sorted(once * 2)
    pages.write.format("zip_members").mode("overwrite").save(at)
    assert read() == once
    broke = pages.select("member", F.when(F.col("member") == "p/7.xml", F.raise_error(F.lit("lost"))).otherwise(F.col("xml")).alias("xml"))
    with pytest.raises(Exception, match="lost"):
        broke.write.format("zip_members").mode("append").save(at)
    assert read() == once


def test_written_archives_are_compressed(spark, tmp_path):
    at = str(tmp_path / "out")
    boxes.archives.register(spark)
    page = PAGE.replace("</folio>", "") + "".join(f'<word index="{k}" x="{k}" y="{k * 7}" width="50" height="20"> daiin </word>' for k in range(500)) + "</folio>"
    pages = spark.createDataFrame([(f"p/{k}.xml", page) for k in range(20)], "member string, xml string").repartition(2)
    pages.write.format("zip_members").mode("append").save(at)
    members = [m for f in Path(at).glob("*.zip") for m in zipfile.ZipFile(f).infolist()]
    assert len(members) == 20
    assert all(m.compress_type == zipfile.ZIP_DEFLATED and m.compress_size * 4 < m.file_size == len(page) for m in members)
    assert sum(f.stat().st_size for f in Path(at).iterdir()) * 4 < 20 * len(page)


def test_archives_in_small_batches(spark, tmp_path):
    at, key = str(tmp_path / "out"), "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    pages = spark.range(0, 12, 1, 1).selectExpr("concat(id, '.xml') as member", "repeat(cast(id % 10 as string), 1000000) as xml")
    boxes.archives.write(pages, at)
    assert spark.conf.get(key) == before
    reader = boxes.archives.ZipMembers({"path": at}).reader(None)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert len(batches) > 2 and max(b.nbytes for b in batches) < boxes.archives.BATCH_BYTES + 1_100_000
    read = [(r["member"], r["xml"], r["error"]) for b in batches for r in b.to_pylist()]
    assert sorted(read) == sorted((r.member, r.xml, None) for r in pages.collect())


def test_pages_of_archives_are_parsed_where_they_are_read(spark, broken, tmp_path):
    shutil.copy(broken / "pages.zip", tmp_path / "one.zip")
    rows = boxes.archive_pages(spark, str(tmp_path))
    by = {r.member: (r.xml is not None, r.plain is not None, r.error is not None) for r in rows.collect()}
    assert {m[2]: x for m, x in by.items()} == {**dict.fromkeys("abh", (False, True, False)), **dict.fromkeys("cdef", (True, False, False)), **dict.fromkeys("gz", (False, False, True))}
    # the same by way of their XML
    xml = spark.read.format("zip_members").load(str(tmp_path))
    values = lambda df: sorted(map(str, df.select("file", "member", "error", "page").collect()))
    assert values(boxes.parsed(rows)) == values(boxes.parsed(xml))


def test_command_line_names_unreadable_files(spark, path, broken, tmp_path, capsys):
    assert cli.main(["physpagepos", "--input", path, "--boxes", str(broken), "--output", str(tmp_path)]) == 0
    assert "4 files can't be read" in capsys.readouterr().err
    assert spark.read.parquet(str(tmp_path / "physpagepos/unreadable")).count() == 4


def test_boxes_of_another_kind(spark):
    with pytest.raises(ValueError, match="neither"):
        boxes.read_boxes(spark, "/nowhere/boxes.csv")


def test_match_rate(spark, folder, source):
    found = boxes.read_boxes(spark, str(folder))
    assert G.match_rate(found, source.pages).first() == (1, 1)


def test_nested_results(spark, source, tmp_path):
    words = source.words()
    counts = C.transitions(words)
    nested = results.nested_transitions(counts, "folio")
    assert nested.where("folio = 'f1v'").first().transitions["^^^^|o"] == 1
    back = results.long_transitions(nested, "folio")
    assert back.exceptAll(counts.select(back.columns)).isEmpty()
    grid = G.histogram(G.place(words), "x_page", "y_page", 5, 10)
    assert results.long_grid(results.nested_grid(grid, "folio"), "folio").exceptAll(grid).isEmpty()
    assert results.nested_positions(C.position_ratios(C.word_positions(words)), "folio").count() == 2
    assert results.nested_profile(C.dense_profile(C.length_profile(words, "word", 3), 3, ("folio",)), "folio").first().profile.keys() == {"1", "2", "3"}
    results.nested_ngrams(C.frequencies(C.ngrams(words), ("folio",)), "folio").collect()
    results.write(nested, str(tmp_path / "t"), "json")
    assert results.read(spark, str(tmp_path / "t"), "json", nested.schema.simpleString().removeprefix("struct<").removesuffix(">").replace("folio:", "folio ").replace("transitions:", "transitions ")).count() == 2
    results.write_config(str(tmp_path / "c.json"))
    assert results.shared_config()["char_order"][:3] == ["p", "f", "t"]


@pytest.mark.parametrize("analysis", ["markov", "ngram", "wordpos", "charpos", "pagepos", "physpagepos"])
def test_command_line(spark, path, folder, tmp_path, analysis):
    extra = ["--boxes", str(folder)] if analysis == "physpagepos" else []
    assert cli.main([analysis, "--input", path, "--output", str(tmp_path), "--aggregations", "all", "herbal", *extra]) == 0
    assert spark.read.parquet(str(tmp_path / analysis / "manifest")).count() == 2


@pytest.mark.parametrize("analysis", ["markov", "ngram", "wordpos", "charpos"])
def test_groups_of_the_command_line_are_counted_without_pages(spark, path, source, tmp_path, analysis):
    """Groups' counts are those of their pages, and come from counts by kinds of pages."""
    out = cli.tables(spark, cli.parser().parse_args([analysis, "--input", path, "--output", str(tmp_path)]))
    for name in (n for n in out if f"pages_{n}" in out):
        measures = [c for c, kind in out[name].dtypes if kind == "bigint" and c != "n"] or ["n"]
        keys = [c for c in out[name].columns if c not in ("agg", *measures)]
        rolled = R.roll_up(out[f"pages_{name}"], source.pages, R.MANUSCRIPT, keys, measures).select(out[name].columns)
        assert not rolled.isEmpty() and rolled.exceptAll(out[name]).isEmpty() and out[name].exceptAll(rolled).isEmpty()
        counting = [x for x in out[name]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x and (" sum(" in x or " count(" in x)]
        assert counting and not any("folio" in x.split("], [")[0] and "min_by" not in x and "max_by" not in x for x in counting if "ngram" in x or "glyph" in x or "from_tok" in x)


def test_command_line_without_input(spark, tmp_path):
    assert cli.main(["markov", "--input", str(tmp_path / "none.txt"), "--output", str(tmp_path)]) == 1


def test_plain_pages_are_parsed_as_others(spark):
    """Pages that are parsed in batches have the content that Spark's parser gives them, and it alone decides on others."""
    word = lambda k, x, more="": f'<word index="{k}" x="-7"{more}>{x}</word>'
    plain = [f'<folio name="f{k}r" width="9">{body}</folio>\n' for k, body in enumerate(("", word(0, " ab\n") + "\n" + word(1, "é>"), word(2, "007", ' height="007"') * 2))]
    odd = [f'<folio name="g{k}r">{body}</folio>' for k, body in enumerate((word(0, "a&amp;b"), word(0, "a") + word(1, "b", ' y="1"'), word(0, "x<i>y</i>"), word(0, "]]>"), word(0, "a", ' x="1"'), word("1.5", "a"), word("99999999999", "a"), word(0, "<!-- no -->a"), "text" + word(0, "a"), word(0, "\x01"), "<word>a</word>", word(0, "")))]
    odd += ["", "no page", plain[1][:-5], plain[1] + "<folio/>", "<?xml version='1.0'?>" + plain[2], plain[2].replace("folio", "page"), plain[2].replace('"9"', "'9'")]
    assert all(map(boxes.plain_page, plain))
    rows = spark.createDataFrame([(x, None) for x in (*plain, *odd, None)], "xml string, error string")
    general = F.from_xml("xml", boxes.SCHEMA + ", _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    wide = rows.select(F.explode_outer(F.array(general)).alias("p")).cache()
    bad = sorted(wide.where("p._malformed is not null").select("p._malformed").toPandas()["_malformed"])
    pages = wide.select(F.when(F.col("p._malformed").isNull(), F.col("p")).alias("page"), F.lit(None).cast("string").alias("error"))
    got, want = boxes.boxes_in(boxes.parsed(rows)), boxes.boxes_in(pages.select("error", F.struct(*(F.col(f"page.{c}").alias(c) for c in ("_name", "_width", "_height", "_wordCount", "word"))).alias("page")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert boxes.parsed(rows).where("error is not null").count() == len(bad) > 5
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1


def test_plain_words_of_other_orders_and_pages_between(spark):
    """Pages of several orders of attributes, without words, broken off, or with something between words, in one batch."""
    word = lambda k, names: "<word" + "".join(f' {n}="{k}"' for n in names) + f">w{k} </word>"
    kinds = [("index", "x"), ("x", "index"), ("index",), ("height", "width", "y", "x", "index")]
    pages = [f'<folio name="p{k}">{between}{word(k, kinds[k % 4])}{between}{word(k + 1, kinds[k % 4 if k % 11 else 0])}\n</folio>' for k in range(150) for between in [("", " ", "<!-- -->", "text")[k % 7 % 4]]]
    pages[20:20], pages[90:90] = ['<folio name="e"> </folio>', pages[3][:-4], "", pages[5][:60]], [None, '<folio name="e2"></folio>']
    rows = spark.createDataFrame([(f"f{k}", None, x, None) for k, x in enumerate(pages)], "file string, member string, xml string, error string").coalesce(1)
    general = F.from_xml("xml", boxes.SCHEMA + ", _malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    wide = rows.select("file", F.explode_outer(F.array(general)).alias("p")).cache()
    bad = {r.file for r in wide.where("p._malformed is not null").collect()}
    right = wide.select(F.when(F.col("p._malformed").isNull(), F.col("p")).alias("page"), F.lit(None).cast("string").alias("error"))
    want = boxes.boxes_in(right.select("error", F.struct(*(F.col(f"page.{c}").alias(c) for c in ("_name", "_width", "_height", "_wordCount", "word"))).alias("page")))
    found = boxes.parsed(rows).cache()
    assert sorted(map(tuple, boxes.boxes_in(found).collect())) == sorted(map(tuple, want.collect()))
    counts = boxes.counts_in(found).collect()
    assert {r.file for r in counts if r.error} == bad and len(bad) >= 3
    assert sorted((r.folio, r.words) for r in counts if not r.error) == sorted((r.folio, r["count"]) for r in want.groupBy("folio").count().collect())


def test_pages_are_parsed_once_for_words_and_errors(spark):
    plan = source_queries.xml_unreadable(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and plan.count("MapInArrow") == 1


def test_extents_of_glyphs_without_a_row_for_each(spark):
    rows = [("a", 100, 50, 0, 3, 4, 30, 9, "daiin"), ("a", 100, 50, 1, 40, 4, -7, 9, "o!l"), ("a", 100, 50, 2, 0, 0, 5, 5, "!"), ("b", 9, 9, 0, 1, 2, 0, 3, "k")]
    words = spark.createDataFrame(rows, "folio string, page_width int, page_height int, word_idx int, x int, y int, width int, height int, text string")
    ends = lambda low, high: (F.min(low), F.max(high), F.min("y"), F.max("y"))
    every = G.glyph_boxes(words).groupBy("folio").agg(F.count("*"), *ends("x", "x"))
    some = G.glyph_extents(words).groupBy("folio").agg(F.sum("glyphs"), *ends("min_x", "max_x"))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))
    plan = source_queries.xml_box_extents(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 0
