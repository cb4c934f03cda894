"""Command line: one analysis of a transcription (or word boxes), by page and by group.

    python -m lexigrid.cli markov --input corpus.txt --output out [--aggregations all hand_1]
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.profiles import PROFILES
from .operators import counts as C
from .operators import grids as G
from .operators import groups as R
from .sources import boxes, corpus, results

ANALYSES = ("markov", "ngram", "wordpos", "charpos", "pagepos", "physpagepos")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexigrid", description=__doc__)
    p.add_argument("analysis", choices=ANALYSES)
    p.add_argument("--input", required=True, help="transcription file or folder")
    p.add_argument("--boxes", help="word boxes: a folder of XML files or a zip archive (physpagepos)")
    p.add_argument("--output", required=True)
    p.add_argument("--bigram-mode", choices=("distinct", "collapsed"), default="distinct")
    p.add_argument("--aggregations", nargs="*", help="names of groups; all by default")
    p.add_argument("--min-count", type=int, default=5, help="least count of n-grams in results (ngram)")
    p.add_argument("--min-word-length", type=int, default=1, help="wordpos")
    p.add_argument("--max-word-length", type=int, default=9, help="charpos")
    p.add_argument("--max-line-length", type=int, default=12, help="charpos")
    for border in ("word", "line", "para", "page"):
        p.add_argument(f"--no-{border}-boundaries", dest=border, action="store_false", help="markov")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """Results by name; those by page first."""
    profile = PROFILES[f"eva_{args.bigram_mode}"]
    source = corpus.from_transcription(spark, args.input)
    groups = R.select(R.MANUSCRIPT, args.aggregations)
    words = source.words(profile)
    # lines know their page's groups, so what groups need is counted without a row for each page and item
    marked = words.join(source.pages.select("file", "page_idx", R.marks(groups)), ["file", "page_idx"])
    out: dict[str, DataFrame] = {}

    def both(name: str, counts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
        out[f"pages_{name}"] = counts
        out[name] = rolled = R.roll_up(counts, source.pages, groups, keys, measures)
        return rolled

    def counted(name: str, count: Callable[[DataFrame, tuple[str, ...]], DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
        out[f"pages_{name}"] = count(words, ("folio",))
        out[name] = rolled = R.roll_up_marks(count(marked, (R.MARKS,)), groups, keys, measures)
        return rolled

    if args.analysis == "markov":
        rolled = counted("transitions", lambda rows, by: C.transitions(rows, by=by, word=args.word, line=args.line, para=args.para, page=args.page), ["from_tok", "to_tok"], ["n"])
        out["probabilities"] = C.probabilities(rolled, ("agg",))
    elif args.analysis == "ngram":
        rolled = counted("ngrams", lambda rows, by: C.ngrams(rows, by=by), ["n", "ngram"], ["cnt"])
        out["frequencies"] = C.frequencies(rolled, ("agg",), args.min_count)
        out["bigram_matrix"] = C.dense_bigrams(rolled, ("agg",))
    elif args.analysis == "wordpos":
        rolled = counted("positions", lambda rows, by: C.word_positions(rows, by, args.min_word_length), ["glyph"], [*C.POSITIONS, "total"])
        out["ratios"] = C.position_ratios(rolled)
    elif args.analysis == "charpos":
        for scope, most in (("word", args.max_word_length), ("line", args.max_line_length)):
            rolled = counted(f"{scope}_profile", lambda rows, by, scope=scope, most=most: C.length_profile(rows, scope, most, by), ["glyph", "length", "pos"], ["n"])
            out[f"{scope}_ratios"] = C.dense_profile(rolled, most, ("agg",))
    elif args.analysis == "pagepos":
        placed = G.place(words)
        for mode in ("page", "ms"):
            for name, (cols, rows) in G.TEXT_GRIDS.items():
                both(f"grid_{mode}_{name}", G.histogram(placed, f"x_{mode}", f"y_{mode}", cols, rows), ["glyph", "col", "row"], ["n"])
        both("grid_raw", G.raw_text_grid(placed), ["glyph", "col", "row"], ["n"])
    else:
        pages = boxes.read_pages(spark, args.boxes)
        out["unreadable"] = boxes.unreadable(pages)
        found = boxes.boxes_in(pages)
        placed = G.place_boxes(G.glyph_boxes(found, profile), found)
        for mode in ("page", "ms"):
            for name in ("coarse", "fine"):
                both(f"grid_{mode}_{name}", G.histogram(placed, f"x_{mode}", f"y_{mode}", *G.PIXEL_GRIDS[name]), ["glyph", "col", "row"], ["n"])
        both("grid_raw", G.raw_pixel_grid(placed), ["glyph", "col", "row"], ["n"])
        out["match_rate"] = G.match_rate(found, source.pages)
    out["manifest"] = R.manifest(source.pages, groups)
    out["domains"] = R.domains(source.pages, ["language", "hand", "illustration"])
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.analysis == "physpagepos" and not args.boxes:
        print("physpagepos needs --boxes", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lexigrid").getOrCreate()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(args.input)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        print(f"no such input: {args.input}", file=sys.stderr)
        return 1
    for name, rows in tables(spark, args).items():
        results.write(rows, f"{args.output}/{args.analysis}/{name}", by="agg" if "agg" in rows.columns and name != "manifest" else None)
        if name == "unreadable" and (skipped := results.read(spark, f"{args.output}/{args.analysis}/{name}").count()):
            print(f"warning: {skipped} files can't be read; they are named in {args.output}/{args.analysis}/{name}", file=sys.stderr)
        if args.verbose:
            print(name, results.read(spark, f"{args.output}/{args.analysis}/{name}").agg(F.count("*")).first()[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
