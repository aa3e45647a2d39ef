import io

from pyspark.sql import functions as F

from glyphmill.functions import numbers, protocol
from glyphmill.operators.replies import add_regions, corrected, stamped
from glyphmill.sources.readers import frames, term_records


def test_number_spellings():
    yes = [("3:30", "ساعت ۳ : ۳۰ آمد"), ("007", "7 نفر"), ("1/2", "یک 1/2 لیوان"), ("سه", "سه نفر"), ("12 kg", "وزن 12 kg بود")]
    no = [("3:30", "30:3"), ("3:30", "3:30:15"), ("سه", "سه\u200cشنبه"), ("12", "120"), ("", "x")]
    assert all(numbers.spelling_used(*x) for x in yes) and not any(numbers.spelling_used(*x) for x in no)


def test_prefixes_tokens_runs_sources(spark):
    df = spark.createDataFrame([(["ab", "c", "d"], "a b\n\nc", "سلام abc دنیا", ["clean.png", "p.png"])], "v array<string>, t string, d string, there array<string>")
    row = df.select(
        protocol.fitted_prefix(F.col("v"), 11).alias("two"),
        protocol.fitted_prefix(F.col("v"), 3).alias("none"),
        protocol.tokens_per_line(F.col("t")).alias("t"),
        protocol.directional_runs(F.col("d")).alias("runs"),
        protocol.page_source(F.lit("final.png"), F.lit("clean.png"), F.lit("p.png"), F.col("there")).alias("s"),
    ).first()
    assert (row.two, row.none, row.t, row.s) == (["ab", "c"], [], [["a", "b"], [], ["c"]], "clean.png") and "".join(row.runs) == "سلام abc دنیا" and len(row.runs) == 3


def test_term_records_and_frames(spark):
    df = spark.createDataFrame([('{"a": "x", "b": {"target": "y", "locked": true, "aliases": ["c"]}, "d": " ", "e": {"locked": true}}',)], "j string")
    got = {r.term: (r.target, r.locked, r.fault) for r in term_records(df, "j").collect()}
    assert got["a"] == ("x", False, None) and got["b"] == ("y", True, None) and got["d"][2] == "no target" and got["e"][2] == "no target"
    assert list(frames(io.BytesIO(b"ab\n\xff\n" + b"x" * 50 + b"\nlast"), 10)) == [("ab", None), (None, "not UTF-8"), (None, "too long"), ("last", None)]


def test_corrections_additions_and_stamps(spark):
    regions = spark.createDataFrame([(1, [0, 0, 9, 9], "light", "flat", "clean"), (2, [1, 1, 5, 5], "light", "flat", "clean")], "region_key bigint, bbox array<int>, polarity string, fill string, clean_status string")
    fixes = spark.createDataFrame([(1, [5, 5, 500, 5], None)], "region_key bigint, box array<int>, polarity string")
    got = {r.region_key: (r.bbox, r.fill) for r in corrected(regions, fixes, F.lit(100), F.lit(100)).collect()}
    assert got == {1: ([5, 5, 95, 5], None), 2: ([1, 1, 5, 5], "flat")}
    have = spark.createDataFrame([("p", None, "x"), ("p", "+a", "old")], "page string, added_as string, target_text string")
    new = spark.createDataFrame([("p", "+a", "new"), ("p", "+b", "b")], "page string, slug string, fa string")
    assert sorted((r.added_as or "", r.target_text) for r in add_regions(have, new, ["page"]).collect()) == [("", "x"), ("+a", "new"), ("+b", "b")]
    rec = spark.createDataFrame([("p1", "masks", "1"), ("p2", "masks", "1"), ("gone", "masks", "1")], "page string, stage string, revision string")
    done = spark.createDataFrame([("p1", "2"), ("p3", "2")], "page string, revision string")
    left = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "page string")
    assert {(r.page, r.revision) for r in stamped(rec, done, left, "masks", ["page"]).collect()} == {("p1", "2"), ("p2", "1"), ("p3", "2")}
