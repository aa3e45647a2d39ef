import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphmill.functions import boxes as B
from glyphmill.functions import numbers, persian, protocol, scripts, states
from glyphmill.operators.evaluation import score
from glyphmill.operators.lexicon import drift, mentions, upsert
from glyphmill.operators.replies import merge, parse_reply, parse_replies
from glyphmill.operators.windows import first_violation, look_back, runs

FIXED = [
    ("سلام , خوبي ?", "سلام، خوبی؟"),
    ("كتاب ها را بردار", "کتاب‌ها را بردار"),
    ("دوست هایم", "دوست‌هایم"),
    ("حواست باشه ها!", "حواست باشه ها!"),
    ('گفت: "سلام Bob"', "گفت: «سلام Bob»"),
    ("صبر کن...", "صبر کن…"),
    ("۱۲ و 34", "۱۲ و ۳۴"),
    ("Vol. 2, ch. 3", "Vol. 2, ch. 3"),
    ("ببین http://a.b/ك?x=1 را", "ببین http://a.b/ك?x=1 را"),
    ("نه!!!!!!", "نه!!!"),
    ("آره. …ببخشید.", "آره. …ببخشید."),
    ("می روم", "می روم"),
    ("یک\r\nدو  سه", "یک\nدو سه"),
    ("", ""),
    (None, None),
]
LINT = [
    ("كتاب", ["arabic-forms"]),
    ("«سلام", ["guillemets"]),
    ('"سلام"', ["latin-quotes"]),
    ("سلام،،", ["double-punctuation"]),
    ("می روم", ["zwnj-review"]),
    ("This is an English sentence left", ["untranslated"]),
    ("سلام 駅", ["source-script-left"]),
    ("سلامBob", ["script-collision"]),
    ("پست من a.b@c.de است", []),
    ("...", []),
    (None, []),
]


@pytest.mark.parametrize("before,after", FIXED)
def test_fixed_lines(before, after):
    assert persian.fix_text(before) == after


@settings(max_examples=300, deadline=None)
@given(st.text("سلامكي ها،,?.!\"«»12٣a \n", max_size=25))
def test_fixing_twice_changes_nothing(text):
    once = persian.fix_text(text)
    assert persian.fix_text(once) == once


@pytest.mark.parametrize("text,codes", LINT)
def test_lint(text, codes):
    assert persian.lint(text) == codes


def test_settled_codes():
    assert persian.lint("می روم", ("zwnj-review",)) == [] and persian.lint("می روم", ("zwnj-review",), ["می روم"]) == []
    assert persian.lint("می روم می خورم", ("zwnj-review",), ["می روم"]) == ["zwnj-review"]
    assert persian.doubtful_joins("می روم، بزرگ تر") == ["می روم", "بزرگ تر"]


def test_quantities_and_forms():
    assert numbers.quantities("۱۲,۵۰ و v2 و 1.2.3 و -0 و 007 و 1e5") == ["0", "12.5", "7"]
    assert numbers.canonical("-۰۰۱٫۵۰") == "-1.5" and numbers.quantities(None) == []
    assert numbers.uses("Iron  Gate!", ["Iron Gate"]) and not numbers.uses("Irony Gate", ["Iron Gate"]) and not numbers.uses("C+++", ["C++"])
    assert numbers.uses("دروازه بزرگ", ["دروازه"]) and not numbers.uses("دروازهها", ["دروازه"]) and numbers.uses("鉄門前", ["鉄門"]) and not numbers.uses(None, ["a", None])


def test_boxes(spark):
    df = spark.createDataFrame([([0, 0, 10, 10], [5, 5, 10, 10]), ([0, 0, 4, 4], [7, 8, 2, 2]), (None, [1, 1, 1, 1])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(B.area(a).alias("area"), B.overlap(a, b).alias("o"), B.intersection(a, b).alias("i"), F.round(B.iou(a, b), 4).alias("iou"), B.gap(a, b).alias("gap"), B.clamp(b, F.lit(12), F.lit(9)).alias("c"), B.contains(a, b).alias("in")).collect()
    assert [tuple(r) for r in rows[:2]] == [(100, 25, [5, 5, 5, 5], 0.1429, 0.0, [5, 5, 7, 4], False), (16, 0, [0, 0, 0, 0], 0.0, 5.0, [7, 8, 2, 1], False)]
    parsed = spark.createDataFrame([("1, 2 30 40",), ("1 2 3 40",), ("x",), (None,)], "t string").select(B.parse(F.col("t")).alias("p")).collect()
    assert [r.p for r in parsed] == [[1, 2, 30, 40], None, None, None]


def test_states(spark):
    rows = [("speech", None, None, None, "x", None, None), ("sfx", None, None, None, "x", None, None), ("speech", True, None, None, "x", None, None), ("speech", None, None, True, "", "flat", None), ("speech", None, None, True, "", "keep", None), ("speech", None, None, None, " 　", None, ["a"]), ("speech", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, dropped boolean, keep boolean, erase boolean, target_text string, fill string, review array<string>").withColumn("policy", F.lit("keep"))
    assert [r.s for r in df.select(states.region_state().alias("s")).collect()] == ["translated", "kept_by_policy", "dropped_false_detection", "erased", "needs_review", "needs_review", "unresolved"]
    assert [r.e for r in df.select(states.may_be_edited().alias("e")).collect()] == [True, False, False, True, True, True, True]


def test_scripts_and_protocol(spark):
    df = spark.createDataFrame([("سلام abc",), ("駅です",), ("",), (None,)], "t string")
    counted = scripts.counts(F.col("t"))
    assert [r.d for r in df.select(scripts.dominant(counted).alias("d")).collect()] == ["arabic", "hiragana", "none", "none"]
    names = spark.createDataFrame([("a10.png",), ("a2.png",), ("A1.png",)], "n string").orderBy(protocol.natural_key(F.col("n"))).collect()
    assert [r.n for r in names] == ["A1.png", "a2.png", "a10.png"]
    three = spark.createDataFrame([(False, "x"), (True, ""), (True, "y")], "given boolean, v string").select(protocol.tri_state(F.col("given"), F.col("v"), F.lit("old")).alias("r")).collect()
    assert [r.r for r in three] == ["old", None, "y"]


REPLY = "ignored\n@@ p0001 p0001r001 speech\nfa: one\n\n  two\n\\@@ three\n# note to self\nnote: a\nnote: b\n@@ p0001r002\nfa: x\nfa: y\n@@ p0001r001\ndrop: yes\n"


def test_reply_protocol(spark):
    rows = {(r["region_id"], r["field"]): r for r in parse_reply(REPLY)}
    assert rows["p0001r001", "fa"]["values"] == ["one\n\n  two\n@@ three"] and rows["p0001r001", "note"]["values"] == ["a", "b"]
    assert rows["p0001r001", "fa"]["seen"] == 2 and rows["p0001r002", "fa"]["repeated"] and rows["p0001r001", "drop"]["values"] == ["yes"]
    assert parse_reply(None) == [] and parse_reply("@@ p0001r009\n")[0]["field"] is None
    df = spark.createDataFrame([("f", REPLY), ("g", None)], "path string, value string")
    assert parse_replies(df, "path", "value").count() == 4


def test_merge_is_all_or_none(spark):
    regions = spark.createDataFrame([(1, "p", "old", True), (2, "p", None, None), (3, "q", None, None), (4, "r", None, None)], "region_key bigint, page string, target_text string, locked boolean").selectExpr("*", "cast(null as boolean) dropped", "cast(null as boolean) keep", "cast(null as boolean) erase")
    sheet = [(1, 1, "p", "new", None, "speech", 1), (2, 2, "p", "two", None, "speech", 1), (3, 3, "q", "three", None, "shout", 1), (4, 4, "r", None, "drop", "sfx", 1), (5, 2, "p", "newest", None, "speech", 1)]
    replies = spark.createDataFrame(sheet, "ws_key bigint, region_key bigint, page string, fa string, answer string, kind string, seen int").withColumn("received_at", F.col("ws_key"))
    got = {r.region_key: (r.target_text, r.dropped, r.outcome) for r in merge(regions, replies, ["page"]).collect()}
    assert got == {1: ("old", False, "locked"), 2: ("newest", False, "applied"), 3: (None, False, "page_refused"), 4: (None, True, "answered")}


def test_terms(spark):
    texts = spark.createDataFrame([(1, "The old map, torn", "نقشه قدیمی"), (2, "old mapping", "x"), (3, "OLD map old map", "نقشه"), (4, None, None)], "k bigint, s string, t string")
    terms = spark.createDataFrame([("map", "old map", "نقشه قدیمی")], "term string, form string, target string")
    assert {r.k for r in mentions(texts, "k", "s", terms).collect()} == {1, 3} and [r.k for r in drift(texts, "k", "s", "t", terms).collect()] == [3]
    assert mentions(texts.limit(0), "k", "s", terms).count() == 0
    old = spark.createDataFrame([("a", "x", True, 1, None), ("b", "x", False, 1, None), ("c", "x", True, 2, None)], "term string, target string, locked boolean, version int, previous array<struct<target:string,version:int>>")
    new = spark.createDataFrame([("a", "y"), ("b", "y"), ("c", " "), ("d", "z")], "term string, target string")
    got = {r.term: (r.target, r.version, len(r.previous)) for r in upsert(old, new, "term", "target").collect()}
    assert got == {"a": ("y", 2, 1), "b": ("y", 1, 0), "c": ("x", 2, 0), "d": ("z", 1, 0)}


def test_windows(spark):
    rows = [("u", f"p{p:02d}", 10 * p + i, 900) for p in range(1, 5) for i in range(2)]
    df = spark.createDataFrame(rows, "u string, page string, k bigint, cost int")
    kept, flags = look_back(df, df, ["u"], "page", ["k"], F.col("cost"), budget=3000, most=24)
    assert {r.for_page: (r.kept, r.truncated) for r in flags.collect()} == {"p01": (0, False), "p02": (2, False), "p03": (3, True), "p04": (3, True)}
    assert [r.k for r in kept.where("for_page = 'p04'").orderBy("back").collect()] == [31, 30, 21]
    assert [(r.at, r.why) for r in first_violation(df, ["u"], ["k"], F.col("cost"), 1000, 2000, 99).collect()] == [(3, "total too large")]
    line = spark.createDataFrame([("u", i, i not in (3, 6)) for i in range(9)], "u string, i int, v boolean")
    assert sorted((r.start, r.length) for r in runs(line, ["u"], "i", F.col("v"), 3).collect()) == [(0, 3)]


def test_score_refuses_unknown_answers(spark):
    cases = spark.createDataFrame([("a", ["x"], None, None), ("b", ["y"], None, True)], "id string, accept array<string>, units int, human_only boolean").withColumn("must_preserve", F.lit(None).cast("struct<negation:boolean,terms:array<string>,ellipsis:boolean>"))
    answers = spark.createDataFrame([("a", " x"), ("b", "z")], "id string, answer string")
    assert {r.id: r.verdict for r in score(cases, answers).collect()} == {"a": "exact", "b": "human"}
    with pytest.raises(Exception, match="no such case"):
        score(cases, answers.unionByName(spark.createDataFrame([("q", "z")], "id string, answer string"))).collect()
