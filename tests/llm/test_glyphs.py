import __spark_entry__
from glyphmill.llm.glyphs import glyph_form, same_glyphs

SAME = [
    ("Ａｂ　１", "Ab 1"),
    ("ｶﾞ", "ガ"),
    ("ガ", "ガ"),
    ("café", "café"),
    ("pаst­", "past"),
    ("⼈", "人"),
    ("مي‌رود"[:2] + "ر", "میر"),  # yeh that joins on
    ("د‌ر", "در"),  # dal never joins on
    ("ﺑﺎ", "با"),
    ("تو بودي", "تو بودی"),
    ("یك", "یک"),
    ("ب\u200bا", "با"),  # letters join across a zero-width space
    ("١٢", "۱۲"),
]
DIFFERENT = [
    ("ab", "Ab"),
    ("a.", "a"),
    ("cafe", "café"),
    ("می‌ر", "میر"),
    ("٤", "۴"),
    ("a²", "a2"),
]


def test_form():
    for a, b in SAME:
        assert glyph_form(a) == glyph_form(b), (a, b)
    for a, b in DIFFERENT:
        assert glyph_form(a) != glyph_form(b), (a, b)
    assert glyph_form("...​") is None and glyph_form(None) is None


def test_p4_is_registered_and_pairs_are_right(spark):
    assert "p4_found" in __spark_entry__.queries()
    regions = spark.createDataFrame(
        [(1, "ab", "x"), (2, "ａb", None), (3, "ab", "..."), (4, "AB", "．．．")],
        "region_key bigint, source_text string, target_text string",
    )
    cases = spark.createDataFrame([(1, ["q", "p­"]), (2, ["p", "q"]), (3, None), (4, ["z", "ｚ"])], "case_no bigint, accept array<string>")
    got = {tuple(r) for r in same_glyphs(regions, cases).collect()}
    assert got == {("source_text", 1, 2), ("source_text", 2, 3), ("accept", 1, 2)}


def test_empty_tables_nulls_long_texts_and_repeated_rows(spark):
    long = "ab " * 50_000
    regions = spark.createDataFrame(
        [(1, long, None, 5), (2, long.replace("a", "ａ", 1), None, 5), (3, long, None, 5), (4, "", " ", 5)],
        "region_key bigint, source_text string, target_text string, form int",
    ).selectExpr("*", "1 as field", "2 as key", "3 as text", "4 as salt")
    cases = spark.createDataFrame([(1, None)], "case_no bigint, accept array<string>").selectExpr("*", "1 as key")
    assert {tuple(r) for r in same_glyphs(regions, cases).collect()} == {("source_text", 1, 2), ("source_text", 2, 3)}
    assert same_glyphs(regions.limit(0), cases.limit(0)).count() == 0


def test_pairs_equal_brute_force(spark):
    import random

    made = random.Random(8)
    texts = ["".join(made.choice(["a", "ａ", "b", "\u00ad", " ", "\u00a0", "ی", "ي"]) for _ in range(3)) for _ in range(60)]
    regions = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "region_key bigint, source_text string, target_text string")
    cases = spark.createDataFrame([], "case_no bigint, accept array<string>")
    got = {(r.key_a, r.key_b) for r in same_glyphs(regions, cases).collect()}
    forms = [glyph_form(t) for t in texts]
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if forms[i] is not None and forms[i] == forms[j] and texts[i] != texts[j]}
