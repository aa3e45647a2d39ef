import pytest

from glyphmill.llm.pairs import Judge, Suffixes, broken_pairs, copied

ENDS = [("He left.", "او رفت.")] * 4 + [("He left now.", "او حالا رفت.")] * 4
PAIRS = [
    ("Wait for me. Then go.", None, "empty"),
    ("Wait for me. Then go.", "…", "empty"),
    ("Wait for me at the gate.", "(wait FOR me, at the gate)", "copy"),
    ("Wait for me at the gate.", "I'm sorry, I can't translate this text.", "refusal"),
    ("Wait for me at the gate.", "متاسفم، نمی‌توانم این متن را ترجمه کنم.", "refusal"),
    ("Sorry, I can't help you open the box.", "ببخشید، نمی‌توانم کمکت کنم جعبه را باز کنی.", None),
    ("Wait for me at the gate.", "Warte am Tor auf mich.", "other_language"),
    ("Wait for me at the gate.", "انتظرنا ثلاثة أيام ولم تصل الرسالة بعد.", "other_language"),
    ("Wait for me. Then go.", "منتظرم باش.", "truncated"),
    ("Wait for me.", "منتظر،", "truncated"),
    ("Wait for me.", "منتظر", "truncated"),
    ("He left.", "او رفت", None),
    ("If only the key—", "کاش کلید—", None),
    ("Hmm", "هوم", None),
    ("...", None, None),
    (None, "او رفت.", None),
    ("He left.", "براي او كتابي خريد.", None),
]


def slow_copied(prompt, response):
    hit = [False] * len(prompt)
    least = min(4, len(prompt))
    for a in range(len(prompt)):
        for b in range(a + least, len(prompt) + 1):
            if prompt[a:b] in response:
                hit[a:b] = [True] * (b - a)
    return sum(hit) / len(prompt)


@pytest.mark.parametrize("prompt,response", [("abcdefgh", "xxabcdefgyy"), ("abcabcabcd", "abcabcabc"), ("aaaa", "aaa"), ("noon", "noon"), ("abcdefghij", "abcd0efghij")])
def test_copied_share(prompt, response):
    slow = slow_copied(prompt, response)
    assert copied(prompt, response) == slow or (slow < 0.9 and copied(prompt, response) < 0.9)


def test_automaton_knows_all_substrings():
    text = "abacabadabacaba"
    states = Suffixes(text)
    for a in range(len(text)):
        for b in range(a + 1, len(text) + 1):
            ((start, end),) = states.matches(text[a:b])
            assert text[start:end] == text[a:b]


def test_defects(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(PAIRS)] + [(100 + i, a, b) for i, (a, b) in enumerate(ENDS)]
    df = spark.createDataFrame(rows, "region_key bigint, source_text string, target_text string").selectExpr("*", "1 as defect", "2 as w", "3 as salt")
    got = {r.region_key: r.defect for r in broken_pairs(df, "region_key", "source_text", "target_text").collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(PAIRS) if d}
    assert broken_pairs(df.limit(0), "region_key", "source_text", "target_text").count() == 0


def test_long_text():
    long = "wort " * 40_000
    assert Judge().defect(long, long, True) == "copy"
