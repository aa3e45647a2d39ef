import random

import numpy as np

from glyphmill.llm.levels import BUCKETS, LEVELS, Ordinal, Reader, plain, reading_levels, vote

made = random.Random(11)
EN = {
    1: ["The {} is big.", "I see a {}.", "Where is the {}?", "Go home, {}!"],
    2: ["After lunch the two friends walked back to the {} and waited.", "We changed the {} in the picture because it did not fit well."],
    3: ["Although the {} appears only twice in this chapter, the translator decided to keep its name consistent because later volumes depend on it."],
    4: ["Whatever heuristic legitimacy accrues to the {}, notwithstanding poststructuralist methodological objections, necessitates phenomenological reappraisal of epistemological commensurability."],
}
FA = {
    1: ["آن {} بزرگ بود.", "من {} را می‌بینم.", "این {} مال من است."],
    2: ["بعد از ناهار دو دوست کنار {} نشستند و حرف زدند.", "لطفا پیش از فرستادن صفحه، نام {} را یک بار دیگر نگاه کن."],
    3: ["ویراستار که هر دو نسخه را با دقت مقایسه کرده بود، متوجه شد لحن {} پس از خیانت به شکل محسوسی آگاهانه کهن شده است."],
    4: ["هرگونه تلقی اکتشافی از {}، از آن حیث که متکی بر پیش‌فرض‌هایی ناظر به چندصدایی گفتاری است، لاجرم به تقلیل مناسبات دلالی و انسداد امکان‌های تاویلی مضمر در متن می‌انجامد."],
}
NOUNS = {"en": "boat lamp bird door king stone".split(), "fa": "قایق چراغ پرنده در شاه سنگ".split()}


def document(lang, level, words=90, sep=" "):
    out = []
    while sum(len(x.split()) for x in out) < words:
        out.append(made.choice((EN if lang == "en" else FA)[level]).format(made.choice(NOUNS[lang])))
    return sep.join(out)


def test_levels(spark):
    texts, graded = {}, []
    for i in range(160):
        lang, level = ("en", "fa")[i % 2], LEVELS[i // 2 % 4]
        texts[i] = document(lang, level)
        if i < 80:
            graded.append((i, level, "x"))
    mostly = document("en", 2, 120) + " " + document("en", 3, 40)
    odd = {200: None, 201: "", 202: " \n", 203: "The boat is big.", 204: "駅で待っている。" * 60, 205: document("en", 4).upper(), 206: document("fa", 1, sep="\n- "),
           207: mostly, 208: "\n".join(f"Ana: {s}." for s in document("en", 2, 200).split(".") if s), 209: document("en", 1, 3000)}
    docs = spark.createDataFrame([(k, v, 1) for k, v in {**texts, **odd}.items()], "doc_id bigint, text string, reading_level int")
    levels = spark.createDataFrame(graded, "doc_id bigint, reading_level int, text string")
    got = {r.doc_id: r.reading_level for r in reading_levels(docs, levels).collect()}
    held_out = [got[i] == LEVELS[i // 2 % 4] for i in range(80, 160)]
    assert sum(held_out) >= 0.95 * len(held_out)
    assert {k: got.get(k) for k in odd} == {200: None, 201: None, 202: None, 203: None, 204: None, 205: 4, 206: 1, 207: 2, 208: None, 209: 1}
    assert reading_levels(docs, levels.limit(0)).count() == 0 and reading_levels(docs.limit(0), levels).count() == 0


def test_sentences_are_counted_by_hand():
    text, lang, words, features = Reader().sentences(["We ran, because it rained. The dog was in the wet wet house!", None], np.ones(BUCKETS))
    assert text.tolist() == [0, 0] and lang.tolist() == [0, 0] and words.tolist() == [5, 8]
    assert features[0, 4] == np.log1p(1) and features[0, 5] == np.log1p(2) and features[1, 6] == 6 / 8


def test_vote_and_plain():
    level, size = vote(np.array([0, 0, 0, 1]), np.array([2, 3, 2, 4]), np.array([5, 50, 5, 7]), 3)
    assert level.tolist() == [2, 4, 1] and size.tolist() == [60, 7, 0]
    assert plain("- See it (p. 4, cf. 2) now").split() == ["see", "it", "now"] and plain("Ana: x\nBen: y\nAna: z") == ""


def test_ordinal_keeps_the_order():
    x = np.linspace(0, 4, 400)[:, None] * np.ones((1, 3))
    level = np.minimum(4, 1 + x[:, 0].astype(int))
    model = Ordinal().fit(x, np.zeros(400, int), level, np.ones(400))
    assert (np.diff(model.levels(x, np.zeros(400, int))) >= 0).all() and (model.levels(x, np.zeros(400, int)) == level).mean() > 0.9
