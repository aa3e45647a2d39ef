import random

import numpy as np

from glyphmill.llm.leaks import RADIUS, Items, Passage, find, leaks, words

NOUNS = "falcon ledger anchor banner tablet census furnace orchard mirror lantern saddle chapel meadow barrel".split()
made = random.Random(7)


def sentence(n):
    return " ".join(made.choice(["the", "a", "old", "near", "quietly"]) if i % 2 else made.choice(NOUNS) + made.choice("abcdefgh") for i in range(n))


CASES = [(f"c-{i}", sentence(60), f"言っただろ、温室では誰も{'アイウエオカキクケコ'[i]}ロを知らない。夜明けまで車庫のそばで待っている{i}。", f"I told you {sentence(14)}", [sentence(14), "x"]) for i in range(10)]
FILL = " ".join(f"filler{i}" for i in range(80))


def test_kinds_of_leaks(spark):
    ctx = [c[1].split() for c in CASES]
    swapped = ["that" if i % 9 == 4 else w for i, w in enumerate(ctx[1])]
    texts = {
        1: f"{FILL} {CASES[0][1].upper()} {FILL}",
        2: f"{FILL} {' '.join(swapped)} {FILL}",
        3: f"{FILL} {' '.join(ctx[2][20:56])} {FILL}",
        4: f"{FILL} {' '.join(ctx[3][20:32])} {FILL}",  # a short phrase
        5: f"{CASES[4][2]} {FILL} {CASES[4][3]}",
        6: f"{CASES[5][2]} fa: {CASES[5][4][0]}",
        7: CASES[6][2],  # no answer beside it
        8: " ".join(sorted(ctx[7])),  # other order
        9: None, 10: "", 11: " \n", 12: f"c-8 {FILL}",
        13: (f"{FILL} " * 300) + CASES[9][1].replace("a", "а") + f" {FILL}" * 30,
    }
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id bigint, text string, case_id int")
    cases = spark.createDataFrame([(*c[:4], c[4], 1) for c in CASES], "id string, context string, source string, gloss string, accept array<string>, doc_id int")
    got = {tuple(r) for r in leaks(docs, cases).collect()}
    assert got == {(1, "c-0"), (2, "c-1"), (3, "c-2"), (5, "c-4"), (6, "c-5"), (13, "c-9")}
    assert leaks(docs.limit(0), cases).count() == 0 and leaks(docs, cases.limit(0)).count() == 0


def test_multi_index_equals_brute_force():
    items = Items([(c[0], c[1], c[2], [c[3]]) for c in CASES])
    index = items.indexes[24]
    rng = np.random.default_rng(3)
    prints = index.prints[rng.integers(0, len(index.prints), 200)].copy()
    for i in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 12), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    who, other = index.near(prints)
    far = np.bitwise_count(prints[:, None] ^ index.prints[None, :])
    assert set(zip(who.tolist(), other.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= RADIUS))))


def test_share_and_words():
    assert Passage([1, 2, 3, 4]).share([9, 1, 3, 2, 4]) == 0.75 and Passage([]).share([1]) == 0.0
    assert words("Ｈello, WОRLD 駅で") == ["hello", "world", "駅", "で"] and words(None) == []
    assert find(Items([]), ["a b c", None]) == []
