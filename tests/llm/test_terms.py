import __spark_entry__
from glyphmill.llm.terms import Bank, distance, match_terms, words

BANK = [("Iron Gate", "دروازه آهنین"), ("Silent Harvest", "خرمن خاموش"), ("Burning Harvest", None), ("Betefara", "بتفارا")]
SAID = [
    (1, " iRON gATE ,,Gate Iron، the Silnet Harvests (p. 12)"),
    (2, "IronGate, Iron Harvest, Silent Gate, دروازه آهنين, tbd"),
    (3, None),
    (4, " , ،"),
    (5, "«Betefaara's», Burnign harvset - term, Golden Gate, Betefara Rokogaba"),
]
FOUND = {
    (1, 1): "Iron Gate", (1, 2): "Iron Gate", (1, 3): "Silent Harvest",
    (2, 1): "Iron Gate", (2, 2): "", (2, 3): "", (2, 4): "Iron Gate", (2, 5): "",
    (5, 1): "Betefara", (5, 2): "Burning Harvest", (5, 3): "", (5, 4): "",
}


def test_distance():
    assert [distance(*x, 3) for x in (("ab", "ba"), ("topoidafa", "topikodafa"), ("", "ab"), ("kitten", "sitting"), ("a", "bcdef"))] == [1, 2, 2, 3, 4]


def test_p2_is_registered_and_every_entry_comes_out(spark):
    assert "p2_found" in __spark_entry__.queries()
    bank = spark.createDataFrame(BANK, "c0 string, c1 string")
    said = spark.createDataFrame(SAID, "ws_key bigint, propose string")
    got = {(r.ws_key, r.entry_no): r.c0 for r in match_terms(said, bank).collect()}
    assert got == FOUND


def test_empty_tables_nulls_and_clashing_columns(spark):
    bank = spark.createDataFrame([*BANK, (None, "x")], "c0 string, c1 string").selectExpr("*", "1 as ws_key", "2 as entry_no")
    said = spark.createDataFrame(SAID, "ws_key bigint, propose string").selectExpr("*", "'x' as c0", "3 as entry_no", "4 as entry")
    assert match_terms(said, bank).count() == len(FOUND)
    assert match_terms(said.limit(0), bank).count() == 0
    assert {r.c0 for r in match_terms(said, bank.limit(0)).collect()} == {""}


def test_mentions_and_long_entries():
    bank = Bank(BANK)
    assert [m[2] for m in bank.mentions(words("the iron gate and silent harvest"))] == ["Silent Harvest", "Iron Gate"]
    assert bank.find("the old Iron Gate (new)") == "Iron Gate" and bank.find("Betefara term") == "Betefara"
    assert bank.find("x" * 100_000) == "" and bank.find("Iron Gate " + "z " * 50_000) == "Iron Gate" and bank.find("?") == ""
