import re

from pyspark.sql import functions as F

from glyphmill.functions import policy as P


def test_inflected_phrases():
    assert re.search(P.inflected("open door"), "the Open  doors!") and not re.search(P.inflected("open door"), "reopen door")
    assert re.search(P.inflected("UN"), "a UN car") and not re.search(P.inflected("UN"), "un car") and not re.search(P.inflected("go"), "goes")


def test_policies_and_settlements(spark):
    df = spark.createDataFrame([({"display": "x", "note": " ", "other": "y"}, "Translate all sounds", "keep", ["a"], ["s"])], "m map<string,string>, t string, p string, ack array<string>, spans array<string>")
    row = df.select(
        P.title_policy(F.col("m")).alias("m"),
        P.sfx_conflict(F.col("t"), F.col("p")).alias("c"),
        P.sfx_conflict(F.lit("keep or translate"), F.col("p")).alias("none"),
        P.settled("a", F.col("ack"), F.lit(True), F.col("spans"), F.lit("s")).alias("yes"),
        P.settled("a", F.col("ack"), F.lit(True), F.col("spans"), F.lit("t")).alias("no"),
        P.settled("b", F.col("ack"), F.lit(True), F.lit(None).cast("array<string>"), F.lit("t")).alias("other"),
    ).first()
    assert row.m == {"display": "x"} and row.c == "translate" and row.none is None and (row.yes, row.no, row.other) == (True, False, False)
