"""Answers to held-out cases: what they must preserve, and whether the cases themselves hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.states import stripped

#: Marks that end a clause.
ENDERS = r"[.!?؟。！？…]+"


def units(text: Column) -> Column:
    """Clauses of a text, at least one."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ENDERS), lambda p: p.rlike(r"(?U)\S"))
    return F.greatest(F.lit(1), F.size(parts))


def preserved(answer: Column, must: Column) -> Column:
    """Whether the answer keeps what a case asks for; null where the case asks nothing of a kind.

    Terms must stand in the answer, an ellipsis must or must not, and a negation is only flagged
    for a reader, since none can be told by its letters.
    """
    text = F.coalesce(answer, F.lit(""))
    terms = F.when(F.size(must["terms"]) > 0, F.forall(must["terms"], lambda t: F.contains(text, t)))
    ellipsis = F.when(must["ellipsis"].isNotNull(), must["ellipsis"] == text.rlike("…|\\.\\.\\."))
    return F.struct(terms.alias("terms"), ellipsis.alias("ellipsis"), F.when(must["negation"], F.lit("review")).alias("negation"))


def score(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per case. ``answers`` holds id and answer; an answer to no case raises when read.

    An answer is exact if it is one of the accepted ones, white space aside.
    """
    joined = cases.withColumn("_known", F.lit(True)).join(answers, "id", "full_outer")
    joined = joined.withColumn("id", F.when(F.col("_known"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("no such case: "), F.coalesce("id", F.lit("null"))))))
    given = F.coalesce(stripped("answer") != "", F.lit(False))
    exact = given & F.coalesce(F.exists("accept", lambda a: stripped(a) == stripped(F.col("answer"))), F.lit(False))
    kept = preserved(F.col("answer"), F.col("must_preserve"))
    whole = F.coalesce(F.col("units").isNull() | (units(F.col("answer")) >= F.col("units")), F.lit(True))
    verdict = F.when(~given, "missing").when(exact, "exact").when(F.coalesce("human_only", F.lit(False)), "human").otherwise("other")
    return joined.select("id", verdict.alias("verdict"), kept.alias("kept"), whole.alias("whole"))


def faults(cases: DataFrame) -> DataFrame:
    """``id`` and ``fault`` of every case that breaks a rule of the format."""
    repeated = cases.groupBy(F.lower("id").alias("_id")).agg(F.count("*").alias("_n"))
    rules = {
        "id missing": F.coalesce(stripped("id") == "", F.lit(True)),
        "id repeated": F.coalesce(F.col("_n") > 1, F.lit(False)),
        "no source": F.coalesce(stripped("source") == "", F.lit(True)),
        "no accepted answer": F.coalesce(F.size("accept") < 1, F.lit(True)),
        "units below one": F.coalesce(F.col("units") < 1, F.lit(False)),
        "balloon out of range": F.coalesce((F.size("balloon") != 2) | F.exists("balloon", lambda v: (v <= 0) | (v > 1)), F.lit(False)),
        "source among the answers": F.coalesce(F.array_contains("accept", F.col("source")), F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return cases.join(repeated, F.lower(cases["id"]) == repeated["_id"], "left").select("id", F.explode(found).alias("fault"))
