"""Held-out cases: validity, units, scores of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import evaluation as E
from glyphmill.plans.registry import Register
from glyphmill.session import table

query = Register()

#: Answers made for the sample: the first accepted one, cut, or none, by the case's number.
ANSWER = "CASE case_no % 3 WHEN 0 THEN accept[1] WHEN 1 THEN left(accept[1], 20) END"
UNITS = "greatest(1, len([p FOR p IN regexp_split_to_array(coalesce({0}, ''), '[.!?؟。！？…]+') IF trim(p) <> '']))"


def answers(cases: DataFrame) -> DataFrame:
    first = F.get("accept", F.lit(0))
    made = F.when(F.col("case_no") % 3 == 0, first).when(F.col("case_no") % 3 == 1, F.left(first, F.lit(20)))
    return cases.select("id", made.alias("answer")).where("answer is not null")


@query(f"SELECT id, {UNITS.format('source')}::BIGINT AS of_source, {UNITS.format('gloss')}::BIGINT AS of_gloss, units FROM cases")
def case_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").select("id", E.units(F.col("source")).alias("of_source"), E.units(F.col("gloss")).alias("of_gloss"), "units")


@query(f"""WITH a AS (SELECT *, {ANSWER} AS answer FROM cases)
SELECT id, CASE WHEN coalesce(trim(answer), '') = '' THEN 'missing' WHEN len([x FOR x IN accept IF trim(x) = trim(answer)]) > 0 THEN 'exact' WHEN coalesce(human_only, false) THEN 'human' ELSE 'other' END AS verdict,
  coalesce(units IS NULL OR {UNITS.format('answer')} >= units, true) AS whole,
  CASE WHEN len(must_preserve.terms) > 0 THEN len([t FOR t IN must_preserve.terms IF NOT contains(coalesce(answer, ''), t)]) = 0 END AS terms,
  CASE WHEN must_preserve.ellipsis IS NOT NULL THEN must_preserve.ellipsis = regexp_matches(coalesce(answer, ''), '…|\\.\\.\\.') END AS ellipsis,
  CASE WHEN must_preserve.negation THEN 'review' END AS negation FROM a""")
def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "cases")
    return E.score(cases, answers(cases)).select("id", "verdict", "whole", "kept.terms", "kept.ellipsis", "kept.negation")


@query(f"""WITH a AS (SELECT *, {ANSWER} AS answer FROM cases), v AS (SELECT CASE WHEN coalesce(trim(answer), '') = '' THEN 'missing' WHEN len([x FOR x IN accept IF trim(x) = trim(answer)]) > 0 THEN 'exact'
  WHEN coalesce(human_only, false) THEN 'human' ELSE 'other' END AS verdict FROM a) SELECT verdict, count(*) AS n FROM v GROUP BY verdict""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "cases")
    return E.score(cases, answers(cases)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT lower(id) AS k, count(*) AS n FROM cases GROUP BY 1), f AS (SELECT id, unnest([x FOR x IN [CASE WHEN coalesce(trim(id), '') = '' THEN 'id missing' END, CASE WHEN n.n > 1 THEN 'id repeated' END,
  CASE WHEN coalesce(trim(source), '') = '' THEN 'no source' END, CASE WHEN coalesce(len(accept) < 1, true) THEN 'no accepted answer' END, CASE WHEN units < 1 THEN 'units below one' END,
  CASE WHEN coalesce(len(balloon) <> 2 OR len([v FOR v IN balloon IF v <= 0 OR v > 1]) > 0, false) THEN 'balloon out of range' END, CASE WHEN coalesce(list_contains(accept, source), false) THEN 'source among the answers' END] IF x IS NOT NULL]) AS fault
  FROM cases LEFT JOIN n ON lower(id) = n.k) SELECT id, fault FROM f""")
def case_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.faults(table(spark, sf_dir, "cases"))


@query("SELECT x AS difficulty, language, count(*) AS n FROM (SELECT language, unnest(difficulty) AS x FROM cases) GROUP BY ALL")
def case_difficulties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").select("language", F.explode("difficulty").alias("difficulty")).groupBy("difficulty", "language").agg(F.count("*").alias("n"))
