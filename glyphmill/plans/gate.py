"""Region predicates, page roll-ups and the findings of the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import persian, scripts, states
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import REGIONS, regions

query = Register()
PAGE = ["series_id", "chapter_no", "page_id"]

STATE_SQL = """CASE WHEN coalesce(dropped, false) THEN 'dropped_false_detection'
    WHEN coalesce(erase, false) THEN CASE WHEN is_repaired THEN 'erased' ELSE 'needs_review' END
    WHEN NOT is_translatable THEN 'kept_by_policy' WHEN has_target THEN 'translated'
    WHEN coalesce(len(review) > 0, false) THEN 'needs_review' ELSE 'unresolved' END"""


@query(f"""WITH {REGIONS} SELECT region_key, is_translatable AS translatable,
  (coalesce(erase, false) OR (NOT coalesce(dropped, false) AND NOT coalesce(keep, false)
    AND NOT (coalesce(kind = 'sfx', false) AND policy IN ('keep', 'bilingual', 'annotate')))) AS may_be_edited,
  {STATE_SQL} AS state FROM flagged""")
def region_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).select("region_key", states.translatable().alias("translatable"), states.may_be_edited().alias("may_be_edited"), states.region_state().alias("state"))


@query(f"""WITH {REGIONS}, s AS (SELECT {STATE_SQL} AS state FROM flagged)
SELECT d.state, count(s.state) AS n FROM (SELECT unnest({states.STATES!r}) AS state) d LEFT JOIN s ON d.state = s.state GROUP BY d.state""")
def state_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state comes out, also one without regions."""
    counted = regions(spark, sf_dir).groupBy(states.region_state().alias("state")).agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in states.STATES], "state string")
    return every.join(counted, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {REGIONS} SELECT series_id, chapter_no, page_id, ['image', 'clean', 'final'][1 + max(CASE
  WHEN coalesce(dropped, false) THEN 0 WHEN is_translatable AND has_target THEN 2 WHEN is_repaired THEN 1 ELSE 0 END)] AS artifact
FROM flagged GROUP BY ALL""")
def page_required_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).groupBy(*PAGE).agg(states.required_artifact().alias("artifact"))


@query("""WITH o AS (SELECT series_id, chapter_no, page_id, reading_order AS o FROM text_region WHERE NOT coalesce(dropped, false))
SELECT series_id, chapter_no, page_id, min(o) AS least, count(o) - count(DISTINCT o) AS repeated FROM o GROUP BY ALL HAVING min(o) < 1 OR count(o) <> count(DISTINCT o)""")
def reading_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = regions(spark, sf_dir).where("not coalesce(dropped, false)")
    checked = live.groupBy(*PAGE).agg(F.min("reading_order").alias("least"), (F.count("reading_order") - F.countDistinct("reading_order")).alias("repeated"))
    return checked.where("least < 1 or repeated > 0")


@query("""SELECT target_text, count(*) AS n, count(DISTINCT source_text) AS sources FROM text_region
WHERE trim(coalesce(target_text, '')) <> '' AND NOT coalesce(dropped, false) GROUP BY target_text HAVING count(*) > 1 AND count(DISTINCT source_text) > 1""")
def duplicate_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted per text and source first, so that a text of a third of all rows meets as few partial rows."""
    live = regions(spark, sf_dir).where(states.has_text("target_text") & ~F.coalesce("dropped", F.lit(False)))
    per = live.groupBy("target_text", "source_text").agg(F.count("*").alias("n"))
    return per.groupBy("target_text").agg(F.sum("n").alias("n"), F.count("source_text").alias("sources")).where("n > 1 and sources > 1")


# --- findings: one row a region and code ----------------------------------------------------

#: Code, severity, condition of the region as SQL over `flagged`.
FINDINGS = {
    "untranslated-region": ("error", "is_translatable AND NOT has_target"),
    "source-script-left": ("error", "is_translatable AND has_target AND regexp_matches(target_text, '[぀-ゟ゠-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ㄰-㆏]')"),
    "clean-refused": ("error", "NOT coalesce(dropped, false) AND coalesce(clean_status = 'refused', false)"),
    "erase-unfinished": ("error", "coalesce(erase, false) AND NOT coalesce(dropped, false) AND coalesce(clean_status, '') <> 'clean'"),
    "compressed-variant": ("warning", "is_translatable AND has_target AND trim(coalesce(target_full, '')) <> '' AND trim(target_full) <> trim(target_text)"),
    "low-confidence-region": ("warning", "NOT coalesce(dropped, false) AND coalesce(confidence < 0.5, false) AND NOT coalesce(locked, false)"),
    "sfx-untranslated": ("warning", "NOT coalesce(dropped, false) AND NOT coalesce(keep, false) AND NOT coalesce(erase, false) AND coalesce(kind = 'sfx', false) AND NOT is_translatable"),
}


def rules() -> dict[str, Column]:
    """The condition of each code."""
    live = ~F.coalesce("dropped", F.lit(False))
    owed, target = states.translatable(), states.has_text("target_text")
    counted = scripts.counts(F.col("target_text"))
    return {
        "untranslated-region": owed & ~target,
        "source-script-left": owed & target & (scripts.source_left(counted) > 0),
        "clean-refused": live & F.coalesce(F.col("clean_status") == "refused", F.lit(False)),
        "erase-unfinished": F.coalesce("erase", F.lit(False)) & live & (F.coalesce("clean_status", F.lit("")) != "clean"),
        "compressed-variant": owed & target & states.has_text("target_full") & (states.stripped("target_full") != states.stripped("target_text")),
        "low-confidence-region": live & F.coalesce(F.col("confidence") < 0.5, F.lit(False)) & ~F.coalesce("locked", F.lit(False)),
        "sfx-untranslated": live & ~F.coalesce("keep", F.lit(False)) & ~F.coalesce("erase", F.lit(False)) & F.coalesce(F.col("kind") == "sfx", F.lit(False)) & ~owed,
    }


def _union_sql() -> str:
    return " UNION ALL ".join(f"SELECT region_key, '{c}' AS code, '{s}' AS severity FROM flagged WHERE {w}" for c, (s, w) in FINDINGS.items())


def all_findings(df: DataFrame) -> DataFrame:
    """Every finding of every region; the table is read once for all codes."""
    found = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(c).alias("code"), F.lit(FINDINGS[c][0]).alias("severity"))) for c, rule in rules().items())))
    return df.select("region_key", F.explode(found).alias("f")).select("region_key", "f.code", "f.severity")


@query(f"WITH {REGIONS} {_union_sql()}")
def gate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_findings(regions(spark, sf_dir))


@query(f"WITH {REGIONS}, f AS ({_union_sql()}) SELECT code, severity, count(*) AS n FROM f GROUP BY ALL")
def findings_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_findings(regions(spark, sf_dir)).groupBy("code", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS}, f AS ({_union_sql()}), n AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f)
SELECT errors, warnings, errors = 0 AS ok, errors = 0 AND warnings = 0 AS ok_strict, greatest(errors + warnings - 60, 0) AS hidden FROM n""")
def gate_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals count every finding; a listing shows 60 of them."""
    f = all_findings(regions(spark, sf_dir)).groupBy().agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return f.selectExpr("errors", "warnings", "errors = 0 as ok", "errors = 0 and warnings = 0 as ok_strict", "greatest(errors + warnings - 60, 0) as hidden")


@query(f"""WITH {REGIONS}, f AS ({_union_sql()}) SELECT code, severity, region_key FROM f ORDER BY severity, code, region_key LIMIT 60""")
def findings_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors before warnings; the limit is the report's."""
    return all_findings(regions(spark, sf_dir)).orderBy("severity", "code", "region_key").limit(60).select("code", "severity", "region_key")


def _one(code: str) -> None:
    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return regions(spark, sf_dir).where(rules()[code]).select("region_key")

    one.__name__ = "gate_" + code.replace("-", "_")
    query(f"WITH {REGIONS} SELECT region_key FROM flagged WHERE {FINDINGS[code][1]}")(one)


for _code in FINDINGS:
    _one(_code)


# --- scripts ------------------------------------------------------------------------------

RE2 = {
    "arabic": "[^؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]", "latin": "[^A-Za-zÀ-ɏ]", "hiragana": "[^぀-ゟ]", "katakana": "[^゠-ヿㇰ-ㇿ]",
    "han": "[^㐀-䶿一-鿿豈-﫿]", "hangul": "[^가-힯ᄀ-ᇿ㄰-㆏]", "cyrillic": "[^Ѐ-ӿ]",
}
COUNTS_SQL = ", ".join(f"length(regexp_replace(coalesce({{0}}, ''), '{p}', '', 'g')) AS {n}" for n, p in RE2.items())
DOMINANT_SQL = "CASE WHEN greatest({0}) = 0 THEN 'none' {1} END".format(", ".join(RE2), " ".join(f"WHEN {n} = greatest({', '.join(RE2)}) THEN '{n}'" for n in RE2))
TOTAL_SQL = " + ".join(RE2)
LOOKS_SQL = f"""CASE WHEN {TOTAL_SQL} = 0 THEN false WHEN {{0}} IN ('fa', 'ar', 'fas', 'per') THEN arabic / ({TOTAL_SQL}) > 0.5
  WHEN {{0}} IN ('ja', 'jpn') THEN (hiragana + katakana + han) / ({TOTAL_SQL}) > 0.5 WHEN {{0}} IN ('ko', 'kor') THEN hangul / ({TOTAL_SQL}) > 0.4
  WHEN {{0}} IN ('zh', 'zho', 'cmn') THEN han / ({TOTAL_SQL}) > 0.5 WHEN {{0}} IN ('en', 'eng') THEN latin / ({TOTAL_SQL}) > 0.5 ELSE true END"""


@query(f"SELECT doc_id, {COUNTS_SQL.format('text')} FROM documents")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select("doc_id", *(c.alias(n) for n, c in scripts.counts(F.col("text")).items()))


@query(f"WITH c AS (SELECT {COUNTS_SQL.format('text')} FROM documents) SELECT {DOMINANT_SQL} AS script, count(*) AS n, sum({TOTAL_SQL})::BIGINT AS letters FROM c GROUP BY 1")
def dominant_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(c.alias(n) for n, c in scripts.counts(F.col("text")).items()))
    names = {n: F.col(n) for n in scripts.RANGES}
    return counted.groupBy(scripts.dominant(names).alias("script")).agg(F.count("*").alias("n"), F.sum(sum(names.values(), F.lit(0))).alias("letters"))


@query(f"""WITH {REGIONS}, c AS (SELECT region_key, target_text, source_language, {COUNTS_SQL.format('target_text')} FROM flagged)
SELECT region_key, {LOOKS_SQL.format("'fa'")} AS like_target, {LOOKS_SQL.format("coalesce(source_language, '')")} AS like_source,
  regexp_matches(coalesce(target_text, ''), '[گچپژکی]') AND {LOOKS_SQL.format("'fa'")} AS persian FROM c""")
def language_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions(spark, sf_dir).select("region_key", "target_text", "source_language", *(c.alias(n) for n, c in scripts.counts(F.col("target_text")).items()))
    names = {n: F.col(n) for n in scripts.RANGES}
    return df.select(
        "region_key",
        scripts.looks_like(names, F.lit("fa")).alias("like_target"),
        scripts.looks_like(names, F.coalesce("source_language", F.lit(""))).alias("like_source"),
        scripts.is_persian(F.col("target_text"), names).alias("persian"),
    )


@query(f"""WITH {REGIONS}, c AS (SELECT region_key, {COUNTS_SQL.format('target_text')} FROM flagged WHERE is_translatable AND has_target AND target_language = 'fa')
SELECT region_key FROM c WHERE {TOTAL_SQL} > 0 AND NOT ({LOOKS_SQL.format("'fa'")})""")
def gate_not_persian(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions(spark, sf_dir).where(states.translatable() & states.has_text("target_text") & (F.col("target_language") == "fa"))
    df = df.select("region_key", *(c.alias(n) for n, c in scripts.counts(F.col("target_text")).items()))
    names = {n: F.col(n) for n in scripts.RANGES}
    return df.where((sum(names.values(), F.lit(0)) > 0) & ~scripts.looks_like(names, F.lit("fa"))).select("region_key")


# --- Persian text: no SQL form, proven by tests ----------------------------------------------


@query()
def fixed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal form of each target text that is owed."""
    df = regions(spark, sf_dir).where(states.translatable() & states.has_text("target_text"))
    return df.select("region_key", persian.fixed("target_text").alias("fixed"), F.col("target_text").alias("before")).withColumn("changed", F.col("fixed") != F.col("before")).drop("before")


@query()
def lint_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions(spark, sf_dir).where(states.translatable() & states.has_text("target_text"))
    return df.select(F.explode(persian.lint_codes("target_text")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query()
def typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lint findings of each region without the two codes that have findings of their own; a code
    that the region's review holds is settled."""
    df = regions(spark, sf_dir).where(states.translatable() & states.has_text("target_text"))
    codes = df.select("region_key", F.coalesce("review", F.array().cast("array<string>")).alias("review"), F.explode(persian.lint_codes("target_text")).alias("code"))
    return codes.where("code not in ('untranslated', 'source-script-left') and not array_contains(review, code)").select("region_key", "code")


@query()
def doubtful_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions(spark, sf_dir).where(states.has_text("target_text"))
    return df.select("region_key", F.posexplode(persian.doubts("target_text")).alias("place", "span"))
