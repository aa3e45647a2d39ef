"""Fingerprints of pages, what goes stale with them, and what a stage rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.digests import ordered, region_line, text_digest

# Whose output each stage consumes, in the order in which stages run.
NEEDS = {
    "detect": [], "watermark": [], "crops": ["detect"], "ocr": ["detect", "crops"], "glossary": [], "worksheet": ["detect"], "translate": ["detect"],
    "lint": [], "masks": ["detect"], "clean": ["masks"], "typeset": ["clean"], "export": ["typeset"],
}


def page_fingerprints(pages: DataFrame, regions: DataFrame, unit: list[str]) -> DataFrame:
    """``fingerprint`` of every page: its id, its bytes' hash and its regions in order."""
    lines = regions.groupBy(*unit, "page_id").agg(ordered(region_line(), "region_key").alias("lines"))
    joined = pages.select(*unit, "page_id", "sha256").join(lines, [*unit, "page_id"], "left")
    return joined.select(*unit, "page_id", text_digest(F.concat(F.concat_ws("|", "page_id", "sha256"), F.coalesce("lines", F.lit("")))).alias("fingerprint"))


def unit_fingerprints(fingerprints: DataFrame, unit: list[str]) -> DataFrame:
    return fingerprints.groupBy(*unit).agg(text_digest(ordered(F.col("fingerprint"), "page_id")).alias("fingerprint"))


def stale(now: DataFrame, recorded: DataFrame, keys: list[str], value: str = "fingerprint") -> DataFrame:
    """Keys whose recorded value is missing or another one."""
    was = recorded.select(*keys, F.col(value).alias("was"))
    return now.join(was, keys, "left").where(~F.col(value).eqNullSafe(F.col("was"))).select(*keys, F.col("was").isNull().alias("never_recorded"))


def stage_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, n) for s, needs in NEEDS.items() for n in needs], "stage string, needs string")


def prerequisites(spark: SparkSession) -> DataFrame:
    """The transitive closure of a fixed, small graph: ``stage`` and every stage it rests on."""
    stage_edges(spark).createOrReplaceTempView("glyphmill_stage_edges")
    return spark.sql("""WITH RECURSIVE up(stage, needs, depth) AS (SELECT stage, needs, 1 FROM glyphmill_stage_edges
        UNION ALL SELECT u.stage, e.needs, u.depth + 1 FROM up u JOIN glyphmill_stage_edges e ON u.needs = e.stage)
        SELECT stage, needs, min(depth) AS depth FROM up GROUP BY stage, needs""")


def revision(stage: Column, facets: list[Column], upstream: Column) -> Column:
    """A stage's revision of one page; an unrecorded upstream counts as `unknown`."""
    return text_digest(F.concat_ws("|", F.lit("3"), stage, *(F.coalesce(f.cast("string"), F.lit("")) for f in facets), F.coalesce(upstream, F.lit("unknown"))))
