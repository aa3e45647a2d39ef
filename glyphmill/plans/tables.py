"""The driver's tables as the core operators read them, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import table


REGIONS = """
regions AS (
  SELECT t.*, coalesce(c.sfx_policy, 'keep') AS policy, lower(c.source_language) AS source_language, c.target_language, c.reading_direction
  FROM text_region t LEFT JOIN (SELECT series_id AS s_, chapter_no AS c_, sfx_policy, source_language, target_language, reading_direction FROM chapter) c
    ON t.series_id = c.s_ AND t.chapter_no = c.c_
),
flagged AS (
  SELECT *, (coalesce(dropped, false) = false AND coalesce(keep, false) = false AND coalesce(erase, false) = false
    AND (coalesce(kind <> 'sfx', true) OR policy IN ('translate', 'bilingual', 'annotate'))) AS is_translatable,
    trim(coalesce(target_text, '')) <> '' AS has_target, trim(coalesce(source_text, '')) <> '' AS has_source,
    coalesce(fill, 'none') NOT IN ('none', 'keep') AS is_repaired
  FROM regions
)
"""
#: The pages, of which about one in a hundred is there twice.
PAGES = "pages AS (SELECT DISTINCT * FROM page)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions with the policy, languages and direction of their chapter."""
    chapter = table(spark, sf_dir, "chapter").select(
        "series_id", "chapter_no", F.coalesce("sfx_policy", F.lit("keep")).alias("policy_"), F.lower("source_language").alias("source_language"), "target_language", "reading_direction"
    )
    joined = table(spark, sf_dir, "text_region").join(chapter, ["series_id", "chapter_no"], "left")
    return joined.withColumn("policy", F.coalesce("policy_", F.lit("keep"))).drop("policy_")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page").distinct()
