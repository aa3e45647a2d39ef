"""Ordered frames that end by budget: look-back, look-ahead, running guards, runs.

Rows of a unit (a chapter, a folder) are numbered once; every frame is then a range of numbers, so
a frame joins by number instead of by comparing all rows with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def look_back(rows: DataFrame, pages: DataFrame, unit: list[str], page: str, order: list[str], cost: Column, budget: int = 3000, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """For every page, the rows before it, nearest first, until one does not fit.

    Gives the kept rows with ``for_page`` and ``back`` (1 is nearest), and per page whether rows were
    left out. A frame holds at most ``most`` rows, so a page joins that many numbers.
    """
    w = Window.partitionBy(*unit).orderBy(page, *order)
    numbered = rows.withColumns({"nr": F.row_number().over(w), "paid": F.sum(cost).over(w)})
    last = numbered.groupBy(*unit, page).agg(F.max("nr").alias("nr"), F.max("paid").alias("paid"))
    before = Window.partitionBy(*unit).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    asked = pages.select(*unit, page).distinct().join(last, [*unit, page], "left")
    asked = asked.select(*unit, F.col(page).alias("for_page"), F.coalesce(F.max("nr").over(before), F.lit(0)).alias("reach"), F.coalesce(F.max("paid").over(before), F.lit(0)).alias("spent"))
    spots = asked.where("reach > 0").withColumn("nr", F.explode(F.sequence(F.col("reach"), F.greatest(F.col("reach") - (most - 1), F.lit(1)))))
    kept = numbered.join(spots, [*unit, "nr"]).where(F.col("spent") - F.col("paid") + cost <= budget).withColumn("back", F.col("reach") - F.col("nr") + 1)
    counted = kept.groupBy(*unit, "for_page").agg(F.count("*").alias("kept"))
    flags = asked.join(counted, [*unit, "for_page"], "left").select(*unit, "for_page", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("kept", F.lit(0)) < F.col("reach")).alias("truncated"))
    return kept.drop("nr", "paid", "reach", "spent"), flags


def look_ahead(rows: DataFrame, pages: DataFrame, unit: list[str], page: str, order: list[str], most: int = 8) -> DataFrame:
    """For every page, the first rows of the next one."""
    following = pages.select(*unit, page).distinct().withColumn("next", F.lead(page).over(Window.partitionBy(*unit).orderBy(page))).where("next is not null")
    first = rows.withColumn("ahead", F.row_number().over(Window.partitionBy(*unit, page).orderBy(*order))).where(F.col("ahead") <= most)
    return first.withColumnRenamed(page, "next").join(following.withColumnRenamed(page, "for_page"), [*unit, "next"])


def first_violation(rows: DataFrame, unit: list[str], order: list[str], size: Column, each: int, total: int, many: int) -> DataFrame:
    """Per unit, the first row at which a size, the running total or the number goes over its limit."""
    w = Window.partitionBy(*unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumns({"at": F.count("*").over(w), "running": F.sum(size).over(w)})
    why = F.when(F.col("at") > many, "too many").when(size > each, "too large").when(F.col("running") > total, "total too large")
    return running.withColumn("why", why).where("why is not null").groupBy(*unit).agg(F.min("at").alias("at"), F.min_by("why", "at").alias("why"))


def runs(rows: DataFrame, unit: list[str], place: str, value: Column, least: int) -> DataFrame:
    """Runs of neighbouring places at which ``value`` holds, at least ``least`` long."""
    island = F.col(place) - F.row_number().over(Window.partitionBy(*unit).orderBy(place))
    held = rows.where(value).withColumn("island", island)
    return held.groupBy(*unit, "island").agg(F.min(place).alias("start"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def latest(rows: DataFrame, keys: list[str], order: list[Column], many: int = 1) -> DataFrame:
    """The first ``many`` rows of each key in the given order; the order must leave no ties."""
    return rows.withColumn("_nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_nr") <= many).drop("_nr")
