"""Boxes of regions and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import boxes as B
from glyphmill.operators import layout as L
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import PAGES, pages, regions
from glyphmill.session import table

query = Register()
PAGE = ["series_id", "chapter_no", "page_id"]

BOX = "b AS (SELECT *, bbox[1]::BIGINT AS x, bbox[2]::BIGINT AS y, bbox[3]::BIGINT AS w, bbox[4]::BIGINT AS h FROM text_region WHERE bbox IS NOT NULL)"
PAIRS = f"""{BOX}, pairs AS (SELECT a.region_key AS a, b.region_key AS b, a.w * a.h AS area_a, b.w * b.h AS area_b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS shared
  FROM b a JOIN b ON a.series_id = b.series_id AND a.chapter_no = b.chapter_no AND a.page_id = b.page_id AND a.region_key < b.region_key)"""


@query(f"""WITH {PAGES}, {BOX} SELECT region_key, greatest(w, 0) * greatest(h, 0) AS area, x + w AS right_side, y + h AS bottom, x + w / 2 AS center_x, y + h / 2 AS center_y,
  [least(greatest(x - 8, 0), p.width - 1), least(greatest(y - 8, 0), p.height - 1)] AS grown_corner FROM b JOIN pages p ON b.series_id = p.series_id AND b.chapter_no = p.chapter_no AND b.page_id = p.page_id""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "text_region").where("bbox is not null").join(pages(spark, sf_dir).select(*PAGE, "width", "height"), PAGE)
    box = F.col("bbox")
    _, _, right, bottom = B.corners(box)
    cx, cy = B.center(box)
    grown = B.expand(box, F.lit(8), F.col("width"), F.col("height"))
    return df.select("region_key", B.area(box).alias("area"), right.alias("right_side"), bottom.alias("bottom"), cx.alias("center_x"), cy.alias("center_y"), F.slice(grown, 1, 2).alias("grown_corner"))


@query(f"WITH {PAIRS} SELECT a, b, shared, round(shared / (area_a + area_b - shared), 9) AS iou FROM pairs WHERE shared > 0")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.overlaps(table(spark, sf_dir, "text_region"), PAGE, "region_key", "bbox").select("a", "b", "shared", F.round("iou", 9).alias("iou"))


@query(f"WITH {PAIRS} SELECT a, b FROM pairs WHERE area_b > 0 AND shared >= 0.9 * area_b")
def box_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = L.close_pairs(table(spark, sf_dir, "text_region"), PAGE, "region_key", "bbox", lambda a, b: B.contains(a, b, 0.9))
    return pairs.select("a", "b")


@query(f"""WITH {BOX}, s AS (SELECT * FROM b WHERE kind = 'sfx'), l AS (SELECT * FROM b WHERE kind <> 'sfx'), g AS (SELECT s.region_key AS key, l.region_key AS host,
  sqrt((greatest(s.x - (l.x + l.w), l.x - (s.x + s.w), 0) ** 2 + greatest(s.y - (l.y + l.h), l.y - (s.y + s.h), 0) ** 2)::DOUBLE) AS gap FROM s JOIN l USING (series_id, chapter_no, page_id))
SELECT key, arg_min(host, (gap, host)) AS host, round(min(gap), 6) AS gap FROM g WHERE gap <= 200 GROUP BY key""")
def nearest_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other lettering of each sound effect within 200 pixels."""
    df = table(spark, sf_dir, "text_region").select(*PAGE, F.col("region_key").alias("key"), F.col("bbox").alias("box"), "kind").where("box is not null")
    near = L.nearest(df.where("kind = 'sfx'").drop("kind"), df.where("kind <> 'sfx'").drop("kind"), PAGE, 200)
    return near.select("key", "host", F.round("gap", 6).alias("gap"))


@query(f"""WITH {BOX}, p AS (SELECT series_id, chapter_no, page_id, panel, min(x) AS px, min(y) AS py, max(x + w) - min(x) AS pw, max(y + h) - min(y) AS ph FROM b WHERE panel IS NOT NULL GROUP BY ALL),
c AS (SELECT b.region_key, p.panel, greatest(least(x + w, px + pw) - greatest(x, px), 0) * greatest(least(y + h, py + ph) - greatest(y, py), 0) AS shared, w * h AS area
  FROM b JOIN p USING (series_id, chapter_no, page_id)) SELECT b.region_key, c.panel FROM b LEFT JOIN (SELECT region_key, min(p) AS panel FROM (SELECT region_key, panel AS p, shared, area FROM c) WHERE area > 0 AND shared >= 0.6 * area GROUP BY region_key) c USING (region_key)""")
def panel_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first panel, by id, whose hull holds three fifths of a region; null without one."""
    df = table(spark, sf_dir, "text_region").where("bbox is not null")
    panels = df.where("panel is not null").groupBy(*PAGE, F.col("panel").alias("outer_id")).agg(L.hull("bbox").alias("outer_box")).withColumn("nr", F.col("outer_id"))
    held = L.first_container(df.select(*PAGE, "region_key", F.col("bbox").alias("box")), panels, PAGE, "region_key")
    return held.select("region_key", F.col("outer_id").alias("panel"))


@query(f"""WITH {BOX} SELECT series_id, chapter_no, page_id, [min(x), min(y), max(x + w) - min(x), max(y + h) - min(y)] AS hull, count(*) AS n FROM b GROUP BY ALL""")
def page_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "text_region").where("bbox is not null")
    return df.groupBy(*PAGE).agg(L.hull("bbox").alias("hull"), F.count("*").alias("n"))


@query(f"""WITH {BOX}, m AS (SELECT series_id, chapter_no, page_id, median(greatest(w, h)) AS mid FROM b GROUP BY ALL)
SELECT series_id, chapter_no, page_id, mid, round(avg((greatest(w, h) BETWEEN 0.55 * mid AND 1.8 * mid)::INT), 9) AS alike, round(4 * count(*) * count(*) * covar_pop(x + w / 2, y + h / 2)) AS together FROM b JOIN m USING (series_id, chapter_no, page_id) GROUP BY ALL""")
def lettering_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the median longer side, the share of regions near it, how centres vary together."""
    df = table(spark, sf_dir, "text_region").where("bbox is not null")
    _, _, w, h = B.sides(F.col("bbox"))
    cx, cy = B.center(F.col("bbox"))
    df = df.select(*PAGE, F.greatest(w, h).alias("side"), cx.alias("cx"), cy.alias("cy"))
    mid = df.groupBy(*PAGE).agg(F.percentile("side", 0.5).alias("mid"))
    near = F.col("side").between(0.55 * F.col("mid"), 1.8 * F.col("mid")).cast("int")
    return df.join(mid, PAGE).groupBy(*PAGE, "mid").agg(F.round(F.avg(near), 9).alias("alike"), F.round(4 * F.count("*") * F.count("*") * F.covar_pop("cx", "cy")).alias("together"))


@query(f"""WITH {BOX}, r AS (SELECT region_key, row_number() OVER (PARTITION BY series_id, chapter_no, page_id ORDER BY w * h DESC, region_key) AS nr FROM b) SELECT region_key, nr FROM r WHERE nr <= 3""")
def largest_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest regions of each page; a top-k report."""
    df = table(spark, sf_dir, "text_region").where("bbox is not null")
    w = Window.partitionBy(*PAGE).orderBy(F.desc(B.area(F.col("bbox"))), "region_key")
    return df.select("region_key", F.row_number().over(w).alias("nr")).where("nr <= 3")


@query("""SELECT region_key, CASE WHEN len(bbox) = 4 AND bbox[3] >= 4 AND bbox[4] >= 4 THEN bbox::BIGINT[] END AS box FROM text_region""")
def parsed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as text and read back."""
    return table(spark, sf_dir, "text_region").select("region_key", B.parse(F.array_join("bbox", " ")).alias("box"))


CLUSTER = f"""{BOX}, n AS (SELECT series_id, chapter_no, page_id, region_key, x, y, w, h FROM b WHERE kind = 'sfx'),
l AS (SELECT a.region_key AS a, c.region_key AS b FROM n a JOIN n c USING (series_id, chapter_no, page_id)
  WHERE sqrt((greatest(a.x - (c.x + c.w), c.x - (a.x + a.w), 0) ** 2 + greatest(a.y - (c.y + c.h), c.y - (a.y + a.h), 0) ** 2)::DOUBLE) <= 1.1 * greatest(a.w, a.h, c.w, c.h)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)"""


@query(f"WITH RECURSIVE {CLUSTER} SELECT a AS region_key, min(b) AS cluster FROM reach GROUP BY a")
def effect_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    effects = table(spark, sf_dir, "text_region").where("kind = 'sfx' and bbox is not null")
    return L.clusters(effects, PAGE, "region_key", "bbox", largest=None)


@query()
def suppressed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression of overlapping detections, the surest first."""
    df = table(spark, sf_dir, "text_region").withColumn("sure", F.coalesce("confidence", F.lit(0.0)))
    return L.suppressed(df, PAGE, "region_key", "bbox", "sure")


@query()
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions(spark, sf_dir).withColumn("leftward", F.coalesce(F.col("reading_direction") == "rtl", F.lit(True)))
    return L.reading_order(df, PAGE, "region_key", "bbox", "panel", "leftward")
