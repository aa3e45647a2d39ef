"""Pages: fingerprints, freshness, manifests, sizes, order of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import protocol
from glyphmill.functions.digests import identity
from glyphmill.operators.freshness import NEEDS, page_fingerprints, prerequisites, revision, stale, unit_fingerprints
from glyphmill.operators.windows import latest
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import PAGES, pages
from glyphmill.session import table

query = Register()
UNIT = ["series_id", "chapter_no"]
PAGE = [*UNIT, "page_id"]

LINE = "concat_ws('|', id, array_to_string(bbox, ','), kind, orientation)"


def fingerprint_sql(source: str) -> str:
    return f"""SELECT p.series_id, p.chapter_no, p.page_id, sha256(p.page_id || '|' || p.sha256 || coalesce(l.lines, '')) AS fingerprint FROM pages p LEFT JOIN
  (SELECT series_id, chapter_no, page_id, string_agg({LINE}, '' ORDER BY region_key) AS lines FROM {source} GROUP BY ALL) l USING (series_id, chapter_no, page_id)"""


NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, chapter_no, id ORDER BY detected_at DESC, region_key DESC) AS nr FROM text_region) WHERE nr = 1)"
FIRST = "earliest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, chapter_no, id ORDER BY detected_at, region_key) AS nr FROM text_region) WHERE nr = 1)"


def _prints(spark: SparkSession, sf_dir: str, newest: bool) -> DataFrame:
    order = [F.desc("detected_at"), F.desc("region_key")] if newest else ["detected_at", "region_key"]
    return page_fingerprints(pages(spark, sf_dir), latest(table(spark, sf_dir, "text_region"), [*UNIT, "id"], order), UNIT)


@query(f"WITH {PAGES}, {NEWEST} {fingerprint_sql('newest')}")
def page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir, True)


@query(f"""WITH {PAGES}, {NEWEST}, f AS ({fingerprint_sql('newest')})
SELECT series_id, chapter_no, sha256(string_agg(fingerprint, '' ORDER BY page_id)) AS fingerprint FROM f GROUP BY ALL""")
def chapter_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_fingerprints(_prints(spark, sf_dir, True), UNIT)


RECORDED = """recorded AS (SELECT DISTINCT series_id, chapter_no, page_id FROM worksheet)"""


@query(f"""WITH {PAGES}, {NEWEST}, {FIRST}, {RECORDED}, now AS ({fingerprint_sql('newest')}), was AS (SELECT f.* FROM ({fingerprint_sql('earliest')}) f SEMI JOIN recorded r USING (series_id, chapter_no, page_id))
SELECT now.series_id, now.chapter_no, now.page_id, was.fingerprint IS NULL AS never_recorded FROM now LEFT JOIN was USING (series_id, chapter_no, page_id) WHERE now.fingerprint IS DISTINCT FROM was.fingerprint""")
def stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose regions were detected anew since a reader saw them, and pages never seen."""
    seen = table(spark, sf_dir, "worksheet").select(*PAGE).distinct()
    return stale(_prints(spark, sf_dir, True), _prints(spark, sf_dir, False).join(seen, PAGE, "left_semi"), PAGE)


EDGES = ", ".join(f"('{s}', '{n}')" for s, needs in NEEDS.items() for n in needs)


@query(f"""WITH RECURSIVE e(stage, needs) AS (VALUES {EDGES}), up AS (SELECT stage, needs, 1 AS depth FROM e
UNION ALL SELECT u.stage, e.needs, u.depth + 1 FROM up u JOIN e ON u.needs = e.stage) SELECT stage, needs, min(depth) AS depth FROM up GROUP BY stage, needs""")
def stage_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prerequisites(spark)


@query(f"""WITH {PAGES}, {NEWEST}, f AS ({fingerprint_sql('newest')}), d AS (SELECT *, sha256('3|detect|' || fingerprint || '|unknown') AS detect FROM f)
SELECT series_id, chapter_no, page_id, detect, sha256('3|masks|' || fingerprint || '|' || detect) AS masks FROM d""")
def page_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of two stages, the second resting on the first."""
    df = _prints(spark, sf_dir, True)
    df = df.withColumn("detect", revision(F.lit("detect"), [F.col("fingerprint")], F.lit(None).cast("string")))
    return df.withColumn("masks", revision(F.lit("masks"), [F.col("fingerprint")], F.col("detect"))).drop("fingerprint")


@query(f"""WITH {PAGES}, n AS (SELECT series_id, chapter_no, page_id, row_number() OVER (PARTITION BY series_id, chapter_no ORDER BY page_id) - 1 AS ordinal FROM pages)
SELECT p.series_id, p.chapter_no, p.page_id, CASE WHEN p.image <> p.page_id || '.png' THEN 'wrong name' WHEN n.ordinal <> p.page_index THEN 'out of order' WHEN c.k > 1 THEN 'same bytes' ELSE 'ok' END AS verdict
FROM pages p JOIN n USING (series_id, chapter_no, page_id) JOIN (SELECT sha256, count(*) AS k FROM pages GROUP BY sha256) c ON p.sha256 = c.sha256""")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pages(spark, sf_dir)
    same = df.groupBy("sha256").agg(F.count("*").alias("k"))
    ordinal = F.row_number().over(Window.partitionBy(*UNIT).orderBy("page_id")) - 1
    verdict = F.when(F.col("image") != F.concat("page_id", F.lit(".png")), "wrong name").when(F.col("ordinal") != F.col("page_index"), "out of order").when(F.col("k") > 1, "same bytes").otherwise("ok")
    return df.withColumn("ordinal", ordinal).join(same, "sha256").select(*PAGE, verdict.alias("verdict"))


@query("SELECT series_id, chapter_no, page_id, count(*) AS n FROM page GROUP BY ALL HAVING count(*) > 1")
def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page").groupBy(*PAGE).agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {PAGES}, k AS (SELECT series_id, chapter_no, count(*) AS found FROM pages GROUP BY ALL)
SELECT c.series_id, c.chapter_no, c.page_count AS planned, coalesce(k.found, 0) AS found FROM chapter c LEFT JOIN k USING (series_id, chapter_no) WHERE c.page_count IS DISTINCT FROM coalesce(k.found, 0)""")
def page_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).groupBy(*UNIT).agg(F.count("*").alias("found"))
    joined = table(spark, sf_dir, "chapter").join(found, UNIT, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.where(~F.col("page_count").eqNullSafe(F.col("found"))).select(*UNIT, F.col("page_count").alias("planned"), "found")


@query(f"""WITH {PAGES}, m AS (SELECT series_id, chapter_no, list_sort(list(width))[count(*) // 2 + 1] AS width, list_sort(list(height))[count(*) // 2 + 1] AS height,
  count(*) FILTER (height >= 3 * width) AS tall FROM pages GROUP BY ALL) SELECT * FROM m""")
def median_page_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians: of an even number of pages, the larger of the two in the middle."""
    mid = lambda c: F.element_at(F.sort_array(F.collect_list(c)), (F.count("*") / 2).cast("int") + 1)
    return pages(spark, sf_dir).groupBy(*UNIT).agg(mid("width").alias("width"), mid("height").alias("height"), F.count_if(F.col("height") >= 3 * F.col("width")).alias("tall"))


@query(f"""WITH {PAGES}, d AS (SELECT DISTINCT image FROM pages) SELECT image, row_number() OVER (ORDER BY
  lpad(regexp_extract(image, '([0-9]+)', 1), 20, '0'), image) AS place FROM d""")
def natural_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct image names in natural order; their number is that of the longest chapter's pages."""
    names = pages(spark, sf_dir).select("image").distinct()
    return names.withColumn("place", F.row_number().over(Window.orderBy(protocol.natural_key(F.col("image")), "image")))


@query(f"""WITH {PAGES} SELECT series_id, chapter_no, page_id, printf('p%04d', page_index + 1) AS by_index, printf('p%04d', page_index + 1) = page_id AS agrees FROM pages""")
def page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select(*PAGE, protocol.page_id(F.col("page_index")).alias("by_index"), (protocol.page_id(F.col("page_index")) == F.col("page_id")).alias("agrees"))


@query("""WITH n AS (SELECT series_id, chapter_no, page_id, max(try_cast(nullif(regexp_extract(id, 'r([0-9]+)$', 1), '') AS INT)) AS top FROM text_region GROUP BY ALL)
SELECT series_id, chapter_no, page_id, page_id || 'r' || printf('%03d', coalesce(top, 0) + 1) AS next_id FROM n""")
def next_region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "text_region").groupBy(*PAGE).agg(F.max(F.nullif(F.regexp_extract("id", "r([0-9]+)$", 1), F.lit("")).try_cast("int")).alias("top"))
    return top.select(*PAGE, protocol.region_id(F.col("page_id"), F.coalesce("top", F.lit(0)) + 1).alias("next_id"))


@query("""SELECT region_key, left(sha256(concat_ws('|', coalesce(page_id, ''), coalesce(array_to_string(bbox, ','), ''), coalesce(orientation, ''), coalesce(polarity, ''))), 8) AS crop FROM text_region""")
def crop_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_region").select("region_key", identity(F.col("page_id"), F.array_join("bbox", ","), F.col("orientation"), F.col("polarity"), size=8).alias("crop"))


@query(f"""WITH {PAGES} SELECT p.series_id, p.chapter_no, p.page_id, p.region_count, count(r.id) AS found FROM pages p LEFT JOIN (SELECT DISTINCT series_id, chapter_no, page_id, id FROM text_region) r
USING (series_id, chapter_no, page_id) WHERE p.region_count IS NOT NULL GROUP BY ALL HAVING p.region_count <> count(r.id)""")
def region_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "text_region").select(*PAGE, "id").distinct().groupBy(*PAGE).agg(F.count("id").alias("found"))
    return pages(spark, sf_dir).join(found, PAGE, "left").withColumn("found", F.coalesce("found", F.lit(0))).where("region_count <> found").select(*PAGE, "region_count", "found")


@query(f"WITH {PAGES} SELECT series_id, chapter_no, page_id FROM pages ANTI JOIN (SELECT series_id, chapter_no, page_id FROM text_region WHERE NOT coalesce(dropped, false)) r USING (series_id, chapter_no, page_id)")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "text_region").where("not coalesce(dropped, false)")
    return pages(spark, sf_dir).select(*PAGE).join(live, PAGE, "left_anti")


@query("""SELECT series_id, chapter_no, page_id, list_sort(list(DISTINCT id) FILTER (len(review) > 0)) AS needs_review FROM text_region GROUP BY ALL HAVING count(*) FILTER (len(review) > 0) > 0""")
def needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "text_region").where("size(review) > 0")
    return marked.groupBy(*PAGE).agg(F.array_sort(F.collect_set("id")).alias("needs_review"))
