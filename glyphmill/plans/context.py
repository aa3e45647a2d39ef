"""What a translator sees around a page: dialogue before and after it, speakers, terms to decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import protocol, states
from glyphmill.functions.states import stripped
from glyphmill.operators.windows import first_violation, latest, look_ahead, look_back, runs
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import PAGES, REGIONS, pages, regions
from glyphmill.session import table

query = Register()
UNIT = ["series_id", "chapter_no"]
COST_SQL = "length(trim(target_text)) + length(trim(coalesce(source_text, '')))"


def cost() -> Column:
    return F.length(stripped("target_text")) + F.length(stripped(F.coalesce("source_text", F.lit(""))))



BACK_SQL = f"""WITH {REGIONS}, {PAGES}, p AS (SELECT DISTINCT series_id, chapter_no, page_id AS for_page FROM pages),
r AS (SELECT p.for_page, f.*, {COST_SQL} AS cost,
  row_number() OVER (PARTITION BY p.series_id, p.chapter_no, p.for_page ORDER BY f.page_id DESC, f.region_key DESC) AS back
  FROM p JOIN flagged f ON p.series_id = f.series_id AND p.chapter_no = f.chapter_no AND f.page_id < p.for_page WHERE is_translatable AND has_target),
s AS (SELECT *, sum(cost) OVER (PARTITION BY series_id, chapter_no, for_page ORDER BY back) AS spent FROM r)"""


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).where(states.translatable() & states.has_text("target_text"))


@query(f"{BACK_SQL} SELECT series_id, chapter_no, for_page, region_key, back FROM s WHERE spent <= 3000 AND back <= 24")
def context_look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = look_back(_translated(spark, sf_dir), pages(spark, sf_dir), UNIT, "page_id", ["region_key"], cost())
    return kept.select(*UNIT, "for_page", "region_key", "back")


@query(f"""{BACK_SQL}, k AS (SELECT series_id, chapter_no, for_page, count(*) FILTER (spent <= 3000 AND back <= 24) AS kept, count(*) AS n FROM s GROUP BY ALL)
SELECT p.series_id, p.chapter_no, p.for_page, coalesce(k.kept, 0) AS kept, coalesce(k.kept < k.n, false) AS truncated FROM p LEFT JOIN k USING (series_id, chapter_no, for_page)""")
def context_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_back(_translated(spark, sf_dir), pages(spark, sf_dir), UNIT, "page_id", ["region_key"], cost())[1]


@query(f"""WITH {PAGES}, n AS (SELECT series_id, chapter_no, page_id, lead(page_id) OVER (PARTITION BY series_id, chapter_no ORDER BY page_id) AS next
  FROM (SELECT DISTINCT series_id, chapter_no, page_id FROM pages)),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, chapter_no, page_id ORDER BY region_key) AS ahead FROM text_region WHERE NOT coalesce(dropped, false))
SELECT n.series_id, n.chapter_no, n.page_id AS for_page, r.region_key, r.ahead, r.kind, left(trim(r.source_text), 80) AS source, length(trim(r.source_text)) > 80 AS cut
FROM n JOIN r ON n.series_id = r.series_id AND n.chapter_no = r.chapter_no AND n.next = r.page_id WHERE r.ahead <= 8""")
def context_look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "text_region").where("not coalesce(dropped, false)")
    ahead = look_ahead(live, pages(spark, sf_dir), UNIT, "page_id", ["region_key"])
    return ahead.withColumn("text", stripped("source_text")).selectExpr(*UNIT, "for_page", "region_key", "ahead", "kind", "left(text, 80) as source", "length(text) > 80 as cut")


@query("""WITH s AS (SELECT series_id, trim(speaker) AS speaker, chapter_no, page_id, ws_key FROM worksheet WHERE trim(coalesce(speaker, '')) <> '')
SELECT series_id, speaker, count(*) AS lines, arg_min(page_id, (chapter_no, page_id, ws_key)) AS first_page, min(chapter_no) AS first_chapter FROM s GROUP BY series_id, speaker""")
def speaker_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "worksheet").withColumn("speaker", stripped("speaker")).where("speaker <> ''")
    return said.groupBy("series_id", "speaker").agg(F.count("*").alias("lines"), F.min_by("page_id", F.struct("chapter_no", "page_id", "ws_key")).alias("first_page"), F.min("chapter_no").alias("first_chapter"))


@query("""SELECT series_id, chapter_no, page_id, list_sort(list(DISTINCT trim(speaker))) AS speakers FROM worksheet WHERE trim(coalesce(speaker, '')) <> '' GROUP BY ALL""")
def speakers_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "worksheet").withColumn("speaker", stripped("speaker")).where("speaker <> ''")
    return said.groupBy(*UNIT, "page_id").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


SCAN_SQL = """WITH e AS (
  SELECT series_id, trim(speaker) AS term, 'speaker' AS role, chapter_no, page_id FROM worksheet WHERE trim(coalesce(speaker, '')) <> ''
  UNION ALL SELECT series_id, trim(x) AS term, 'mentioned', chapter_no, page_id FROM (SELECT series_id, chapter_no, page_id, unnest(string_split(replace(propose, '،', ','), ',')) AS x FROM worksheet) WHERE trim(x) <> ''
  UNION ALL SELECT series_id, trim(source_text) AS term, 'repeated', chapter_no, page_id FROM text_region
    WHERE NOT coalesce(dropped, false) AND trim(coalesce(source_text, '')) <> '' AND length(trim(source_text)) <= 12 AND NOT contains(source_text, chr(10))),
c AS (SELECT series_id, term, count(*) FILTER (role = 'speaker') AS speaker, count(*) FILTER (role = 'mentioned') AS mentioned, count(*) FILTER (role = 'repeated') AS repeated,
  min((chapter_no, page_id)) AS f FROM e GROUP BY series_id, term),
t AS (SELECT series_id, term, speaker, mentioned, repeated, speaker + mentioned + repeated AS n, CASE WHEN speaker > 0 THEN 'character' WHEN mentioned > 0 THEN 'mentioned' ELSE 'term' END AS role,
  f[2] AS first_page FROM c WHERE speaker > 0 OR mentioned > 0 OR repeated >= 2)"""


def term_scan(worksheet: DataFrame, region: DataFrame) -> DataFrame:
    """Counts per role of every name and short repeated line of a series, with its first page."""
    at = ["series_id", "chapter_no", "page_id"]
    spoken = worksheet.select(*at, stripped("speaker").alias("term"), F.lit("speaker").alias("role"))
    mentioned = worksheet.select(*at, F.explode(F.split("propose", "[,،]")).alias("term")).select(*at, stripped("term").alias("term"), F.lit("mentioned").alias("role"))
    lines = region.where("not coalesce(dropped, false) and not contains(source_text, '\\n')")
    repeated = lines.select(*at, stripped("source_text").alias("term"), F.lit("repeated").alias("role")).where("length(term) <= 12")
    every = spoken.unionByName(mentioned).unionByName(repeated).where("term <> ''")
    counted = every.groupBy("series_id", "term").agg(
        *(F.count_if(F.col("role") == r).alias(r) for r in ("speaker", "mentioned", "repeated")), F.min(F.struct("chapter_no", "page_id"))["page_id"].alias("first_page")
    )
    role = F.when(F.col("speaker") > 0, "character").when(F.col("mentioned") > 0, "mentioned").otherwise("term")
    return counted.where("speaker > 0 or mentioned > 0 or repeated >= 2").withColumns({"n": F.expr("speaker + mentioned + repeated"), "role": role})


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan(table(spark, sf_dir, "worksheet"), table(spark, sf_dir, "text_region"))


@query(f"{SCAN_SQL} SELECT series_id, term, speaker, mentioned, repeated, n, role, first_page FROM t")
def term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).select("series_id", "term", "speaker", "mentioned", "repeated", "n", "role", "first_page")


@query(f"""{SCAN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, term) AS rank, count(*) OVER (PARTITION BY series_id) AS needed FROM t)
SELECT series_id, rank, term, n, greatest(needed - 40, 0) AS hidden FROM r WHERE rank <= 40""")
def terms_to_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 commonest of each series and how many more there are; the limit is the report's."""
    w = Window.partitionBy("series_id")
    ranked = _scan(spark, sf_dir).withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "term")), "needed": F.count("*").over(w)})
    return ranked.where("rank <= 40").selectExpr("series_id", "rank", "term", "n", "greatest(needed - 40, 0) as hidden")


@query("""WITH l AS (SELECT DISTINCT series_id, reader_id, received_at FROM worksheet WHERE reader_id IS NOT NULL),
d AS (SELECT series_id, reader_id, max(received_at) AS last FROM l GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY last DESC, reader_id) AS rank FROM d) SELECT series_id, reader_id, rank FROM r WHERE rank <= 8""")
def recent_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight readers of each series seen last, each once."""
    last = table(spark, sf_dir, "worksheet").where("reader_id is not null").groupBy("series_id", "reader_id").agg(F.max("received_at").alias("last"))
    w = Window.partitionBy("series_id").orderBy(F.desc("last"), "reader_id")
    return last.withColumn("rank", F.row_number().over(w)).where("rank <= 8").select("series_id", "reader_id", "rank")


@query(f"""WITH {REGIONS}, s AS (SELECT *, count(*) OVER w AS spot, sum(length(coalesce(source_text, ''))) OVER w AS running FROM regions
  WINDOW w AS (PARTITION BY series_id, chapter_no ORDER BY page_id, region_key ROWS UNBOUNDED PRECEDING)),
v AS (SELECT series_id, chapter_no, spot, CASE WHEN spot > 400 THEN 'too many' WHEN length(coalesce(source_text, '')) > 400 THEN 'too large' WHEN running > 3000 THEN 'total too large' END AS why FROM s)
SELECT series_id, chapter_no, min(spot) AS "at", arg_min(why, spot) AS why FROM v WHERE why IS NOT NULL GROUP BY ALL""")
def running_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.coalesce("source_text", F.lit("")))
    return first_violation(table(spark, sf_dir, "text_region"), UNIT, ["page_id", "region_key"], size, each=400, total=3000, many=400)


@query("""WITH p AS (SELECT series_id, chapter_no, page_index AS i, count(r.region_key) AS n FROM (SELECT DISTINCT series_id, chapter_no, page_id, page_index FROM page) p
  LEFT JOIN text_region r USING (series_id, chapter_no, page_id) GROUP BY series_id, chapter_no, page_id, page_index),
e AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, chapter_no ORDER BY i) AS island FROM p WHERE n <= 4)
SELECT series_id, chapter_no, min(i) AS start, count(*) AS length FROM e GROUP BY series_id, chapter_no, island HAVING count(*) >= 2""")
def sparse_page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two pages or more that hold few regions."""
    keys = [*UNIT, "page_id"]
    counted = table(spark, sf_dir, "text_region").groupBy(*keys).agg(F.count("*").alias("n"))
    each = table(spark, sf_dir, "page").select(*keys, "page_index").distinct().join(counted, keys, "left")
    return runs(each, UNIT, "page_index", F.coalesce("n", F.lit(0)) <= 4, 2)


@query("""SELECT series_id, chapter_no, id, region_key FROM (SELECT *, row_number() OVER (PARTITION BY series_id, chapter_no, id ORDER BY detected_at DESC, region_key DESC) AS nr FROM text_region) WHERE nr = 1""")
def latest_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "text_region")
    return latest(df, [*UNIT, "id"], [F.desc("detected_at"), F.desc("region_key")]).select(*UNIT, "id", "region_key")


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


FIRSTS = """w AS (SELECT series_id, chapter_no, page_id, trim(speaker) AS speaker FROM worksheet WHERE trim(coalesce(speaker, '')) <> ''),
f AS (SELECT series_id, speaker, min((chapter_no, page_id)) AS first FROM w GROUP BY ALL)"""


@query(f"""WITH {FIRSTS}, r AS (SELECT *, sum(length(speaker) + 4) OVER (PARTITION BY series_id ORDER BY first, speaker) AS size FROM f),
k AS (SELECT series_id, speaker, size, row_number() OVER (PARTITION BY series_id ORDER BY size) AS place FROM r WHERE size <= 1200) SELECT series_id, speaker, place FROM k""")
def fitted_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The speakers of a series in the order they first appear, as many as 1,200 characters of JSON hold."""
    said = table(spark, sf_dir, "worksheet").withColumn("speaker", stripped("speaker")).where("speaker <> ''")
    firsts = said.groupBy("series_id", "speaker").agg(F.min(F.struct("chapter_no", "page_id")).alias("first"))
    w = Window.partitionBy("series_id").orderBy("first", "speaker")
    sized = firsts.withColumn("size", F.sum(F.length("speaker") + 4).over(w)).where("size <= 1200")
    return sized.select("series_id", "speaker", F.row_number().over(Window.partitionBy("series_id").orderBy("size")).alias("place"))


@query()
def context_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a translator gets for each page, as one JSON: dialogue before, what follows, who speaks."""
    kept, flags = look_back(_translated(spark, sf_dir), pages(spark, sf_dir), UNIT, "page_id", ["region_key"], cost())
    keys = [*UNIT, "for_page"]
    line = F.struct("back", F.col("page_id").alias("page"), F.col("id").alias("region"), stripped("source_text").alias("src"), stripped("target_text").alias("fa"))
    before = kept.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(line))).alias("previous"))
    ahead = context_look_ahead(spark, sf_dir).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ahead", "kind", "source", "cut"))).alias("next"))
    said = speakers_on_page(spark, sf_dir).select(*UNIT, F.col("page_id").alias("for_page"), protocol.fitted_prefix(F.col("speakers"), 1200).alias("speakers"))
    joined = flags.join(before, keys, "left").join(ahead, keys, "left").join(said, keys, "left")
    return joined.select(*keys, F.to_json(F.struct("previous", "truncated", "next", "speakers")).alias("package"))
