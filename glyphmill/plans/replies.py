"""Replies against regions: joins, merges, roll-ups, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import protocol
from glyphmill.functions.digests import text_digest
from glyphmill.functions.states import has_text, translatable
from glyphmill.operators import replies as R
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import PAGES, REGIONS, pages, regions
from glyphmill.session import table

query = Register()
UNIT = ["series_id", "chapter_no"]
PAGE = [*UNIT, "page_id"]

NEW = "new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region_key ORDER BY received_at DESC, ws_key DESC) AS nr FROM worksheet WHERE region_key IS NOT NULL) WHERE nr = 1)"
MATCH = f"""{NEW}, matched AS (SELECT coalesce(t.region_key, n.region_key) AS region_key, CASE WHEN t.region_key IS NULL THEN 'unknown_region' WHEN n.region_key IS NULL THEN 'missing'
  WHEN n.answer IS NOT NULL THEN n.answer WHEN trim(coalesce(n.fa, '')) = '' THEN 'empty_translation' ELSE 'translated' END AS outcome FROM text_region t FULL JOIN new n ON t.region_key = n.region_key)"""


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "text_region"), table(spark, sf_dir, "worksheet")


@query(f"WITH {MATCH} SELECT region_key, outcome FROM matched")
def reply_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match(*_both(spark, sf_dir)).select("region_key", "outcome")


@query(f"WITH {MATCH} SELECT outcome, count(*) AS n FROM matched GROUP BY outcome")
def reply_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.match(*_both(spark, sf_dir)).groupBy("outcome").agg(F.count("*").alias("n"))


@query("SELECT ws_key, region_id FROM worksheet w WHERE NOT starts_with(coalesce(region_id, ''), '+') AND NOT EXISTS (SELECT 1 FROM text_region t WHERE t.region_key = w.region_key)")
def unknown_reply_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, sheet = _both(spark, sf_dir)
    return sheet.where("not startswith(coalesce(region_id, ''), '+')").join(region.select("region_key"), "region_key", "left_anti").select("ws_key", "region_id")


@query("SELECT series_id, chapter_no, page_id, region_id AS slug, arg_max(fa, (received_at, ws_key)) AS fa, count(*) AS n FROM worksheet WHERE starts_with(region_id, '+') GROUP BY ALL")
def added_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that readers added: one per slug, its last text."""
    added = table(spark, sf_dir, "worksheet").where("startswith(region_id, '+')")
    last = F.max(F.struct("received_at", "ws_key", "fa"))["fa"]
    return added.groupBy(*PAGE, F.col("region_id").alias("slug")).agg(last.alias("fa"), F.count("*").alias("n"))


@query("""SELECT ws_key, [x FOR x IN [CASE WHEN lower(trim(kind)) NOT IN ('speech', 'thought', 'narration', 'sfx', 'sign', 'unknown') THEN 'kind' END,
  CASE WHEN answer NOT IN ('drop', 'keep', 'erase') THEN 'answer' END, CASE WHEN seen < 1 THEN 'seen' END] IF x IS NOT NULL] AS bad FROM worksheet""")
def invalid_reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "worksheet").select("ws_key", R.bad_fields(F.col("kind"), F.col("answer"), F.col("seen")).alias("bad"))


@query("""WITH g AS (SELECT reader_id, region_key, coalesce(fa, '') AS fa, count(*) AS n, min(ws_key) AS first, max(ws_key) AS last FROM worksheet WHERE region_key IS NOT NULL AND reader_id IS NOT NULL GROUP BY ALL)
SELECT reader_id, region_key, n, first, last FROM g WHERE n > 1""")
def resent_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "worksheet").where("region_key is not null and reader_id is not null")
    sent = sheet.groupBy("reader_id", "region_key", F.coalesce("fa", F.lit("")).alias("fa")).agg(F.count("*").alias("n"), F.min("ws_key").alias("first"), F.max("ws_key").alias("last"))
    return sent.where("n > 1").select("reader_id", "region_key", "n", "first", "last")


@query("""SELECT series_id, chapter_no, page_id, count(*) FILTER (answer = 'drop') AS n_drop, count(*) FILTER (answer = 'keep') AS n_keep, count(*) FILTER (answer = 'erase') AS n_erase,
  count(*) FILTER (answer IS NULL) AS n_text FROM worksheet GROUP BY ALL""")
def answer_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("answer") == a).alias(f"n_{a}") for a in ("drop", "keep", "erase")]
    return table(spark, sf_dir, "worksheet").groupBy(*PAGE).agg(*counts, F.count_if(F.col("answer").isNull()).alias("n_text"))


MERGE = f"""{NEW}, bad AS (SELECT n.series_id, n.chapter_no, n.page_id, max(CASE WHEN t.region_key IS NULL OR coalesce(lower(trim(n.kind)) NOT IN ('speech', 'thought', 'narration', 'sfx', 'sign', 'unknown'), false)
    OR coalesce(n.answer NOT IN ('drop', 'keep', 'erase'), false) OR coalesce(n.seen < 1, false) THEN 1 ELSE 0 END) AS refused FROM new n LEFT JOIN text_region t ON n.region_key = t.region_key GROUP BY ALL),
j AS (SELECT t.*, n.fa, n.answer, coalesce(b.refused, 0) = 1 AS refused, n.answer IS NOT NULL OR trim(coalesce(n.fa, '')) <> '' AS given,
  coalesce(t.locked, false) AND trim(coalesce(t.target_text, '')) <> '' AND t.target_text IS DISTINCT FROM n.fa AS held
  FROM text_region t LEFT JOIN new n ON t.region_key = n.region_key LEFT JOIN bad b ON t.series_id = b.series_id AND t.chapter_no = b.chapter_no AND t.page_id = b.page_id),
m AS (SELECT *, CASE WHEN refused THEN 'page_refused' WHEN NOT given THEN 'unchanged' WHEN answer IS NOT NULL THEN 'answered' WHEN held THEN 'locked' ELSE 'applied' END AS outcome FROM j)"""


@query(f"""WITH {MERGE} SELECT region_key, outcome, CASE WHEN outcome = 'applied' THEN fa ELSE target_text END AS target_text,
  CASE WHEN given AND NOT refused THEN coalesce(answer = 'drop', false) ELSE coalesce(dropped, false) END AS dropped,
  CASE WHEN given AND NOT refused THEN coalesce(answer = 'keep', false) ELSE coalesce(keep, false) END AS keep,
  CASE WHEN given AND NOT refused THEN coalesce(answer = 'erase', false) ELSE coalesce(erase, false) END AS erase FROM m""")
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge(*_both(spark, sf_dir), PAGE).select("region_key", "outcome", "target_text", "dropped", "keep", "erase")


@query(f"WITH {MERGE} SELECT outcome, count(*) AS n FROM m GROUP BY outcome")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge(*_both(spark, sf_dir), PAGE).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""WITH {REGIONS}, {NEW} SELECT f.region_key FROM flagged f WHERE is_translatable AND NOT has_target AND NOT EXISTS (SELECT 1 FROM new n WHERE n.region_key = f.region_key AND trim(coalesce(n.fa, '')) <> '')""")
def still_to_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resume: owed regions without a text and without a reply that brings one."""
    owed = regions(spark, sf_dir).where(translatable() & ~has_text("target_text"))
    done = R.newest(table(spark, sf_dir, "worksheet")).where(has_text("fa")).select("region_key")
    return owed.join(done, "region_key", "left_anti").select("region_key")


@query(f"""WITH {PAGES}, d AS (SELECT DISTINCT p.series_id, p.chapter_no, p.page_id, w.page_id IS NULL AS unmerged FROM pages p
  LEFT JOIN (SELECT DISTINCT series_id, chapter_no, page_id FROM worksheet) w USING (series_id, chapter_no, page_id))
SELECT series_id, chapter_no, page_id, coalesce(sum(unmerged::INT) OVER (PARTITION BY series_id, chapter_no ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS unmerged_before FROM d""")
def earlier_unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many earlier pages of the chapter no reader has answered."""
    seen = table(spark, sf_dir, "worksheet").select(*PAGE, F.lit(0).alias("open")).distinct()
    every = pages(spark, sf_dir).select(*PAGE).distinct().join(seen, PAGE, "left").withColumn("open", F.coalesce("open", F.lit(1)))
    before = Window.partitionBy(*UNIT).orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return every.select(*PAGE, F.coalesce(F.sum("open").over(before), F.lit(0)).alias("unmerged_before"))


@query("""WITH l AS (SELECT ws_key, unnest(string_split_regex(note, '\\r\\n|\\r|\\n')) AS line FROM worksheet WHERE note IS NOT NULL)
SELECT ws_key, CASE WHEN regexp_matches(line, '^(@@|#([ \\t]|$)|\\\\|[a-z_]+:)') THEN '\\' || line ELSE line END AS escaped, line FROM l""")
def escaped_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "worksheet").where("note is not null").select("ws_key", F.explode(protocol.lines(F.col("note"))).alias("line"))
    escaped = rows.withColumn("escaped", protocol.escaped(F.col("line")))
    return escaped.select("ws_key", "escaped", protocol.unescaped(F.col("escaped")).alias("line"))


@query("""SELECT page_id, series_id, chapter_no, left(sha256(string_agg(concat_ws('|', coalesce(region_id, ''), coalesce(fa, ''), coalesce(answer, '')), '' ORDER BY coalesce(region_id, ''), coalesce(fa, ''), coalesce(answer, ''), ws_key)), 16) AS digest
FROM worksheet GROUP BY ALL""")
def reply_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's replies as one digest, the same in whatever order they came."""
    sheet = table(spark, sf_dir, "worksheet")
    parts = [F.coalesce(c, F.lit("")).alias(c) for c in ("region_id", "fa", "answer")]
    rows = sheet.select(*PAGE, F.struct(*parts, "ws_key").alias("r"))
    line = lambda r: F.concat_ws("|", r["region_id"], r["fa"], r["answer"])
    return rows.groupBy(*PAGE).agg(text_digest(F.array_join(F.transform(F.array_sort(F.collect_list("r")), line), ""), 16).alias("digest"))


RESULT = """WITH g AS (SELECT region_key, target_text AS current, upper(coalesce(source_text, '')) AS given, confidence, locked FROM text_region),
o AS (SELECT *, trim(coalesce(current, '')) <> '' AS has, trim(given) <> '' AS gives, coalesce(locked, false) AS lock FROM g),
r AS (SELECT *, CASE WHEN coalesce(confidence, 1.0) < 0.65 THEN 'needs_review' WHEN gives AND (has OR lock) AND given IS DISTINCT FROM current THEN 'needs_review'
  WHEN lock THEN 'locked' WHEN has THEN 'unchanged' WHEN NOT gives THEN 'failed' ELSE 'applied' END AS outcome FROM o)"""


@query(f"{RESULT} SELECT region_key, outcome, CASE WHEN outcome = 'applied' THEN given ELSE current END AS result FROM r")
def provider_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in for a machine: the source text in capitals."""
    df = table(spark, sf_dir, "text_region").withColumn("given", F.upper(F.coalesce("source_text", F.lit(""))))
    return R.apply_results(df, "target_text", "given", "confidence", "locked").select("region_key", "outcome", "result")


@query("""SELECT region_key, list_sort(list_distinct(list_concat(coalesce(review, []), ['seen']))) AS audit FROM text_region""")
def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "text_region")
    return df.select("region_key", F.array_sort(F.array_union(F.coalesce("review", F.array().cast("array<string>")), F.array(F.lit("seen")))).alias("audit"))


@query("""WITH p AS (SELECT DISTINCT series_id, chapter_no, page_id FROM page), w AS (SELECT series_id, chapter_no, page_id, region_key FROM worksheet WHERE region_key IS NOT NULL),
d AS (SELECT p.series_id, p.chapter_no, count(DISTINCT p.page_id) AS pages, count(DISTINCT w.page_id) AS answered FROM p LEFT JOIN w USING (series_id, chapter_no, page_id) GROUP BY ALL)
SELECT series_id, chapter_no, pages, answered, pages - answered AS remaining FROM d""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "worksheet").where("region_key is not null").select(*PAGE, F.lit(1).alias("yes")).distinct()
    every = table(spark, sf_dir, "page").select(*PAGE).distinct().join(seen, PAGE, "left")
    counted = every.groupBy(*UNIT).agg(F.count("*").alias("pages"), F.count("yes").alias("answered"))
    return counted.withColumn("remaining", F.col("pages") - F.col("answered"))
