"""Roll-ups, dense arrays, digests and small column functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import numbers, protocol
from glyphmill.functions.states import has_text, translatable
from glyphmill.functions.digests import identity, text_digest
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import REGIONS, regions
from glyphmill.session import table

query = Register()
UNIT = ["series_id", "chapter_no"]
KINDS = ["speech", "thought", "narration", "sfx", "sign", "unknown"]


@query(f"SELECT series_id, chapter_no, {', '.join(f'count(*) FILTER (kind = {k!r}) AS n_{k}' for k in KINDS)}, count(DISTINCT page_id) AS pages FROM text_region GROUP BY ALL")
def kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    return table(spark, sf_dir, "text_region").groupBy(*UNIT).agg(*counts, F.countDistinct("page_id").alias("pages"))


@query("""WITH p AS (SELECT p.series_id, p.chapter_no, p.page_id, count(r.region_key) AS n FROM (SELECT DISTINCT series_id, chapter_no, page_id FROM page) p LEFT JOIN text_region r USING (series_id, chapter_no, page_id) GROUP BY ALL)
SELECT series_id, chapter_no, count(*) AS pages, count(*) FILTER (n = 0) AS empty, count(*) FILTER (n = 0) > greatest(1, count(*) // 5) AS warn FROM p GROUP BY ALL""")
def empty_page_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = [*UNIT, "page_id"]
    counted = table(spark, sf_dir, "text_region").groupBy(*page).agg(F.count("*").alias("n"))
    each = table(spark, sf_dir, "page").select(*page).distinct().join(counted, page, "left")
    rolled = each.groupBy(*UNIT).agg(F.count("*").alias("pages"), F.count_if(F.col("n").isNull()).alias("empty"))
    return rolled.withColumn("warn", F.col("empty") > F.greatest(F.lit(1), F.floor(F.col("pages") / 5)))


@query("""SELECT series_id, chapter_no, count(*) FILTER (fill = 'flat') AS flat, count(*) FILTER (fill = 'inpaint') AS inpaint, count(*) FILTER (clean_status = 'refused') AS refused,
  count(*) FILTER (fill = 'inpaint') > count(*) FILTER (fill = 'flat') AS mostly_inpaint FROM text_region GROUP BY ALL""")
def cleaning_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "text_region").groupBy(*UNIT)
    counts = [F.count_if(F.col("fill") == t).alias(t) for t in ("flat", "inpaint")]
    return df.agg(*counts, F.count_if(F.col("clean_status") == "refused").alias("refused")).withColumn("mostly_inpaint", F.col("inpaint") > F.col("flat"))


@query("""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, arg_max(event_id, (ts, event_id)) AS last, round(sum(value), 3) AS total FROM events GROUP BY event_type""")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"), F.round(F.sum("value"), 3).alias("total"))


@query("""SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id""")
def latest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("""SELECT vec_id, round(list_sum([abs(embedding[i]::DOUBLE - embedding[65 - i]::DOUBLE) FOR i IN range(1, 65)]) / 64, 6) AS l1 FROM embeddings""")
def grid_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of two 8x8 grids: each vector and its mirror."""
    diff = F.aggregate(F.zip_with(F.col("embedding"), F.reverse("embedding"), lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(diff / 64, 6).alias("l1"))


@query("""SELECT vec_id, round(stddev_pop(x), 6) AS spread, stddev_pop(x) <= 0.13 AS flat FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id""")
def flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the values of an array vary so little that one colour fills them."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    mean = F.aggregate(e, F.lit(0.0), lambda s, v: s + v) / F.size("embedding")
    var = F.aggregate(e, F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))) / F.size("embedding")
    df = table(spark, sf_dir, "embeddings").where("size(embedding) > 0").withColumn("m", mean).withColumn("s", F.sqrt(var))
    return df.select("vec_id", F.round("s", 6).alias("spread"), (F.col("s") <= 0.13).alias("flat"))


@query("SELECT region_key, confidence, coalesce(NOT isnan(confidence) AND confidence BETWEEN 0 AND 1, false) AS valid FROM text_region")
def valid_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_region").select("region_key", "confidence", protocol.valid_confidence(F.col("confidence")).alias("valid"))


@query("""SELECT doc_id, sha256(coalesce(text, '')) AS digest, left(sha256(concat_ws('|', coalesce(doc_kind, ''), coalesce(source, ''))), 16) AS origin FROM documents""")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text_digest(F.coalesce("text", F.lit(""))).alias("digest"), identity(F.col("doc_kind"), F.col("source")).alias("origin"))


RIGHT = "[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"


@query(f"""SELECT doc_id, regexp_matches(regexp_extract(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{024F}}]|{RIGHT}'), '{RIGHT}') AS right_to_left FROM documents""")
def paragraph_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", protocol.right_to_left(F.col("text")).alias("right_to_left"))


@query("""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^ء-غف-يٮ-ۓۺ-ۿ]', '', 'g')) > length(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS persian_line FROM documents""")
def persian_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.length(F.regexp_replace(F.coalesce("text", F.lit("")), p, ""))
    return table(spark, sf_dir, "documents").select("doc_id", (count("[^ء-غف-يٮ-ۓۺ-ۿ]") > count("[^A-Za-z]")).alias("persian_line"))


@query("""WITH l AS (SELECT region_key, unnest(range(1, greatest(len(a), len(b)) + 1)) AS line, a, b FROM (SELECT region_key, string_split(target_text, chr(10)) AS a, string_split(replace(replace(target_text, 'ي', 'ی'), 'ك', 'ک'), chr(10)) AS b FROM text_region WHERE target_text IS NOT NULL))
SELECT region_key, line, a[line] AS was, b[line] AS now FROM l WHERE a[line] IS DISTINCT FROM b[line]""")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that folding two letters changes, with both forms."""
    df = table(spark, sf_dir, "text_region").where("target_text is not null")
    both = F.zip_with(F.split("target_text", "\n", -1), F.split(F.translate("target_text", "يك", "یک"), "\n", -1), lambda a, b: F.struct(a.alias("was"), b.alias("now")))
    return df.select("region_key", F.posexplode(both).alias("at", "p")).where("not p.was <=> p.now").selectExpr("region_key", "at + 1 as line", "p.was as was", "p.now as now")


@query("SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS runs FROM documents")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]+)"), F.lit(1)).alias("runs"))


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+|https?://[^\\s]+')) AS spans FROM documents")
def address_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+|https?://[^\s]+)"), F.lit(1))).alias("spans"))


@query(f"""WITH {REGIONS} SELECT series_id, chapter_no, page_id, count(*) AS regions, count(*) FILTER (is_translatable) AS owed, count(*) FILTER (is_translatable AND has_target) AS done, round(avg(confidence), 9) AS confidence FROM flagged GROUP BY ALL""")
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = regions(spark, sf_dir)
    owed = translatable()
    return df.groupBy(*UNIT, "page_id").agg(F.count("*").alias("regions"), F.count_if(owed).alias("owed"), F.count_if(owed & has_text("target_text")).alias("done"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query()
def quantity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions whose target does not write the same quantities as their source."""
    df = table(spark, sf_dir, "text_region").where("source_text is not null and target_text is not null")
    both = df.select("region_key", numbers.quantities_of("source_text").alias("asked"), numbers.quantities_of("target_text").alias("given"))
    return both.where("asked <> given")


@query("""WITH d AS (SELECT *, lower(source_language) AS lang FROM chapter) SELECT series_id, chapter_no, CASE WHEN lang IN ('ja', 'jpn') THEN 'ja' WHEN lang IN ('ko', 'kor') THEN 'ko' WHEN lang IN ('zh', 'zho', 'cmn') THEN 'zh' WHEN lang IN ('en', 'eng') THEN 'en' ELSE 'common' END AS rules FROM d""")
def language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules a chapter's source language takes; an unknown one takes the common ones."""
    names = {"ja": "ja", "jpn": "ja", "ko": "ko", "kor": "ko", "zh": "zh", "zho": "zh", "cmn": "zh", "en": "en", "eng": "en"}
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return table(spark, sf_dir, "chapter").select(*UNIT, F.coalesce(F.try_element_at(known, F.lower("source_language")), F.lit("common")).alias("rules"))
