"""Terms: mentions, drift, upserts, tables for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions.states import has_text, stripped, translatable
from glyphmill.operators import lexicon as L
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import REGIONS, regions
from glyphmill.session import table

query = Register()

# Locked terms of the sample tables, as the source writes them, and their approved forms.
LOCKED = [
    ("lantern", "lantern", "فانوس"), ("compass", "compass", "قطب‌نما"), ("notebook", "notebook", "دفترچه"), ("old map", "old map", "نقشه قدیمی"),
    ("brass key", "brass key", "کلید برنجی"), ("wooden horse", "wooden horse", "اسب چوبی"), ("glass eye", "glass eye", "چشم شیشه‌ای"), ("mask", "mask", "نقاب"),
]
VALUES = ", ".join(f"('{t}', '{f}', '{x}')" for t, f, x in LOCKED)
EDGE = "[^\\p{L}\\p{M}\\p{N}\\x{200C}]"


def sql_mention(text: str, form: str) -> str:
    """The form's words next to one another, bounded; a text without its first or last word is passed over."""
    whole = f"regexp_matches(' ' || {text} || ' ', '{EDGE}' || replace({form}, ' ', '{EDGE}+') || '{EDGE}')"
    return f"(CASE WHEN contains({text}, string_split({form}, ' ')[1]) AND contains({text}, string_split({form}, ' ')[-1]) THEN {whole} ELSE false END)"


def _locked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCKED, "term string, form string, target string")


@query(f"WITH l(term, form, target) AS (VALUES {VALUES}) SELECT DISTINCT region_key, term FROM text_region, l WHERE {sql_mention('source_text', 'form')}")
def term_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.mentions(table(spark, sf_dir, "text_region"), "region_key", "source_text", _locked(spark))


@query(f"""WITH {REGIONS}, l(term, form, target) AS (VALUES {VALUES}) SELECT DISTINCT region_key, term FROM flagged, l WHERE is_translatable AND has_source AND has_target
  AND {sql_mention('source_text', 'form')} AND NOT {sql_mention('target_text', 'target')}""")
def term_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = regions(spark, sf_dir).where(translatable() & has_text("source_text") & has_text("target_text"))
    return L.drift(live, "region_key", "source_text", "target_text", _locked(spark))


@query(f"""WITH {REGIONS}, l(term, form, target) AS (VALUES {VALUES}), d AS (SELECT DISTINCT region_key, term FROM flagged, l WHERE is_translatable AND has_source AND has_target
  AND {sql_mention('source_text', 'form')} AND NOT {sql_mention('target_text', 'target')}), r AS (SELECT *, row_number() OVER (ORDER BY region_key, term) AS place, count(*) OVER () AS total FROM d)
SELECT region_key, term, place, total FROM r WHERE place <= 30""")
def term_drift_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30, with the number of all; the limit is the report's, taken before any row is numbered."""
    found = term_drift(spark, sf_dir)
    first = found.orderBy("region_key", "term").limit(30).withColumn("place", F.row_number().over(Window.orderBy("region_key", "term")))
    return first.join(F.broadcast(found.groupBy().agg(F.count("*").alias("total"))))


@query("""WITH b AS (SELECT c0 AS term, unnest([c0, c1]) AS form FROM term_bank) SELECT DISTINCT ws_key, term FROM worksheet, b WHERE form IS NOT NULL AND propose IS NOT NULL AND """ + sql_mention("propose", "form"))
def bank_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank terms as they stand in proposals, both languages."""
    bank = table(spark, sf_dir, "term_bank")
    forms = bank.select(F.col("c0").alias("term"), F.explode(F.array("c0", "c1")).alias("form")).where("form is not null")
    return L.mentions(table(spark, sf_dir, "worksheet").where("propose is not null"), "ws_key", "propose", forms)


@query("""WITH n AS (SELECT c0 AS term, max(upper(c1)) AS target FROM term_bank WHERE c2 = 'approved' GROUP BY c0 UNION ALL SELECT 'Unknown Gate', 'دروازه'),
o AS (SELECT c0 AS term, c1 AS target, coalesce(c2, '') IN ('approved', 'place') AS locked FROM term_bank)
SELECT coalesce(o.term, n.term) AS term, CASE WHEN trim(coalesce(n.target, '')) <> '' THEN n.target ELSE o.target END AS target, coalesce(o.locked, false) AS locked,
  1 + (trim(coalesce(n.target, '')) <> '' AND o.target IS DISTINCT FROM n.target AND coalesce(o.locked, false) AND coalesce(o.target <> '', false))::INT AS version FROM o FULL JOIN n ON o.term = n.term""")
def term_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "term_bank")
    old = bank.select(F.col("c0").alias("term"), F.col("c1").alias("target"), F.coalesce("c2", F.lit("")).isin("approved", "place").alias("locked"), F.lit(1).alias("version"), F.lit(None).cast("array<struct<target:string,version:int>>").alias("previous"))
    new = bank.where("c2 = 'approved'").groupBy(F.col("c0").alias("term")).agg(F.max(F.upper("c1")).alias("target"))
    new = new.unionByName(spark.createDataFrame([("Unknown Gate", "دروازه")], "term string, target string"))
    return L.upsert(old, new, "term", "target").select("term", "target", "locked", "version")


@query("""WITH t AS (SELECT c0, c1, coalesce(c2 = 'approved', false) AS locked FROM term_bank), r AS (SELECT *, row_number() OVER (PARTITION BY locked ORDER BY c0) AS nr, count(*) FILTER (locked) OVER () AS fixed, count(*) FILTER (NOT locked) OVER () AS open FROM t)
SELECT c0, c1, locked, greatest(open - greatest(40 - fixed, 0), 0) AS hidden FROM r WHERE locked OR nr <= greatest(40 - fixed, 0)""")
def glossary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All locked terms, suggestions up to 40 rows in all, and how many are hidden."""
    bank = table(spark, sf_dir, "term_bank").select("c0", "c1", F.coalesce(F.col("c2") == "approved", F.lit(False)).alias("locked"))
    counts = bank.groupBy().agg(F.count_if("locked").alias("fixed"), F.count_if(~F.col("locked")).alias("open"))
    ranked = bank.withColumn("nr", F.row_number().over(Window.partitionBy("locked").orderBy("c0"))).join(F.broadcast(counts))
    return ranked.where("locked or nr <= greatest(40 - fixed, 0)").selectExpr("c0", "c1", "locked", "greatest(open - greatest(40 - fixed, 0), 0) as hidden")


@query("""SELECT c0, [x FOR x IN list_distinct([c0, c2]) IF x IS NOT NULL AND trim(x) <> ''] AS forms FROM (SELECT c0, CASE WHEN c2 = c0 THEN NULL ELSE c2 END AS c2 FROM term_bank) WHERE c2 IS NULL OR trim(c2) = ''""")
def term_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = table(spark, sf_dir, "term_bank").where("c2 is null or trim(c2) = ''")
    return bank.select("c0", L.all_forms(F.col("c0"), F.array("c2")).alias("forms"))


@query("""WITH r AS (SELECT series_id, trim(speaker) AS name, 'character' AS role FROM worksheet UNION ALL SELECT series_id, trim(propose), 'mentioned' FROM worksheet)
SELECT series_id, name, arg_max(role, CASE role WHEN 'character' THEN 2 WHEN 'mentioned' THEN 1 ELSE 0 END) AS role FROM r WHERE name <> '' GROUP BY series_id, name""")
def promoted_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "worksheet")
    spoken = sheet.select("series_id", stripped("speaker").alias("name"), F.lit("character").alias("role"))
    typed = sheet.select("series_id", stripped("propose").alias("name"), F.lit("mentioned").alias("role"))
    return spoken.unionByName(typed).where("name <> ''").groupBy("series_id", "name").agg(L.highest_role(F.col("role")).alias("role"))
