"""Policies, page-level gate codes, facets, marks on every page, records to check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import boxes as B
from glyphmill.functions import policy as P
from glyphmill.functions import prose
from glyphmill.functions.digests import ordered, text_digest
from glyphmill.functions.states import has_text, stripped, translatable
from glyphmill.operators.freshness import stale
from glyphmill.operators.windows import latest
from glyphmill.plans.registry import Register
from glyphmill.plans.tables import PAGES, REGIONS, pages, regions
from glyphmill.session import table

query = Register()
UNIT = ["series_id", "chapter_no"]
PAGE = [*UNIT, "page_id"]
NOTES = ("narrow balloon", "pun lost", "check the tail")


@query("""WITH c AS (SELECT series_id, chapter_no, lower(coalesce(title, '')) AS t, coalesce(sfx_policy, 'keep') AS own FROM chapter)
SELECT series_id, chapter_no, CASE WHEN contains(t, own) THEN NULL WHEN contains(t, 'keep') THEN 'keep' WHEN contains(t, 'translate') THEN 'translate' WHEN contains(t, 'bilingual') THEN 'bilingual' WHEN contains(t, 'annotate') THEN 'annotate' END AS conflict FROM c""")
def policy_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chapter").select(*UNIT, P.sfx_conflict(F.col("title"), F.col("sfx_policy")).alias("conflict"))


@query(f"""SELECT CASE WHEN note IN {NOTES!r} THEN note ELSE 'rejected' END AS code, count(*) AS n, max(length(left(note, 400))) AS longest FROM worksheet WHERE note IS NOT NULL GROUP BY 1""")
def visual_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a closed vocabulary, the others counted together."""
    noted = table(spark, sf_dir, "worksheet").where("note is not null")
    code = F.when(F.col("note").isin(*NOTES), F.col("note")).otherwise("rejected")
    return noted.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.max(F.length(F.left("note", F.lit(400)))).alias("longest"))


@query("""SELECT DISTINCT series_id, chapter_no, page_id FROM text_region ANTI JOIN page USING (series_id, chapter_no, page_id)""")
def gate_page_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_region").select(*PAGE).distinct().join(table(spark, sf_dir, "page"), PAGE, "left_anti")


@query(f"""WITH {PAGES}, s AS (SELECT sha256, count(*) AS n, min((series_id, chapter_no, page_id)) AS first FROM pages GROUP BY sha256 HAVING count(*) > 1)
SELECT p.series_id, p.chapter_no, p.page_id FROM pages p JOIN s ON p.sha256 = s.sha256 WHERE (p.series_id, p.chapter_no, p.page_id) <> s.first""")
def gate_archive_duplicate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bytes an earlier page has already."""
    df = pages(spark, sf_dir).select(*PAGE, "sha256")
    first = df.groupBy("sha256").agg(F.count("*").alias("n"), F.min(F.struct(*PAGE)).alias("first")).where("n > 1")
    return df.join(first, "sha256").where(F.struct(*PAGE) != F.col("first")).select(*PAGE)


@query(f"""WITH {PAGES}, a AS (SELECT series_id, chapter_no, page_id, sum(bbox[3]::BIGINT * bbox[4]::BIGINT) AS area FROM text_region WHERE NOT coalesce(dropped, false) GROUP BY ALL)
SELECT p.series_id, p.chapter_no, p.page_id, round(area / (width::BIGINT * height), 6) AS coverage FROM pages p JOIN a USING (series_id, chapter_no, page_id) WHERE area / (width::BIGINT * height) > 0.28""")
def gate_mask_excessive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which regions claim more than 28 hundredths."""
    claimed = table(spark, sf_dir, "text_region").where("not coalesce(dropped, false)").groupBy(*PAGE).agg(F.sum(B.area(F.col("bbox"))).alias("area"))
    share = F.col("area") / (F.col("width").cast("long") * F.col("height"))
    return pages(spark, sf_dir).join(claimed, PAGE).where(share > 0.28).select(*PAGE, F.round(share, 6).alias("coverage"))


@query(f"""WITH {REGIONS}, p AS (SELECT series_id, chapter_no, page_id, max(CASE WHEN coalesce(dropped, false) THEN 0 WHEN is_translatable AND has_target THEN 2 WHEN is_repaired THEN 1 ELSE 0 END) AS needed,
  CASE WHEN count(*) FILTER (clean_status = 'clean') = count(*) THEN 2 WHEN count(*) FILTER (clean_status = 'clean') > 0 THEN 1 ELSE 0 END AS shipped FROM flagged GROUP BY ALL)
SELECT series_id, chapter_no, page_id, CASE needed WHEN 2 THEN 'page-not-rendered' ELSE 'page-not-cleaned' END AS code FROM p WHERE shipped < needed""")
def gate_pages_below_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that ship less than they need; what is shipped is told by how many regions are clean."""
    live = ~F.coalesce("dropped", F.lit(False))
    repaired = ~F.coalesce("fill", F.lit("none")).isin("none", "keep")
    rank = F.when(live & translatable() & has_text("target_text"), 2).when(live & repaired, 1).otherwise(0)
    clean = F.count_if(F.col("clean_status") == "clean")
    shipped = F.when(clean == F.count("*"), 2).when(clean > 0, 1).otherwise(0)
    df = regions(spark, sf_dir).groupBy(*PAGE).agg(F.max(rank).alias("needed"), shipped.alias("shipped")).where("shipped < needed")
    return df.select(*PAGE, F.when(F.col("needed") == 2, "page-not-rendered").otherwise("page-not-cleaned").alias("code"))


FACETS = {"geometry": "concat_ws(',', id, array_to_string(bbox, ','))", "source": "coalesce(source_text, '')", "text": "coalesce(target_text, '')", "policy": "concat_ws(',', coalesce(dropped, false)::VARCHAR, coalesce(keep, false)::VARCHAR, coalesce(erase, false)::VARCHAR)"}
FACET_SQL = ", ".join(f"sha256(string_agg({e}, '' ORDER BY region_key)) AS {n}" for n, e in FACETS.items())
PICK = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, chapter_no, id ORDER BY detected_at{0}, region_key{0}) AS nr FROM text_region) WHERE nr = 1"


def facets(df: DataFrame) -> DataFrame:
    """One digest of each page per kind of input, so that a change is known by what it touches."""
    flags = F.concat_ws(",", *(F.coalesce(c, F.lit(False)).cast("string") for c in ("dropped", "keep", "erase")))
    lines = {"geometry": F.concat_ws(",", "id", F.array_join("bbox", ",")), "source": F.coalesce("source_text", F.lit("")), "text": F.coalesce("target_text", F.lit("")), "policy": flags}
    return df.groupBy(*PAGE).agg(*(text_digest(ordered(e, "region_key")).alias(n) for n, e in lines.items()))


@query(f"SELECT series_id, chapter_no, page_id, {FACET_SQL} FROM ({PICK.format(' DESC')}) GROUP BY ALL")
def page_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets(latest(table(spark, sf_dir, "text_region"), [*UNIT, "id"], [F.desc("detected_at"), F.desc("region_key")]))


@query(f"""WITH n AS (SELECT series_id, chapter_no, page_id, {FACET_SQL} FROM ({PICK.format(' DESC')}) GROUP BY ALL), o AS (SELECT series_id, chapter_no, page_id, {FACET_SQL} FROM ({PICK.format('')}) GROUP BY ALL)
SELECT series_id, chapter_no, page_id, CASE WHEN n.geometry <> o.geometry THEN 'geometry' WHEN n.source <> o.source THEN 'source' WHEN n.text <> o.text THEN 'text' WHEN n.policy <> o.policy THEN 'policy' END AS why
FROM n JOIN o USING (series_id, chapter_no, page_id) WHERE n.geometry <> o.geometry OR n.source <> o.source OR n.text <> o.text OR n.policy <> o.policy""")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page is no longer what it was when first detected: the first facet that differs."""
    df = table(spark, sf_dir, "text_region")
    now = facets(latest(df, [*UNIT, "id"], [F.desc("detected_at"), F.desc("region_key")]))
    was = facets(latest(df, [*UNIT, "id"], ["detected_at", "region_key"])).withColumnsRenamed({n: f"{n}_was" for n in FACETS})
    why = F.coalesce(*(F.when(F.col(n) != F.col(f"{n}_was"), n) for n in FACETS))
    return now.join(was, PAGE).select(*PAGE, why.alias("why")).where("why is not null")


MARK = (900, 1400, 400, 120)


@query(f"""WITH {PAGES}, b AS (SELECT series_id, chapter_no, page_id, width, height, least(greatest(round_even({MARK[0]} * width / 1000.0, 0), 0), width - 1)::BIGINT AS x, least(greatest(round_even({MARK[1]} * width / 1000.0, 0), 0), height - 1)::BIGINT AS y,
  round_even({MARK[0] + MARK[2]} * width / 1000.0, 0)::BIGINT AS x1, round_even({MARK[1] + MARK[3]} * width / 1000.0, 0)::BIGINT AS y1 FROM pages),
c AS (SELECT *, least(greatest(x1, x + 1), width) - x AS w, least(greatest(y1, y + 1), height) - y AS h FROM b)
SELECT series_id, chapter_no, page_id, [x, y, w, h] AS box FROM c WHERE w * h <= 0.25 * width * height AND w >= 4 AND h >= 4""")
def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box drawn on a page 1,000 wide, on every page at its own scale; never a quarter of a page or more."""
    scale = F.col("width") / 1000
    x, y, w, h = (F.lit(v) for v in MARK)
    raw = F.array(*(v.cast("double") for v in (F.bround(x * scale), F.bround(y * scale), F.bround((x + w) * scale) - F.bround(x * scale), F.bround((y + h) * scale) - F.bround(y * scale))))
    df = pages(spark, sf_dir).withColumn("box", B.clamp(raw, F.col("width"), F.col("height")))
    fits = (B.area(F.col("box")) <= 0.25 * F.col("width") * F.col("height")) & (F.get("box", F.lit(2)) >= 4) & (F.get("box", F.lit(3)) >= 4)
    return df.where(fits).select(*PAGE, "box")


@query("""SELECT c0, unnest([x FOR x IN [CASE WHEN trim(coalesce(c0, '')) = '' THEN 'no term' END, CASE WHEN trim(coalesce(c1, '')) = '' THEN 'no target' END, CASE WHEN c1 IS NOT NULL AND NOT regexp_matches(c1, '[\\x{0600}-\\x{06FF}]') THEN 'target not in the script' END,
  CASE WHEN c0 = c1 THEN 'target repeats the term' END, CASE WHEN length(c2) > 20 THEN 'note too long' END] IF x IS NOT NULL]) AS fault FROM term_bank""")
def term_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "no term": F.coalesce(stripped("c0") == "", F.lit(True)),
        "no target": F.coalesce(stripped("c1") == "", F.lit(True)),
        "target not in the script": F.coalesce(~F.col("c1").rlike("[\\x{0600}-\\x{06FF}]"), F.lit(False)),
        "target repeats the term": F.coalesce(F.col("c0") == F.col("c1"), F.lit(False)),
        "note too long": F.coalesce(F.length("c2") > 20, F.lit(False)),
    }
    found = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return table(spark, sf_dir, "term_bank").select("c0", F.explode(found).alias("fault"))


@query("""SELECT region_key, [x || '@' || sha256(coalesce(target_text, '')) FOR x IN coalesce(review, [])] AS carried FROM text_region""")
def carried_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = text_digest(F.coalesce("target_text", F.lit("")))
    return table(spark, sf_dir, "text_region").select("region_key", P.carried(F.col("review"), digest).alias("carried"))


@query(f"""WITH {PAGES}, l AS (SELECT series_id, chapter_no, page_id, max(received_at) AS at FROM worksheet GROUP BY ALL), d AS (SELECT series_id, chapter_no, page_id, max(detected_at) AS at FROM text_region GROUP BY ALL)
SELECT p.series_id, p.chapter_no, p.page_id, l.at IS NULL AS never_recorded FROM pages p JOIN d USING (series_id, chapter_no, page_id) LEFT JOIN l USING (series_id, chapter_no, page_id) WHERE l.at IS NULL OR l.at < d.at""")
def replies_older_than_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages answered before their regions were last detected, or never."""
    answered = table(spark, sf_dir, "worksheet").groupBy(*PAGE).agg(F.max("received_at").alias("at"))
    found = table(spark, sf_dir, "text_region").groupBy(*PAGE).agg(F.max("detected_at").alias("found"))
    df = pages(spark, sf_dir).select(*PAGE).join(found, PAGE).join(answered, PAGE, "left")
    return df.where("at is null or at < found").select(*PAGE, F.col("at").isNull().alias("never_recorded"))


@query(f"""WITH {REGIONS}, g AS (SELECT series_id, chapter_no, max(CASE WHEN is_translatable AND NOT has_target THEN 1 ELSE 0 END) AS open, count(*) FILTER (is_translatable AND NOT has_target) AS errors FROM flagged GROUP BY ALL)
SELECT series_id, chapter_no, open = 0 AS may_publish, errors FROM g""")
def publication_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = translatable() & ~has_text("target_text")
    df = regions(spark, sf_dir).groupBy(*UNIT).agg(F.count_if(hole).alias("errors"))
    return df.select(*UNIT, (F.col("errors") == 0).alias("may_publish"), "errors")


@query("""SELECT region_key FROM text_region WHERE regexp_matches(coalesce(source_text, ''), '(?i)\\blantern(es|s|ed|ing|d)?\\b')""")
def inflected_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase of the bank in whatever inflection; the pattern is made once, on the driver."""
    return table(spark, sf_dir, "text_region").where(F.coalesce("source_text", F.lit("")).rlike(P.inflected("lantern"))).select("region_key")


@query(f"""WITH {PAGES}, k AS (SELECT series_id, chapter_no, page_id, sha256 AS fingerprint FROM pages), r AS (SELECT series_id, chapter_no, page_id, CASE WHEN page_index % 7 = 0 THEN 'other' ELSE sha256 END AS fingerprint FROM pages WHERE page_index % 11 <> 0)
SELECT k.series_id, k.chapter_no, k.page_id, r.fingerprint IS NULL AS never_recorded FROM k LEFT JOIN r USING (series_id, chapter_no, page_id) WHERE k.fingerprint IS DISTINCT FROM r.fingerprint""")
def modified_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose bytes are no longer those recorded; the record of the sample is made from the pages' places."""
    now = pages(spark, sf_dir).withColumn("fingerprint", F.col("sha256"))
    was = now.where("page_index % 11 <> 0").withColumn("fingerprint", F.when(F.col("page_index") % 7 == 0, "other").otherwise(F.col("sha256")))
    return stale(now, was, PAGE)


@query("""WITH h AS (SELECT ws_key, unnest([x.c0 FOR x IN b IF contains(propose, string_split(x.c1, '/')[1])]) AS c0 FROM worksheet, (SELECT list({'c0': c0, 'c1': c1}) AS b FROM term_bank WHERE c1 IS NOT NULL) WHERE propose IS NOT NULL)
SELECT DISTINCT ws_key, c0 FROM h""")
def persian_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms whose first Persian alternative stands in a proposal; the bank is small by nature and is sent as a column."""
    bank = [(r.c0, r.c1.split("/")[0].strip()) for r in table(spark, sf_dir, "term_bank").where("c1 is not null").orderBy("c0").collect()]
    terms = F.array(*(F.struct(F.lit(a).alias("c0"), F.lit(b).alias("fa")) for a, b in bank))
    df = table(spark, sf_dir, "worksheet").where("propose is not null")
    found = F.filter(terms, lambda t: F.contains(F.col("propose"), t["fa"]))
    return df.select("ws_key", F.explode(F.transform(found, lambda t: t["c0"])).alias("c0")).distinct()


@query()
def prose_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that the normal form of Persian prose makes, per rule, the commonest first."""
    df = table(spark, sf_dir, "documents").where("text is not null")
    counted = df.select(F.explode(prose.edits_of("text")).alias("rule", "n")).groupBy("rule").agg(F.sum("n").alias("edits"), F.count("*").alias("documents"))
    return counted.orderBy(F.desc("edits"), "rule")


@query()
def prose_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").where("text is not null")
    return df.select(F.explode(prose.kinds_of("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
