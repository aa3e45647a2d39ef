"""Replies: the line protocol as rows, joining replies to regions, merging all of a page or none.

The parser is a fold over the lines of one file, so files are the unit of parallel work; the join
and the merge are plain joins and conditions over all replies at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.states import has_text
from glyphmill.operators.windows import latest

# The fields of a reply block.
FIELDS = {"kind", "orientation", "speaker", "src", "fa", "full", "drop", "keep", "erase", "box", "polarity", "propose", "note", "review", "ack"}
REPEATED = {"note"}
HEADER = re.compile(r"@@\s+(?:(p\d+)\s+)?(\+?[\w-]+)(.*)$")
FIELD = re.compile(r"([a-z]+):(?:[ \t]?(.*))$")


def parse_reply(text: str | None) -> list[dict]:
    """One row per field: region, how often its block began, field, value, whether given before.

    Lines before the first header are ignored, as are comments; a backslash takes the structure
    from a line; blank lines inside a value stay only if more of it follows.
    """
    blocks: dict[str, dict] = {}
    region = field = None
    for line in re.split("\r\n|\r|\n", text or ""):
        if line.startswith("\\"):
            if region and field:
                blocks[region]["fields"][field][-1].append(line[1:])
        elif m := HEADER.match(line):
            region, field = m[2], None
            block = blocks.setdefault(region, {"seen": 0, "fields": {}})
            block["seen"] += 1
        elif re.match(r"#(?:[ \t]|$)", line) or region is None:
            continue
        elif (m := FIELD.match(line)) and m[1] in FIELDS:
            field = m[1]
            blocks[region]["fields"].setdefault(field, []).append([m[2] or ""])
        elif field:
            blocks[region]["fields"][field][-1].append(line)
    rows = []
    for region, block in blocks.items():
        for field, values in block["fields"].items():
            shown = ["\n".join(v).strip() for v in values]
            rows.append({"region_id": region, "seen": block["seen"], "field": field, "values": shown if field in REPEATED else shown[:1], "repeated": field not in REPEATED and len(shown) > 1})
        if not block["fields"]:
            rows.append({"region_id": region, "seen": block["seen"], "field": None, "values": [], "repeated": False})
    return rows


def parse_replies(files: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``parse_reply`` for every file of a table (key, text)."""
    fields = [("region_id", pa.string()), ("seen", pa.int32()), ("field", pa.string()), ("values", pa.list_(pa.string())), ("repeated", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                made = parse_reply(value)
                at += [i] * len(made)
                rows += made
            made = pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made.columns], names=[key, *made.schema.names])

    return files.select(key, text).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, region_id string, seen int, field string, values array<string>, repeated boolean")


def newest(worksheet: DataFrame) -> DataFrame:
    """The last reply to each region; of replies received together, the one with the larger key."""
    return latest(worksheet.where("region_key is not null"), ["region_key"], [F.desc("received_at"), F.desc("ws_key")])


def match(regions: DataFrame, replies: DataFrame) -> DataFrame:
    """Regions ⟗ newest replies with the outcome of each."""
    left = regions.select(F.col("region_key"), F.lit(True).alias("there"))
    right = newest(replies).select("region_key", "fa", "answer", F.lit(True).alias("replied"))
    outcome = (
        F.when(F.col("there").isNull(), "unknown_region")
        .when(F.col("replied").isNull(), "missing")
        .when(F.col("answer").isNotNull(), F.col("answer"))
        .when(~has_text("fa"), "empty_translation")
        .otherwise("translated")
    )
    return left.join(right, "region_key", "full_outer").withColumn("outcome", outcome)


def bad_fields(kind: Column, answer: Column, seen: Column) -> Column:
    """Names of the fields that hold no value of their domain."""
    wrong = {
        "kind": ~F.lower(F.trim(kind)).isin("speech", "thought", "narration", "sfx", "sign", "unknown"),
        "answer": ~answer.isin("drop", "keep", "erase"),
        "seen": seen < 1,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for n, w in wrong.items())))


def merge(regions: DataFrame, replies: DataFrame, page: list[str]) -> DataFrame:
    """Regions with the replies applied, page by page all or none.

    A page is refused if any of its replies names an unknown region or holds a value outside its
    domain. Of a page that is not refused: an answer sets its flag and clears the others, a text
    fills or replaces the target unless the region is locked with another text.
    """
    new = newest(replies).select("region_key", *[F.col(p).alias(f"_{p}") for p in page], "fa", "answer", "kind", "seen")
    checked = new.join(regions.select("region_key", F.lit(True).alias("there")), "region_key", "left")
    refusal = F.col("there").isNull() | (F.size(bad_fields(F.col("kind"), F.col("answer"), F.col("seen"))) > 0)
    refused = checked.groupBy(*[f"_{p}" for p in page]).agg(F.max(refusal.cast("int")).alias("refused")).withColumnsRenamed({f"_{p}": p for p in page})
    joined = regions.join(new.select("region_key", F.col("fa"), F.col("answer")), "region_key", "left").join(refused, page, "left")
    applies = (F.coalesce("refused", F.lit(0)) == 0) & (F.col("answer").isNotNull() | has_text("fa"))
    text = applies & F.col("answer").isNull()
    free = ~(F.coalesce("locked", F.lit(False)) & has_text("target_text") & ~F.col("target_text").eqNullSafe(F.col("fa")))
    out = {"target_text": F.when(text & free, F.col("fa")).otherwise(F.col("target_text"))}
    for name, value in (("dropped", "drop"), ("keep", "keep"), ("erase", "erase")):
        out[name] = F.when(applies, F.coalesce(F.col("answer") == value, F.lit(False))).otherwise(F.coalesce(name, F.lit(False)))
    outcome = (
        F.when(F.coalesce("refused", F.lit(0)) == 1, "page_refused").when(~applies, "unchanged").when(F.col("answer").isNotNull(), "answered").when(~free, "locked").otherwise("applied")
    )
    return joined.withColumns({**out, "outcome": outcome})


def apply_results(df: DataFrame, current: str, given: str, confidence: str, locked: str, floor: float = 0.65) -> DataFrame:
    """``df`` with ``outcome`` and ``result``: a machine's value fills holes only.

    A low confidence is reviewed before a lock is looked at; a value that differs from one that is
    there, or from a locked hole, is reviewed; the same value, or none, leaves things as they are.
    """
    has, gives, lock = has_text(current), has_text(given), F.coalesce(F.col(locked), F.lit(False))
    outcome = (
        F.when(F.coalesce(F.col(confidence), F.lit(1.0)) < floor, "needs_review")
        .when(gives & (has | lock) & ~F.col(given).eqNullSafe(F.col(current)), "needs_review")
        .when(lock, "locked")
        .when(has, "unchanged")
        .when(~gives, "failed")
        .otherwise("applied")
    )
    return df.withColumn("outcome", outcome).withColumn("result", F.when(F.col("outcome") == "applied", F.col(given)).otherwise(F.col(current)))


def corrected(regions: DataFrame, corrections: DataFrame, width: Column, height: Column) -> DataFrame:
    """``regions`` with new boxes and polarities (region_key, box, polarity), cut to their page.

    What was derived from a box that moved is cleared: fill and clean_status.
    """
    from glyphmill.functions.boxes import clamp

    new = corrections.select("region_key", F.col("box").alias("_box"), F.col("polarity").alias("_polarity"))
    joined = regions.join(new, "region_key", "left")
    box = F.when(F.col("_box").isNotNull(), clamp(F.col("_box"), width, height)).otherwise(F.col("bbox").cast("array<bigint>"))
    moved = ~box.eqNullSafe(F.col("bbox").cast("array<bigint>")) | F.coalesce(F.col("_polarity") != F.col("polarity"), F.lit(False))
    out = {"fill": F.when(~moved, F.col("fill")), "clean_status": F.when(~moved, F.col("clean_status")), "bbox": box.cast("array<int>"), "polarity": F.coalesce("_polarity", "polarity")}
    return joined.withColumns(out).drop("_box", "_polarity")


def add_regions(regions: DataFrame, added: DataFrame, page: list[str]) -> DataFrame:
    """``regions`` (page..., added_as, target_text) with those that readers added, updated by slug or appended."""
    new = added.select(*page, F.col("slug").alias("added_as"), F.col("fa").alias("_fa"))
    joined = regions.where("added_as is not null").join(new, [*page, "added_as"], "full_outer")
    updated = joined.withColumn("target_text", F.coalesce("_fa", "target_text")).drop("_fa")
    return regions.where("added_as is null").unionByName(updated, allowMissingColumns=True)


def stamped(recorded: DataFrame, done: DataFrame, pages: DataFrame, stage: str, page: list[str]) -> DataFrame:
    """``recorded`` (page..., stage, revision) after a stage ran on ``done`` (page..., revision).

    Pages run again get the new revision, pages that are gone are dropped, all else stays.
    """
    new = done.select(*page, F.lit(stage).alias("stage"), F.col("revision").alias("_new"))
    joined = recorded.join(new, [*page, "stage"], "full_outer").withColumn("revision", F.coalesce("_new", "revision")).drop("_new")
    return joined.join(pages.select(*page).distinct(), page, "left_semi")
