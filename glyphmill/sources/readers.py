"""Sources: page containers, image folders, term banks, documents, cases, reply files.

Everything starts at Spark's own file sources, so listing, splitting and retries are Spark's;
only the inside of a ZIP is read by a Python function, one archive to a row.

Limits are checked before a member is unpacked, and counted again while it is. RAR and PDF need
decoders that are not here: such files are named and refused when read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.protocol import natural_key

# Suffixes, and limits of a container.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "gif", "tif", "tiff")
MOST_MEMBERS, MOST_BYTES, MOST_TOTAL, MOST_RATIO, MOST_PIXELS = 2_000, 512 << 20, 2 << 30, 250, 80_000_000


def source_kind(path: Column, head: Column) -> Column:
    """What a file is, by its suffix, else by its first bytes."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    magic = F.hex(F.substring(head, 1, 4))
    return (
        F.when(suffix.isin("cbz", "zip"), "zip")
        .when(suffix.isin("cbr", "rar"), "rar")
        .when(suffix == "pdf", "pdf")
        .when(suffix.isin(*IMAGES), "image")
        .when(magic == "504B0304", "zip")
        .when(magic == "25504446", "pdf")
        .when(magic == "52617221", "rar")
        .otherwise("unknown")
    )


def junk(name: Column) -> Column:
    """Members that an operating system leaves behind."""
    low, last = F.lower(name), F.lower(F.element_at(F.split(name, "/"), -1))
    return low.startswith("__macosx/") | last.startswith("._") | last.isin(".ds_store", "thumbs.db", "desktop.ini") | last.startswith(".")


def is_image(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin(*IMAGES)


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path``, ``length``, ``content`` and ``kind`` of each file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return df.withColumn("kind", source_kind(F.col("path"), F.col("content")))


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the head of a PNG, GIF, BMP or JPEG, without decoding it."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return struct.unpack(">II", content[16:24])
    if content[:4] == b"GIF8" and len(content) >= 10:
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            mark, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def _natural(name: str) -> list:
    return [(1, int(p), "") if p.isdigit() else (0, 0, p) for p in re.findall(r"\d+|\D+", name.lower())]


def _junk(name: str) -> bool:
    low = name.lower()
    return low.startswith("__macosx/") or low.rsplit("/", 1)[-1].startswith(".") or low.rsplit("/", 1)[-1] in ("thumbs.db", "desktop.ini")


def zip_pages(content: bytes) -> list[dict]:
    """The images of an archive in natural order; a ValueError names the first broken limit."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = [m for m in archive.infolist() if not m.is_dir() and not _junk(m.filename) and m.filename.lower().rsplit(".", 1)[-1] in IMAGES]
        if len(members) > MOST_MEMBERS:
            raise ValueError("too many members")
        total, names = 0, set()
        for m in members:
            total += m.file_size
            if m.file_size > MOST_BYTES or total > MOST_TOTAL:
                raise ValueError(f"too large: {m.filename}")
            if m.file_size > MOST_RATIO * max(1, m.compress_size):
                raise ValueError(f"packed too tightly: {m.filename}")
            if m.filename in names:
                raise ValueError(f"named twice: {m.filename}")
            names.add(m.filename)
        pages = []
        for i, m in enumerate(sorted(members, key=lambda m: (_natural(m.filename), m.filename))):
            with archive.open(m) as member:
                data = member.read(m.file_size + 1)
            if len(data) > m.file_size:
                raise ValueError(f"longer than stated: {m.filename}")
            w, h = image_size(data) or (None, None)
            if w and h and w * h > MOST_PIXELS:
                raise ValueError(f"too many pixels: {m.filename}")
            pages.append({"page_id": f"p{i + 1:04d}", "page_index": i, "member": m.filename, "sha256": hashlib.sha256(data).hexdigest(), "width": w, "height": h, "bytes": len(data), "content": data})
        return pages


PAGES = [("page_id", pa.string()), ("page_index", pa.int32()), ("member", pa.string()), ("sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bytes", pa.int64()), ("content", pa.binary())]


def archive_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of every ZIP container under a path; one whose limits break gives one row with ``fault``."""
    found = files(spark, path).where("kind in ('zip', 'rar', 'pdf')").select("path", "kind", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("path", pa.string()), *PAGES, ("fault", pa.string())])
        for batch in batches:
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = zip_pages(content) if kind == "zip" else [{"fault": f"no reader for {kind}"}]
                except (ValueError, zipfile.BadZipFile) as fault:
                    rows = [{"fault": str(fault)}]
                yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in rows], schema=fields)

    kinds = "page_id string, page_index int, member string, sha256 string, width int, height int, bytes long, content binary"
    return found.mapInArrow(run, f"path string, {kinds}, fault string")


def folder_pages(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, most_total: int = MOST_TOTAL) -> DataFrame:
    """Pages of each folder of images, in natural order; too large a file, or folder, raises when read."""
    from pyspark.sql import Window

    df = files(spark, path).where("kind = 'image'").withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    df = df.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~junk(F.col("name")))
    order = Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")
    running = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"page_index": F.row_number().over(order) - 1, "running": running})
    over = (F.col("length") > most_bytes) | (F.col("running") > most_total)
    checked = F.when(over, F.raise_error(F.concat(F.lit("over the limit: "), "path"))).otherwise(F.sha2("content", 256))
    return df.select("folder", "name", "page_index", F.format_string("p%04d", F.col("page_index") + 1).alias("page_id"), "length", checked.alias("sha256"))


def term_bank(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated bank without a header: en, fa, note; comments and short rows are left out."""
    schema = "en string, fa string, note string"
    return spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="").where("trim(en) <> '' and trim(fa) <> ''")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON files `{"cases": [...]}`."""
    case = "struct<id:string,language:string,source:string,gloss:string,difficulty:array<string>,units:int,accept:array<string>,balloon:array<double>,must_preserve:struct<negation:boolean,terms:array<string>,ellipsis:boolean>,human_only:boolean,human_note:string,context:string>"
    read = spark.read.schema(f"cases array<{case}>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return read.select(F.explode("cases").alias("c")).select("c.*")


REGION = "id string, bbox array<int>, kind string, orientation string, reading_order int, panel string, speaker string, source_text string, target_text string, target_full string, detector string, confidence double, fill string, clean_status string, polarity string, locked boolean, dropped boolean, keep boolean, erase boolean, proposed array<string>, review array<string>"
DOCUMENT = f"version int, meta struct<title:string,chapter:string,source_language:string,target_language:string,sfx_policy:string>, pages array<struct<id:string,index:int,image:string,sha256:string,width:int,height:int,panels:array<struct<id:string,bbox:array<int>>>,regions:array<struct<{', '.join(':'.join(f.split()) for f in REGION.split(', '))}>>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents with the hash of their bytes; any version but 1 raises when read."""
    df = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    checked = F.when(F.col("version") == 1, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unknown version in "), "path")))
    hashes = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("generation"))
    return df.withColumn("version", checked).join(hashes, "path")


def document_regions(df: DataFrame) -> DataFrame:
    """Every region of nested documents, in document order: ``page_pos`` and ``region_pos`` hold it."""
    pages = df.select("path", F.col("meta.sfx_policy").alias("policy"), F.posexplode("pages").alias("page_pos", "page"))
    flat = pages.select("path", "policy", "page_pos", F.col("page.id").alias("page_id"), F.posexplode("page.regions").alias("region_pos", "region"))
    return flat.select("path", "policy", "page_pos", "page_id", "region_pos", "region.*")


def reply_files(spark: SparkSession, path: str) -> DataFrame:
    """Reply files, whole: ``path`` and ``value``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def json_records(df: DataFrame, text: str, schema: str) -> DataFrame:
    """``record`` of each JSON text, and ``fault`` where it does not parse strictly.

    Figures that JSON has no room for and nesting beyond 128 levels are faults.
    """
    depth = F.aggregate(
        F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', ""), F.lit(r"([\[{\]}])"), F.lit(1)),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most")),
    )["most"]
    strict = F.from_json(text, T._parse_datatype_string(schema), {"mode": "PERMISSIVE", "allowNonNumericNumbers": "false"})
    parsed = df.withColumn("record", strict)
    fault = F.when(F.col(text).isNull(), "empty").when(depth > 128, "too deep").when(F.try_parse_json(text).isNull(), "no JSON")
    return parsed.withColumn("fault", fault).withColumn("record", F.when(F.col("fault").isNull(), F.col("record")))


def term_records(df: DataFrame, text: str) -> DataFrame:
    """Terms of JSON objects `{term: target or {target, locked, aliases, note}}`, one row each, with the fault of a bad one."""
    entry = F.expr(f"explode(from_json({text}, 'map<string,string>'))")
    rows = df.select(entry).toDF("term", "value")
    made = F.from_json("value", "target string, locked boolean, aliases array<string>, note string")
    is_record = F.col("value").startswith("{")
    target = F.when(is_record, made["target"]).otherwise(F.col("value"))
    fault = F.when(F.trim("term") == "", "no term").when(F.col("value").isNull() | (F.trim(target) == ""), "no target").when(target.isNull(), "no target")
    return rows.select("term", target.alias("target"), F.when(is_record, made["locked"]).otherwise(F.lit(False)).alias("locked"), F.when(is_record, made["aliases"]).alias("aliases"), fault.alias("fault"))


def frames(stream: io.BufferedIOBase, limit: int = 1 << 20) -> Iterator[tuple[str | None, str | None]]:
    """Lines of a byte stream as (text, fault); one over the limit is passed over and reported."""
    while line := stream.readline(limit + 1):
        if len(line) > limit and not line.endswith(b"\n"):
            while line and not line.endswith(b"\n"):
                line = stream.readline(limit)
            yield None, "too long"
            continue
        try:
            yield line.rstrip(b"\r\n").decode("utf-8", "strict"), None
        except UnicodeDecodeError:
            yield None, "not UTF-8"
