"""Sinks: documents with an optimistic check, page packages, reply sheets, review documents.

A table of rows is written by Spark's own writers. A package is one file by nature, so each one is
built by a single task from its own pages and put in place by renaming; packages of different
chapters are built side by side.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Caps of a review document.
MOST_PAGES, MOST_REGIONS, MOST_CHARACTERS = 2_000, 20_000, 2_000_000


class Moved(Exception):
    """The file on disk is no longer the one that was read."""


def replace_bytes(path: str | Path, payload: bytes) -> str:
    """Write beside the target and rename; returns the hash of what is there."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, scratch = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(payload)
            out.flush()
            os.fsync(out.fileno())
        os.replace(scratch, path)
    except BaseException:
        Path(scratch).unlink(missing_ok=True)
        raise
    return hashlib.sha256(payload).hexdigest()


def save_document(df: DataFrame, path: str | Path, generation: str | None) -> str:
    """Write one document row as JSON, only if the file still has the hash it was read with."""
    path = Path(path)
    now = hashlib.sha256(path.read_bytes()).hexdigest() if path.exists() else None
    if now != generation:
        raise Moved(f"{path} changed since it was read")
    (row,) = df.select(F.to_json(F.struct(*df.columns)).alias("json")).take(2)
    return replace_bytes(path, row.json.encode())


def comic_info(meta: dict[str, str | None], pages: int) -> str:
    """XML beside the pages; empty fields are left out."""
    fields = {"Title": meta.get("title"), "Number": meta.get("chapter"), "LanguageISO": meta.get("target_language"), "PageCount": str(pages), "Manga": "YesAndRightToLeft" if meta.get("direction") == "rtl" else None}
    body = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in fields.items() if v)
    return f'<?xml version="1.0" encoding="utf-8"?><ComicInfo>{body}</ComicInfo>'


def package(pages: list[tuple[str, bytes]], meta: dict[str, str | None]) -> bytes:
    """A ZIP of pages in order; the same pages give the same bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        for name, data in [*pages, ("ComicInfo.xml", comic_info(meta, len(pages)).encode())]:
            archive.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def write_packages(pages: DataFrame, unit: list[str], folder: str) -> DataFrame:
    """One package per unit from rows (unit..., page_id, member, content); its manifest as rows.

    The folder must be one that all executors share. A unit's pages go to one task, as its package
    is one file; a chapter's size bounds them.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page_id")
        names = [f"{p}{Path(m).suffix.lower()}" for p, m in zip(pdf["page_id"], pdf["member"])]
        key = "-".join(re.sub(r"[^\w.-]", "_", str(pdf[u].iloc[0])) for u in unit)
        target = Path(folder) / f"{key}.cbz"
        replace_bytes(target, package(list(zip(names, map(bytes, pdf["content"]))), {"title": key}))
        hashes = [hashlib.sha256(bytes(c)).hexdigest() for c in pdf["content"]]
        return pd.DataFrame({"package": str(target), "name": names, "nr": range(len(names)), "sha256": hashes})

    return pages.select(*unit, "page_id", "member", "content").groupBy(*unit).applyInPandas(build, "package string, name string, nr int, sha256 string")


def write_folder(pages: DataFrame, folder: str) -> DataFrame:
    """Pages as files of a shared folder, each put in place by renaming; their manifest as rows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [f"{p}{Path(m).suffix.lower()}" for p, m in zip(pdf["page_id"], pdf["member"])]
            hashes = [replace_bytes(Path(folder) / n, bytes(c)) for n, c in zip(names, pdf["content"])]
            yield pd.DataFrame({"name": names, "sha256": hashes})

    return pages.select("page_id", "member", "content").mapInPandas(write, "name string, sha256 string")


def strangers(folder: str, expected: set[str]) -> list[str]:
    """Files of a folder that are none of ours, so that it must not be written over."""
    there = {p.name for p in Path(folder).iterdir()} if Path(folder).exists() else set()
    return sorted(there - expected)


def verify_packages(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest ⟗ members (package, name, nr, sha256): the verdict on each."""
    left = manifest.select("package", "name", F.col("nr").alias("nr_was"), F.col("sha256").alias("was"))
    right = found.select("package", "name", F.col("nr").alias("nr_now"), F.col("sha256").alias("now"))
    verdict = (
        F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unknown").when(F.col("was") != F.col("now"), "wrong bytes").when(F.col("nr_was") != F.col("nr_now"), "out of order").otherwise("ok")
    )
    return left.join(right, ["package", "name"], "full_outer").select("package", "name", verdict.alias("verdict"))


def worksheets(regions: DataFrame, page: list[str]) -> DataFrame:
    """One reply sheet per page as text: a header, then a block per region in order."""
    from glyphmill.functions.protocol import field_lines

    block = F.concat_ws(
        "\n",
        F.concat_ws(" ", F.lit("@@"), "id", "kind", "orientation"),
        field_lines("src", F.col("source_text")),
        field_lines("fa", F.col("target_text")),
        F.lit(""),
    )
    rows = regions.select(*page, F.struct(F.coalesce("reading_order", F.lit(1 << 30)).alias("o"), "region_key", block.alias("block")).alias("r"))
    sheet = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["block"]), "\n")
    return rows.groupBy(*page).agg(sheet.alias("body")).select(*page, F.concat(F.lit("# "), F.concat_ws(" ", *page), F.lit("\n\n"), "body").alias("sheet"))


def review_document(rows: list[tuple[str, str, str, str]], right_to_left: bool = True) -> bytes:
    """An editable table (page, region, source, target) as a word-processor file; caps are checked first."""
    if len({r[0] for r in rows}) > MOST_PAGES or len(rows) > MOST_REGIONS or sum(len(c) for r in rows for c in r) > MOST_CHARACTERS:
        raise ValueError("too much for one review document")
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    mark = "<w:pPr><w:bidi/></w:pPr>" if right_to_left else ""

    def cell(text: str, rtl: bool) -> str:
        kept = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
        return f'<w:tc><w:p>{mark if rtl else ""}<w:r><w:t xml:space="preserve">{escape(kept)}</w:t></w:r></w:p></w:tc>'

    body = "".join("<w:tr>" + "".join(cell(c, i == 3) for i, c in enumerate(r)) + "</w:tr>" for r in rows)
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="{word}"><w:body><w:tbl>{body}</w:tbl></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in parts.items():
            archive.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return out.getvalue()


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the packages of a folder, as ``verify_packages`` takes them."""
    from glyphmill.sources.readers import archive_pages

    pages = archive_pages(spark, folder).where("fault is null")
    return pages.select(F.regexp_replace("path", "^file:/*", "/").alias("package"), F.col("member").alias("name"), F.col("page_index").alias("nr"), "sha256")
