"""Records of reply exports: why a broken one is broken, and the valid ones as typed rows.

A recursive-descent parser reads

    record = field { "," field }
    field  = quoted | plain
    quoted = '"' { any but '"' | '""' } '"'
    plain  = { any but '"' and "," }

and goes on after an error: broken quoting is located, and parsing resumes at the next validated
record start, a line that begins with a page and a region id. A cell of the table is meant to hold
one record, so the error first in rank (quoting, columns, values) is the reason of the whole cell;
records that parse well after a broken one come out as rows all the same.

Defined results: a null cell holds no fields and is broken by its `columns`; blank means nothing but
Unicode white space; the control characters allowed in a text are tab, line feed and carriage
return; line ends outside quotes belong to a plain field; of repeated cells each comes out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

NAMES = ["page_id", "region_id", "seen", "kind", "speaker", "src", "fa", "answer", "submitted_at"]
KINDS = {"speech", "thought", "narration", "sfx", "sign", "unknown"}
ANSWERS = {"", "drop", "keep", "erase"}
PAGE = re.compile(r"p[0-9]{4}")
REGION = re.compile(r"p[0-9]{4}r[0-9]{3}|\+[a-z0-9]+")
SEEN = re.compile(r"[1-9][0-9]*")
TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}")
BAD = re.compile("[\\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]")
#: A record's first two fields after a line end, as typed plainly.
ANCHOR = re.compile(r"\r?\n(?=p[0-9]{4},(?:p[0-9]{4}r[0-9]{3}|\+[a-z0-9]+),)")
PLAIN = re.compile(r'[^",]*')
QUOTED = re.compile(r'[^"]*')
#: White space as Unicode has it; U+001C to U+001F are controls and no space.
SPACE = " \t\n\x0b\x0c\r\x85\xa0                　"
RANK = {"quoting": 0, "columns": 1, "values": 2}


class Fault(NamedTuple):
    reason: str
    at: int
    detail: str


class Broken(Exception):
    """Quoting that cannot be read on from."""


class Parser:
    """Parses one cell; ``at`` is the place of the next character."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def records(self) -> Iterator[tuple[list[str], int, list[Fault]]]:
        """Fields, start and faults of each record."""
        while True:
            start, faults, fields = self.at, [], []
            try:
                fields = self.record()
            except Broken as fault:
                faults.append(Fault("quoting", self.at, str(fault)))
                self.resume()
            yield fields, start, faults
            if self.at >= len(self.text):
                return

    def resume(self) -> None:
        """Go to the next record start after the fault, or to the end."""
        anchor = ANCHOR.search(self.text, self.at)
        self.at = anchor.end() if anchor else len(self.text)

    def record(self) -> list[str]:
        fields = [self.field()]
        while self.text.startswith(",", self.at):
            self.at += 1
            fields.append(self.field())
        return fields

    def field(self) -> str:
        return self.quoted() if self.text.startswith('"', self.at) else self.plain()

    def quoted(self) -> str:
        at, parts = self.at + 1, []
        while True:
            run = QUOTED.match(self.text, at)
            parts.append(run[0])
            at = run.end() + 1
            if run.end() == len(self.text):
                raise Broken("a quoted field is not closed")
            if not self.text.startswith('"', at):
                break
            parts.append('"')
            at += 1
        self.at = at
        if at < len(self.text) and self.text[at] != ",":
            raise Broken("text after a closing quote")
        return "".join(parts)

    def plain(self) -> str:
        found = PLAIN.match(self.text, self.at)
        self.at = found.end()
        if self.text.startswith('"', self.at):
            raise Broken("a quote inside a plain field")
        return found[0]


def wrong_values(fields: list[str]) -> Iterator[tuple[str, str]]:
    """Name and fault of each field that holds no valid value."""
    page, region, seen, kind, _, src, fa, answer, when = fields
    for name, pattern, value in (("page_id", PAGE, page), ("region_id", REGION, region), ("seen", SEEN, seen)):
        if not pattern.fullmatch(value):
            yield name, "not in the form of one"
    if kind.strip(SPACE).lower() not in KINDS:
        yield "kind", "no known kind"
    if answer not in ANSWERS:
        yield "answer", "no known answer"
    if parse_time(when) is None:
        yield "submitted_at", "no real time"
    for name, value in (("src", src), ("fa", fa)):
        if not answer and not value.strip(SPACE):
            yield name, "blank without an answer"
        if BAD.search(value):
            yield name, "a replacement or control character"


def parse_time(text: str) -> datetime | None:
    if not TIME.fullmatch(text):
        return None
    try:
        return datetime.strptime(text, "%Y-%m-%d %H:%M:%S")
    except ValueError:
        return None


def typed(fields: list[str]) -> dict:
    """Kind trimmed and lower case, an empty answer null, ``seen`` null beyond the widest exact type."""
    row = dict(zip(NAMES, fields, strict=True))
    row["seen"] = Decimal(row["seen"]) if len(row["seen"]) <= 38 else None
    row["kind"] = row["kind"].strip(SPACE).lower()
    row["answer"] = row["answer"] or None
    row["submitted_at"] = parse_time(row["submitted_at"])
    return row


def read(text: str | None) -> tuple[list[dict], list[Fault]]:
    """Typed valid records and located faults of a cell."""
    if text is None:
        return [], [Fault("columns", 0, "no record")]
    rows, faults = [], []
    parser = Parser(text)
    for number, (fields, start, broken) in enumerate(parser.records()):
        if number and not broken and not faults:
            faults.append(Fault("columns", start, "a second record"))
        if not broken and len(fields) != len(NAMES):
            broken = [Fault("columns", start, f"{len(fields)} fields")]
        if not broken:
            broken = [Fault("values", start, f"{name}: {what}") for name, what in wrong_values(fields)]
        faults += broken
        if not broken:
            rows.append({"record_no": number + 1, **typed(fields)})
    return rows, faults


TYPES = [
    ("record_no", pa.int32(), "int"), ("page_id", pa.string(), "string"), ("region_id", pa.string(), "string"), ("seen", pa.decimal128(38, 0), "decimal(38,0)"),
    ("kind", pa.string(), "string"), ("speaker", pa.string(), "string"), ("src", pa.string(), "string"), ("fa", pa.string(), "string"),
    ("answer", pa.string(), "string"), ("submitted_at", pa.timestamp("us"), "timestamp_ntz"),
]
RECORD = pa.struct([(n, t) for n, t, _ in TYPES])
FAULT = pa.struct([("reason", pa.string()), ("at", pa.int32()), ("detail", pa.string())])


def records(df: DataFrame, key: str = "raw_key", raw: str = "raw_line") -> DataFrame:
    """``key``, ``rows`` and ``faults`` of every cell: its valid records, typed, and its located faults."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, faults = [], []
            for text in batch.column(1).to_pylist():
                good, bad = read(text)
                rows.append(good)
                faults.append([f._asdict() for f in bad])
            columns = [batch.column(0), pa.array(rows, pa.list_(RECORD)), pa.array(faults, pa.list_(FAULT))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "rows", "faults"])

    kind = dict(df.dtypes)[key]
    record = ", ".join(f"{n}: {t}" for n, _, t in TYPES)
    return df.select(key, raw).mapInArrow(run, f"{key} {kind}, rows array<struct<{record}>>, faults array<struct<reason: string, at: int, detail: string>>")


def broken_records(df: DataFrame, key: str = "raw_key", raw: str = "raw_line") -> DataFrame:
    """``key`` and ``reason`` of every broken cell; the reason first in rank."""
    reason = "case when exists(faults, f -> f.reason = 'quoting') then 'quoting' when exists(faults, f -> f.reason = 'columns') then 'columns' else 'values' end"
    return records(df, key, raw).where("size(faults) > 0").selectExpr(f"`{key}`", f"{reason} as reason")


def located_faults(df: DataFrame, key: str = "raw_key", raw: str = "raw_line") -> DataFrame:
    """Each fault with its place, a character offset in the cell."""
    return records(df, key, raw).selectExpr(f"`{key}`", "inline(faults)")


def valid_records(df: DataFrame, key: str = "raw_key", raw: str = "raw_line") -> DataFrame:
    """Every valid record as a typed row, also those that stand beside a broken one."""
    return records(df, key, raw).selectExpr(f"`{key}`", "inline(rows)")
