"""Ordered content hashes and short identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_digest(text: Column, size: int = 64) -> Column:
    return F.left(F.sha2(text, 256), F.lit(size))


def identity(*parts: Column, size: int = 16) -> Column:
    """Digest of named or ordered parts; nulls count as empty."""
    return text_digest(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), size)


def region_line(box: str = "bbox") -> Column:
    """What a page's fingerprint takes of one region."""
    return F.concat_ws("|", F.col("id"), F.array_join(F.col(box), ","), F.col("kind"), F.col("orientation"))


def ordered(line: Column, *order: str) -> Column:
    """An aggregate: the lines of a group one after another, in an order that leaves no ties."""
    rows = F.collect_list(F.struct(*order, line.alias("line")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["line"]), "")
