"""Line protocol of replies: escaping, splitting, flags, values that must fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that a reader would take for structure: a header, a comment, a field, or an escaped line.
STRUCTURE = r"^(?:@@|#(?:[ \t]|$)|\\|[a-z_]+:)"


def lines(text: Column) -> Column:
    """Lines cut at CR and LF only, not at other separators."""
    return F.split(text, "\r\n|\r|\n", -1)


def escaped(line: Column) -> Column:
    return F.when(line.rlike(STRUCTURE), F.concat(F.lit("\\"), line)).otherwise(line)


def unescaped(line: Column) -> Column:
    return F.when(line.startswith("\\"), F.substring(line, 2, 1_000_000_000)).otherwise(line)


def field_lines(name: str, value: Column) -> Column:
    """`name: first line` and the further lines, escaped."""
    parts = lines(F.coalesce(value, F.lit("")))
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, F.concat(F.lit(f"{name}: "), p)).otherwise(escaped(p))), "\n")


def asked(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("yes", "true", "1")


def tri_state(given: Column, value: Column, old: Column) -> Column:
    """Not given keeps the old value, a blank one clears it, any other sets it."""
    return F.when(~given, old).when(F.trim(F.coalesce(value, F.lit(""))) == "", F.lit(None)).otherwise(value)


def id_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def page_id(ordinal: Column) -> Column:
    return F.format_string("p%04d", (ordinal + 1).cast("long"))


def region_id(page: Column, ordinal: Column) -> Column:
    return F.format_string("%sr%03d", page, ordinal.cast("long"))


def natural_key(name: Column, width: int = 20) -> Column:
    """A sort key in which runs of digits compare as numbers: each is padded with zeros."""
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def valid_confidence(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & value.between(0.0, 1.0), F.lit(False))


def fitted(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def right_to_left(text: Column) -> Column:
    """The direction of a paragraph: that of its first strong letter."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"([A-Za-z\x{00C0}-\x{024F}]|[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}])", 1)
    return first.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")


def fitted_prefix(values: Column, limit: int) -> Column:
    """The longest prefix of an array of texts whose JSON is at most ``limit`` characters long.

    Of `["a", "b"]` every value costs its length, two quotes and the separator before it.
    """
    start = F.struct(F.lit(2).alias("size"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def step(state: Column, value: Column) -> Column:
        size = state["size"] + F.length(F.to_json(F.array(value))) - 2 + F.when(state["kept"] > 0, 2).otherwise(0)
        fits = state["open"] & (size <= limit)
        return F.struct(F.when(fits, size).otherwise(state["size"]).cast("int").alias("size"), (state["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    return F.slice(values, F.lit(1), F.aggregate(values, start, step)["kept"])


def tokens_per_line(text: Column) -> Column:
    """Words of each hard line."""
    return F.transform(lines(F.coalesce(text, F.lit(""))), lambda line: F.filter(F.split(line, r"[ \t]+"), lambda w: w != ""))


def directional_runs(text: Column) -> Column:
    """The text cut into runs of letters that are read the same way, other signs with the run before."""
    right = r"\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"((?:[{right}][^A-Za-z\x{{00C0}}-\x{{024F}}]*)+|[^{right}]+)"), F.lit(1))


def page_source(final: Column, clean: Column, image: Column, there: Column) -> Column:
    """The most finished file of a page that ``there``, an array of names, holds."""
    return F.coalesce(*(F.when(F.array_contains(there, c), c) for c in (final, clean, image)))
