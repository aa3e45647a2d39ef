"""Standing decisions of a document: title policy, effects policy, acknowledgements, inflected phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys of a title policy, and the policies for sound effects.
TITLE_KEYS = ("original", "persian", "romanized", "display", "subtitle", "note")
SFX_POLICIES = ("keep", "translate", "bilingual", "annotate")


def title_policy(policy: Column) -> Column:
    """The known keys of a map that hold more than white space."""
    return F.map_filter(policy, lambda k, v: k.isin(*TITLE_KEYS) & F.coalesce(v, F.lit("")).rlike(r"(?U)\S"))


def sfx_conflict(prose: Column, policy: Column) -> Column:
    """The first other policy that a prose names while it does not name the one in force; else null."""
    text, own = F.lower(F.coalesce(prose, F.lit(""))), F.coalesce(policy, F.lit("keep"))
    named = F.filter(F.array(*map(F.lit, SFX_POLICIES)), lambda p: F.contains(text, p))
    return F.when(~F.contains(text, own), F.get(named, F.lit(0)))


def settled(code: str, acknowledged: Column, same_text: Column, spans: Column, span: Column) -> Column:
    """Whether a reader settled ``code`` for this very text and span; without recorded spans the code alone counts."""
    return F.coalesce(F.array_contains(acknowledged, code), F.lit(False)) & F.coalesce(same_text, F.lit(True)) & (spans.isNull() | span.isNull() | F.coalesce(F.array_contains(spans, span), F.lit(False)))


def carried(acknowledged: Column, digest: Column) -> Column:
    """Acknowledgements with the digest of the text they were about."""
    return F.transform(F.coalesce(acknowledged, F.array().cast("array<string>")), lambda c: F.concat_ws("@", c, digest))


def inflected(phrase: str) -> str:
    """A pattern of a phrase whose last word may be inflected; an acronym stands as it is, in its case."""
    words = phrase.split()
    last = "" if len(words[-1]) <= 2 or words[-1].isupper() else "(?:es|s|ed|ing|d)?"
    case = "" if words[-1].isupper() else "(?i)"
    return rf"{case}\b{r'\s+'.join(map(re.escape, words))}{last}\b"


def first_alternative(text: Column) -> Column:
    return F.trim(F.get(F.split(text, "/"), F.lit(0)))
