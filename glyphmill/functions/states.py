"""What is owed to a region, who owns its pixels, and which terminal state it reached.

All are plain conditions over one row, so they stay inside whole-stage code generation and can be
pushed into other filters. Null flags mean no, a null policy means `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATES = ["translated", "kept_by_policy", "erased", "dropped_false_detection", "needs_review", "unresolved"]
ARTIFACTS = ["image", "clean", "final"]


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def stripped(text: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)\A\s++|\s++\z", "")


def has_text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).rlike(r"(?U)\S")


def translatable(policy: str = "policy") -> Column:
    lettered = F.coalesce(F.col("kind") != "sfx", F.lit(True)) | F.coalesce(F.col(policy), F.lit("keep")).isin("translate", "bilingual", "annotate")
    return ~_yes("dropped") & ~_yes("keep") & ~_yes("erase") & lettered


def may_be_edited(policy: str = "policy") -> Column:
    drawn = F.coalesce(F.col("kind") == "sfx", F.lit(False)) & F.coalesce(F.col(policy), F.lit("keep")).isin("keep", "bilingual", "annotate")
    return _yes("erase") | (~_yes("dropped") & ~_yes("keep") & ~drawn)


def repaired() -> Column:
    return ~F.coalesce(F.col("fill"), F.lit("none")).isin("none", "keep")


def region_state(policy: str = "policy") -> Column:
    reviewed = F.coalesce(F.size("review") > 0, F.lit(False))
    return (
        F.when(_yes("dropped"), "dropped_false_detection")
        .when(_yes("erase"), F.when(repaired(), "erased").otherwise("needs_review"))
        .when(~translatable(policy), "kept_by_policy")
        .when(has_text("target_text"), "translated")
        .when(reviewed, "needs_review")
        .otherwise("unresolved")
    )


def required_artifact(policy: str = "policy") -> Column:
    """An aggregate: the least finished artifact that a page of these regions may ship."""
    live = ~_yes("dropped")
    rank = F.when(live & translatable(policy) & has_text("target_text"), 2).when(live & repaired(), 1).otherwise(0)
    return F.get(F.array(*map(F.lit, ARTIFACTS)), F.max(rank))
