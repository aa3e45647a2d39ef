"""Terms in texts: mentions, drift from approved forms, versioned upserts.

A term is looked for by its first word: texts are cut into words once, words meet the terms that
begin with them in an equi-join, and the whole form is then checked at that place. No text meets a
term whose first word it does not hold, and a word of a third of all texts is shared out by salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.states import stripped

WORD = r"[\p{L}\p{M}\p{N}\x{200C}]+"
SALTS = 8


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def mentions(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """``key`` and ``term`` for each term one of whose forms stands in a text, between word bounds.

    ``terms`` holds term and form; a form is one or more words.
    """
    forms = terms.select("term", words(F.col("form")).alias("fw")).where("size(fw) > 0").withColumn("word", F.get("fw", F.lit(0)))
    forms = forms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = texts.select(key, words(F.coalesce(text, F.lit(""))).alias("w")).where("size(w) > 0")
    held = held.select(key, "w", F.posexplode("w").alias("at", "word")).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    met = held.join(forms, ["word", "salt"])
    return met.where(F.slice("w", F.col("at") + 1, F.size("fw")) == F.col("fw")).select(key, "term").distinct()


def drift(texts: DataFrame, key: str, source: str, target: str, terms: DataFrame) -> DataFrame:
    """Texts whose source mentions a term while their target holds none of its approved forms.

    ``terms`` holds term, form (how the source writes it) and target (an approved form), one row
    for each pair of them.
    """
    said = mentions(texts, key, source, terms.select("term", "form").distinct())
    approved = mentions(texts, key, target, terms.select("term", F.col("target").alias("form")).distinct())
    return said.join(approved, [key, "term"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``old`` (key, value, locked, version, previous) with the values of ``new`` (key, value).

    A locked value that changes goes into ``previous`` with its version, and the version rises; an
    unlocked one is replaced; a blank new value changes nothing. Keys must be unique on each side.
    """
    joined = old.join(new.select(key, F.col(value).alias("_new")), key, "full_outer")
    given = F.coalesce(stripped("_new") != "", F.lit(False))
    changed = given & ~F.col(value).eqNullSafe(F.col("_new"))
    kept = changed & F.coalesce("locked", F.lit(False)) & F.coalesce(F.col(value) != "", F.lit(False))
    entry = F.struct(F.col(value).alias("target"), F.coalesce("version", F.lit(1)).alias("version"))
    history = F.coalesce("previous", F.array().cast("array<struct<target:string,version:int>>"))
    return joined.select(
        key,
        F.when(given, F.col("_new")).otherwise(F.col(value)).alias(value),
        F.coalesce("locked", F.lit(False)).alias("locked"),
        (F.coalesce("version", F.lit(1)) + kept.cast("int")).alias("version"),
        F.when(kept, F.concat(history, F.array(entry))).otherwise(history).alias("previous"),
    )


def highest_role(role: Column) -> Column:
    """An aggregate: roles only rise, from term over mentioned to character."""
    rank = F.when(role == "character", 2).when(role == "mentioned", 1).otherwise(0)
    return F.max_by(role, rank)


def all_forms(term: Column, aliases: Column) -> Column:
    """The term and its aliases, each once, blanks left out."""
    every = F.concat(F.array(term), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")))
