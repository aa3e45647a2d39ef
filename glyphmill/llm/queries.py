"""Named queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm.glyphs import same_glyphs
from glyphmill.llm.leaks import leaks
from glyphmill.llm.levels import reading_levels
from glyphmill.llm.names import same_names
from glyphmill.llm.pairs import broken_pairs
from glyphmill.llm.terms import match_terms
from glyphmill.llm.tokens import TOKENIZERS, encode_corpus
from glyphmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "text_region").where("not coalesce(dropped, false) and not coalesce(keep, false) and not coalesce(erase, false)")
    return broken_pairs(live, "region_key", "source_text", "target_text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_terms(table(spark, sf_dir, "worksheet"), table(spark, sf_dir, "term_bank"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_names(table(spark, sf_dir, "worksheet"), table(spark, sf_dir, "term_bank"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_glyphs(table(spark, sf_dir, "text_region"), table(spark, sf_dir, "cases"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "cases"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_levels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p6_ids, p7_found, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {}
