"""Rows that fail to parse, and the ones that load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators.records import broken_records, located_faults, valid_records
from glyphmill.plans.registry import Register
from glyphmill.session import table

query = Register()


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_records(table(spark, sf_dir, "worksheet_raw"))


@query()
def p5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_records(table(spark, sf_dir, "worksheet_raw"))


@query()
def p5_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located_faults(table(spark, sf_dir, "worksheet_raw"))
