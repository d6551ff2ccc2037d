"""Benchmark checks and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_results(checks: DataFrame) -> DataFrame:
    """AG13's cases: a case passes with all its checks. checks: case_id, name, passed (null: not applicable)."""
    known = checks.where("passed is not null")
    return known.groupBy("case_id").agg(F.every("passed").alias("passed"), F.count("*").alias("checks"))


def pass_rates(checks: DataFrame) -> DataFrame:
    """AG13: share of passed checks by name and over all (name null, by rollup); 0.0 where there are none."""
    rate = F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0))
    return checks.rollup("name").agg(F.count("passed").alias("checks"), F.count_if("passed").alias("passed"), rate.alias("rate"))
