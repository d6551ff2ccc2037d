"""Sinks: fingerprinted audit packages and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_packages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """IO6: keys, payload (JSON with sorted keys, nulls kept) and its SHA-256."""
    payload = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(*keys, payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))


def write_packages(packages: DataFrame, path: str, partition: str) -> None:
    packages.write.mode("errorifexists").partitionBy(partition).json(path)


def write_drafts(rows: DataFrame, columns: list[str], path: str) -> None:
    """IO6's drafts: CSV of fixed column order; rows are candidates, which validation rejects until they are verified."""
    rows.withColumn("verification_status", F.lit("candidate")).select(*columns).write.mode("errorifexists").option("header", True).csv(path)
