"""Ranks over whole scans without one task that sorts a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.sources.shared import written


def ranked(frame: DataFrame, order: list[Column], name: str, scan: list[str] | None = None) -> DataFrame:
    """frame with name, the row's place (from 1) in its scan by order; no scan columns: in all rows.

    Rows are range-partitioned and sorted by scan and order together, so a scan that holds
    most rows is dealt to many tasks. The sorted rows are written with their place in their
    partition; a row's rank is that place, less where its scan begins there, plus the scan's
    rows in the partitions before, which come from one count a (partition, scan). Null scan
    keys form a scan of their own; rows that tie in order get neighbouring ranks in either
    order; no rows: no rows.
    """
    keys = scan or []
    sort = [*(F.asc_nulls_first(c) for c in keys), *order]
    own = frame.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    own = written(own, name).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # at most partitions + scans rows
    begins = own.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    begins = begins.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_scan_{c}") for c in keys), "_first", "_before")
    same = F.col("_part") == F.col("_p")
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_scan_{c}"))
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("bigint")
    return own.join(begins, same).select(*frame.columns, rank.alias(name))
