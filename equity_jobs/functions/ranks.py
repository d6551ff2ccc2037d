"""Rolling mid-ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def _mid_ranks(values: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each value its mid-rank among the non-null values of the size rows before, and how many those are."""
    padded = np.concatenate([np.full(size, np.nan), values])
    seen = np.concatenate([[0], np.cumsum(~np.isnan(padded))])
    rank, count = np.full(len(values), np.nan), (seen[size:-1] - seen[: len(values)]).astype(np.int32)
    for at in range(0, len(values), 4096):  # a bounded matrix of comparisons
        own = values[at : at + 4096]
        prior = np.lib.stride_tricks.sliding_window_view(padded[at : at + size + len(own) - 1], size)
        twice = 2 * (prior < own[:, None]).sum(1) + (prior == own[:, None]).sum(1)
        known = count[at : at + 4096]
        rank[at : at + 4096] = np.where((known >= least) & ~np.isnan(own), twice / 2.0 / np.maximum(known, 1), np.nan)
    return rank, count


def _ratios(values: np.ndarray, size: int) -> np.ndarray:
    """Each value over the exact median of the size values before it; nan where one of them is missing or the median is not positive."""
    ratio = np.full(len(values), np.nan)
    prior = np.lib.stride_tricks.sliding_window_view(values[:-1], size) if len(values) > size else np.empty((0, size))
    for at in range(0, len(prior), 4096):
        median = np.median(prior[at : at + 4096], axis=1)
        known = median > 0
        ratio[size + at : size + at + len(median)] = np.where(known, values[size + at : size + at + len(median)] / np.where(known, median, 1.0), np.nan)
    return ratio


def with_prior_percentiles(frame: DataFrame, columns: list[str], size: int = 250, least: int = 20, ratios: dict[str, int] | None = None) -> DataFrame:
    """WN3: <column>_percentile, the mid-rank among the non-null values of the rows before, and <column>_sessions, how many.

    WN2: with ratios, <column>_ratio too, the value over the exact median of so many rows
    before, all of them known, if it is positive.

    The rows of an instrument are ranked in one task by numpy: a rolling list of 250
    values in SQL is gathered anew for each row and measured ten times slower. After the
    windows of features() this needs no further exchange.
    """
    ratios = ratios or {}
    added = ", ".join([*(f"{c}_percentile double, {c}_sessions int" for c in columns), *(f"{c}_ratio double" for c in ratios)])
    schema = StructType([*frame.schema.fields, *StructType.fromDDL(added).fields])

    def rank(table: pa.Table) -> pa.Table:
        table = table.sort_by("trade_date")
        for c in columns:
            ranks, counts = _mid_ranks(np.array(table.column(c).to_numpy(zero_copy_only=False), np.float64), size, least)
            table = table.append_column(f"{c}_percentile", pa.array(ranks, pa.float64(), mask=np.isnan(ranks))).append_column(f"{c}_sessions", pa.array(counts))
        for c, before in ratios.items():
            made = _ratios(np.array(table.column(c).to_numpy(zero_copy_only=False), np.float64), before)
            table = table.append_column(f"{c}_ratio", pa.array(made, pa.float64(), mask=np.isnan(made)))
        return table

    return frame.groupBy("instrument_id").applyInArrow(rank, schema)
