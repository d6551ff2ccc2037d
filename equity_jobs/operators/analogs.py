"""Earlier analogs of market events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBERS = ("daily_return", "volume_ratio", "turnover_percentile")


def find_analogs(selected: DataFrame, events: DataFrame, top: int = 3, least: float = 0.25, signal_weight: float = 0.40, number_weight: float = 0.20) -> DataFrame:
    """Of each selected event the most similar strictly earlier events of its instrument.

    The score is the weighted mean of the signals' Jaccard index and of the closeness of
    those numbers that both have; without a signal or a number there is none. Only fired
    events meet, so an instrument's pairs are few. Scores that are equal to nine digits tie,
    whatever the order of their sums; the later analog goes first.
    """
    signals = F.array_compact(F.array(F.when(F.col("limit_up"), "涨停候选"), F.when(F.col("volume_ratio") >= 2, "明显放量"), F.when(F.col("high_turnover"), "普通换手率高位")))
    columns = ["instrument_id", "trade_date", *NUMBERS]
    left = selected.select(*columns, signals.alias("signals")).alias("s")
    right = events.select(*columns, signals.alias("signals")).alias("c")
    pairs = left.join(right, (F.col("s.instrument_id") == F.col("c.instrument_id")) & (F.col("c.trade_date") < F.col("s.trade_date")))

    def linear(name: str, scale: float) -> Column:
        return F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"s.{name}") - F.col(f"c.{name}")) / scale)

    both = lambda name: F.col(f"s.{name}").isNotNull() & F.col(f"c.{name}").isNotNull()
    positive = (F.col("s.volume_ratio") > 0) & (F.col("c.volume_ratio") > 0)
    close = [
        F.when(both("daily_return"), linear("daily_return", 0.10)),
        F.when(positive, F.greatest(F.lit(0.0), 1 - F.abs(F.log2(F.col("s.volume_ratio") / F.col("c.volume_ratio"))) / 2)),
        F.when(both("turnover_percentile"), linear("turnover_percentile", 1.0)),
    ]
    union = F.size(F.array_union("s.signals", "c.signals"))
    jaccard = F.when(union > 0, F.size(F.array_intersect("s.signals", "c.signals")) / union)
    known = sum((c.isNotNull().cast("int") for c in close), F.lit(0))
    score = (jaccard * signal_weight + sum((F.coalesce(c, F.lit(0.0)) * number_weight for c in close), F.lit(0.0))) / (signal_weight + known * number_weight)
    rows = pairs.select(F.col("s.instrument_id").alias("instrument_id"), F.col("s.trade_date").alias("event_date"), F.col("c.trade_date").alias("analog_date"), F.when(known >= 1, score).alias("score"), (known + 1).alias("components"), F.array_sort(F.array_intersect("s.signals", "c.signals")).alias("shared")).where(F.col("score") >= least)
    order = Window.partitionBy("instrument_id", "event_date").orderBy(F.round("score", 9).desc(), F.desc("analog_date"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
