"""Signals, the radar order and the research queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equity_jobs.functions.rules import allowed_url
from equity_jobs.operators.ranking import ranked

LEVELS = {"高": 3, "中": 2, "低": 1}


def signal_states(activity: DataFrame) -> DataFrame:
    """TK1: the three checks (triggered, not triggered, unavailable) and the radar and anomaly status of latest sessions."""
    state = lambda value, hit: F.when(value.isNull(), "unavailable").when(hit, "triggered").otherwise("not_triggered")
    limit_up, ratio, rank = F.coalesce("limit_up", F.lit(False)), F.col("volume_ratio"), F.col("turnover_percentile")
    signals = F.array_compact(F.array(F.when(limit_up, "涨停候选"), F.when(ratio >= 2, "明显放量"), F.when(rank >= 0.9, "普通换手率历史高位")))
    available = sum((c.isNotNull().cast("int") for c in (F.col("daily_return"), ratio, rank)), F.lit(0))
    count = F.size("signals")
    radar = F.when(count >= 2, "复合异动").when(count == 1, "单项异动").when(F.col("available") < 3, "未触发（部分数据缺失）").otherwise("未触发")
    anomaly = F.when(count >= 2, "compound").when(count == 1, "single").when(F.col("available") == 0, "insufficient").otherwise("none")
    rows = activity.withColumns({"price_state": state(F.col("daily_return"), limit_up), "volume_state": state(ratio, ratio >= 2), "turnover_state": state(rank, rank >= 0.9), "limit_up": limit_up, "signals": signals, "available": available})
    return rows.withColumns({"trigger_count": count, "radar_status": radar, "anomaly_status": anomaly})


def radar_order() -> list[Column]:
    """TK2: triggers, limit flag, ratio and percentile (nulls last), code; several instruments may have one code, so instrument_id last."""
    return [F.desc("trigger_count"), F.desc("limit_up"), F.coalesce("volume_ratio", F.lit(-1.0)).desc(), F.coalesce("turnover_percentile", F.lit(-1.0)).desc(), F.asc("code"), F.asc("instrument_id")]


def rank_radar(rows: DataFrame, scan: list[str]) -> DataFrame:
    """radar_rank within each scan; a scan of the whole market is ranked by many tasks."""
    return ranked(rows, radar_order(), "radar_rank", scan).withColumn("radar_rank", F.col("radar_rank").cast("int"))


def queue(radar: DataFrame, disclosures: DataFrame, as_of: Column, urgent_days: int = 2, recent_days: int = 7) -> DataFrame:
    """The latest valid disclosure at as_of, the priority and its reasons.

    Disclosures are brought to one row an instrument before the join. An instrument whose
    source_available is false has no disclosures to look at, which is not the same as none found.
    """
    level = F.coalesce(*(F.when(F.col("attention") == name, value) for name, value in LEVELS.items()), F.lit(1))
    valid = disclosures.where((F.col("published_date") <= as_of) & (F.trim("title") != "") & allowed_url(F.col("url"))).withColumns({"level": level, "days_old": F.date_diff(as_of, F.col("published_date"))})
    order = F.struct("published_date", "level", "title")
    latest = F.max_by(F.struct(F.col("title"), F.col("published_date"), F.col("category"), F.col("attention"), F.col("days_old")), order)
    urgent, recent = (F.col("level") == 3) & (F.col("days_old") <= urgent_days), (F.col("level") >= 2) & (F.col("days_old") <= recent_days)
    newest = F.max(F.when(recent, F.struct(*order_columns(), F.col("category"), F.col("attention"), F.col("days_old"))))
    summary = valid.groupBy("instrument_id").agg(latest.alias("latest"), F.max(urgent).alias("urgent"), newest.alias("recent"))
    rows = radar.join(summary, "instrument_id", "left")
    triggers, urgent_now, has_recent = F.col("trigger_count"), F.coalesce("urgent", F.lit(False)), F.col("recent").isNotNull()
    priority = F.when((triggers >= 2) | urgent_now, "P1").when((triggers == 1) | has_recent, "P2").otherwise("P3")
    why = F.array_compact(
        F.array(
            F.when(triggers >= 1, F.concat(F.lit("signals:"), triggers.cast("string"))), F.when(has_recent, F.concat_ws(":", F.lit("recent"), F.col("recent.attention"), F.col("recent.category"), F.col("recent.days_old").cast("string"))),
            F.when(~F.col("source_available"), "source_unavailable").when(F.col("latest").isNull(), "none_found"),
        )
    )
    return rows.withColumns({"priority": priority, "reasons": F.when(F.size(why) == 0, F.array(F.lit("quiet"))).otherwise(why)}).drop("urgent", "recent")


def order_columns() -> list[Column]:
    return [F.col("published_date"), F.col("level"), F.col("title")]


def rank_queue(rows: DataFrame, scan: list[str]) -> DataFrame:
    """TK3: priority, triggers, days since the latest disclosure (none last), code, instrument_id; ranked as in rank_radar()."""
    order = [F.asc("priority"), F.desc("trigger_count"), F.coalesce("latest.days_old", F.lit(10_000)).asc(), F.asc("code"), F.asc("instrument_id")]
    return ranked(rows, order, "queue_rank", scan).withColumn("queue_rank", F.col("queue_rank").cast("int"))
