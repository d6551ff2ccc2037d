"""Company briefs: evidence lanes, coverage, and the primary research question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = ("identity", "market", "disclosures", "annual_report", "financial_history")


def lanes(companies: DataFrame, market: DataFrame, disclosures: DataFrame, annual: DataFrame, history: DataFrame, snapshots: DataFrame) -> DataFrame:
    """AG14's lanes: status and date of each lane and company; a snapshot only stands in for missing history.

    All inputs have at most one row a company (instrument_id): market: latest_date,
    has_ratio; disclosures: latest_day; annual: report_day; history: periods, last_day; snapshots: snapshot_day.
    """
    rows = companies.select("instrument_id", "known")
    for frame in (market, disclosures, annual, history, snapshots):
        rows = rows.join(frame, "instrument_id", "left")
    status = {
        "identity": (F.when(F.col("known"), "verified").otherwise("partial"), F.lit(None).cast("date")),
        "market": (F.when(F.col("latest_date").isNull(), "unavailable").when(F.col("has_ratio"), "verified").otherwise("partial"), F.col("latest_date")),
        "disclosures": (F.when(F.col("latest_day").isNotNull(), "verified").otherwise("unavailable"), F.col("latest_day")),
        "annual_report": (F.when(F.col("report_day").isNotNull(), "verified").otherwise("unavailable"), F.col("report_day")),
        "financial_history": (F.when(F.col("periods") >= 2, "verified").when(F.col("periods").isNotNull() | F.col("snapshot_day").isNotNull(), "partial").otherwise("unavailable"), F.coalesce("last_day", "snapshot_day")),
    }
    return rows.select("instrument_id", F.inline(F.array(*(F.struct(F.lit(n).alias("lane"), s.alias("status"), d.alias("as_of")) for n, (s, d) in status.items()))))


def coverage(laned: DataFrame, full: float = 0.8, some: float = 0.5) -> DataFrame:
    """AG14: the mean of 1, 0.5 and 0 points, its label, and how many lanes have each status."""
    points = F.when(F.col("status") == "verified", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0)
    rows = laned.groupBy("instrument_id").agg(F.avg(points).alias("coverage"), *(F.count_if(F.col("status") == s).alias(s) for s in ("verified", "partial", "unavailable")))
    return rows.withColumn("label", F.when(F.col("coverage") >= full, "证据覆盖较完整").when(F.col("coverage") >= some, "可生成初步研究").otherwise("证据不足，优先补充来源"))


def primary_question(rows: DataFrame, some: float = 0.5) -> DataFrame:
    """TK9: the candidate question of highest priority, by key at a tie; a coverage under `some` overrides all others. And the three pillars.

    rows: instrument_id, coverage, trigger_count, latest_attention, revenue_growth,
    net_profit_growth, operating_cash_flow_growth, periods.
    """
    cash = (F.col("net_profit_growth") > 0) & (F.col("operating_cash_flow_growth") < 0)
    profit = (F.col("revenue_growth") > 0) & (F.col("net_profit_growth") < 0)
    entry = lambda test, name, priority: F.when(test, F.struct(F.lit(-priority).alias("order"), F.lit(name).alias("key"), F.lit(priority).alias("priority")))
    found: Column = F.array_compact(
        F.array(
            entry(F.col("coverage") < some, "evidence_gap", 100), entry(cash, "financial_cash_mismatch", 95), entry(~F.coalesce(cash, F.lit(False)) & profit, "financial_profit_pressure", 92), entry(F.col("trigger_count") >= 2, "market_compound", 90),
            entry(F.col("latest_attention") == "高", "disclosure_high", 85), entry(F.col("trigger_count") == 1, "market_single", 70), entry(F.lit(True), "initial_review", 10),
        )
    )
    best = F.array_min(found)
    market = F.when(F.col("trigger_count").isNull(), "insufficient").when(F.col("trigger_count") > 0, "attention").otherwise("clear")
    disclosure = F.when(F.col("latest_attention").isNull(), "insufficient").when(F.col("latest_attention") == "高", "attention").otherwise("clear")
    financial = F.when(F.col("periods").isNull(), "insufficient").when(F.coalesce(cash | profit, F.lit(False)), "attention").otherwise("clear")
    return rows.select("instrument_id", best["key"].alias("question"), best["priority"].alias("priority"), market.alias("market_pillar"), disclosure.alias("disclosure_pillar"), financial.alias("financial_pillar"))


def latest_attention(disclosures: DataFrame) -> DataFrame:
    """The attention of each company's single latest disclosure, by date and title."""
    order = Window.partitionBy("instrument_id").orderBy(F.desc("published_date"), F.desc("title"), "announcement_id")
    return disclosures.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("instrument_id", F.col("attention").alias("latest_attention"), F.col("published_date").alias("latest_day"))
