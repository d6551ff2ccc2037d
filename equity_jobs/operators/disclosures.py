"""Disclosures: normalising, incremental windows, report selection and topic matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.functions.rules import EVIDENCE_GROUP_ORDER, EVIDENCE_GROUPS, allowed_url, classify, keep_one

ANNUAL, NOT_ANNUAL = "年度报告", "半年度报告|摘要|取消|问询|回复"
REPORT_YEAR, TRANSLATED = "((?:19|20)[0-9]{2})年年度报告", "(?i)英文(?:版|译本)?|English"


def normalise(raw: DataFrame) -> DataFrame:
    """DS1: titled, dated rows of allowed hosts, classified; of an instrument's equal title and date the first by id."""
    category, attention = classify(F.col("title"))
    rows = raw.withColumn("title", F.trim("title")).where((F.col("title") != "") & F.col("published_date").isNotNull() & allowed_url(F.col("url")))
    return keep_one(rows, ["instrument_id", "title", "published_date"], [F.asc("announcement_id")]).withColumns({"category": category, "attention": attention})


def evidence_windows(checkpoints: DataFrame, as_of: Column, first_days: int = 30, most_days: int = 365) -> DataFrame:
    """DS3's windows: start_date, end_date, mode and truncated of each checkpoint; none or a future one starts afresh."""
    fresh = F.col("checked_on").isNull() | (F.col("checked_on") > as_of)
    earliest = F.date_sub(as_of, most_days - 1)
    start = F.when(fresh, F.date_sub(as_of, first_days - 1)).otherwise(F.greatest("checked_on", earliest))
    return checkpoints.withColumns({"start_date": start, "end_date": as_of, "baseline": F.when(~fresh, F.col("checked_on")), "mode": F.when(fresh, "首次基准").otherwise("增量复核"), "truncated": ~fresh & (F.col("checked_on") < earliest)})


def delta_items(disclosures: DataFrame, windows: DataFrame) -> DataFrame:
    """DS3's items: disclosures inside their owner's window with their status and evidence group, once for each (date, title, url)."""
    table = F.create_map(*(F.lit(x) for pair in EVIDENCE_GROUPS.items() for x in pair))
    status = F.when(F.col("baseline").isNull(), "首次基准").when(F.col("published_date") == F.col("baseline"), "同日待复核").otherwise("新增")
    rows = disclosures.join(windows, "instrument_id").where(F.col("published_date").between(F.col("start_date"), F.col("end_date")))
    rows = rows.withColumns({"status": status, "group": F.coalesce(F.try_element_at(table, F.col("category")), F.lit("其他"))})
    return keep_one(rows, ["instrument_id", "published_date", "title", "url"], [F.asc("announcement_id")])


def delta_ranked(items: DataFrame, top: int = 100) -> DataFrame:
    """TK5: newest first, then attention and title; place, the total before the cut, and whether there was one."""
    level = F.when(F.col("attention") == "高", 0).when(F.col("attention") == "中", 1).otherwise(2)
    order = Window.partitionBy("instrument_id").orderBy(F.desc("published_date"), level, F.desc("title"), "announcement_id")
    total = F.count("*").over(Window.partitionBy("instrument_id"))
    return items.withColumns({"place": F.row_number().over(order), "total": total}).withColumn("limited", F.col("total") > top).where(F.col("place") <= top)


def group_counts(items: DataFrame, owners: DataFrame) -> DataFrame:
    """AG7: of each owner, all items, those of high attention, and those of every fixed group, absent groups as 0."""
    counts = [F.count_if(F.col("group") == g).alias(f"group_{i}") for i, g in enumerate(EVIDENCE_GROUP_ORDER)]
    found = items.groupBy("instrument_id").agg(F.count("*").alias("total"), F.count_if(F.col("attention") == "高").alias("high"), *counts)
    names = [c for c in found.columns if c != "instrument_id"]
    return owners.select("instrument_id").join(found, "instrument_id", "left").select("instrument_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def _annual(rows: DataFrame) -> DataFrame:
    year = F.nullif(F.regexp_extract("title", REPORT_YEAR, 1), F.lit("")).cast("int")
    return rows.where(F.col("title").rlike(ANNUAL) & ~F.col("title").rlike(NOT_ANNUAL)).withColumns({"report_year": year, "translated": F.col("title").rlike(TRANSLATED).cast("int")})


def latest_annual(rows: DataFrame) -> DataFrame:
    """TK6: of the latest report year (of all, if no title has one) an original before a translation, the newest."""
    top = F.max("report_year").over(Window.partitionBy("instrument_id"))
    annual = _annual(rows).withColumn("_top", top).where(F.col("_top").isNull() | (F.col("report_year") == F.col("_top"))).drop("_top")
    return keep_one(annual, ["instrument_id"], [F.asc("translated"), F.desc("published_date"), F.asc("announcement_id")])


def recent_annual(rows: DataFrame, years: int = 3) -> DataFrame:
    """TK7: one report of each of the latest fiscal years, an original before a translation, then the newest."""
    one = keep_one(_annual(rows).where("report_year is not null"), ["instrument_id", "report_year"], [F.asc("translated"), F.desc("published_date"), F.asc("announcement_id")])
    place = F.dense_rank().over(Window.partitionBy("instrument_id").orderBy(F.desc("report_year")))
    return one.withColumn("place", place).where(F.col("place") <= years)


def thesis_evidence(theses: DataFrame, items: DataFrame, top: int = 5) -> DataFrame:
    """Evidence of a thesis' instrument and topic, once for each (date, title, url), the first in evidence order."""
    rows = theses.join(items.where(allowed_url(F.col("url")) & (F.trim("title") != "")), (theses["instrument_id"] == items["instrument_id"]) & (theses["topic"] == items["group"])).drop(items["instrument_id"])
    one = keep_one(rows, ["thesis_id", "published_date", "title", "url"], [F.asc("announcement_id")])
    order = Window.partitionBy("thesis_id").orderBy(F.desc("published_date"), F.desc("title"), "announcement_id")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def status_counts(theses: DataFrame, statuses: list[str]) -> DataFrame:
    """AG7 for human verdicts: theses of every listed status, others ignored."""
    return theses.groupBy().agg(*(F.count_if(F.col("status") == s).alias(s) for s in statuses))
