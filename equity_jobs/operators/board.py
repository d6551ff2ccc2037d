"""Daily limit-up structure: validation, ladder, industries, timing, order and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.functions.rules import finite, keep_one

DAY = "trade_date"
UNCLASSIFIED = "未分类"


def board_time(value: Column) -> Column:
    """92500 or 09:25:00 as HH:mm:ss; null if it is no time of day."""
    digits = F.lpad(F.regexp_replace(value.cast("string"), ":", ""), 6, "0")
    sound = value.cast("string").rlike("^(?:[0-9]{1,6}|[0-9]{1,2}:[0-9]{2}:[0-9]{2})$") & digits.rlike("^(?:[01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]$")
    return F.when(sound, F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))


def validate_pool(raw: DataFrame) -> DataFrame:
    """CL3: six-digit codes, named rows, the first of each code and day; negative or non-finite numbers and a streak of 0 are null."""
    positive = lambda c: F.when(finite(F.col(c)) >= 0, finite(F.col(c)))
    code = F.lpad(F.regexp_replace("code", r"\.0$", ""), 6, "0")
    rows = raw.select(
        DAY, code.alias("code"), F.trim("name").alias("name"), F.coalesce(F.nullif(F.trim("industry_raw"), F.lit("")), F.lit(UNCLASSIFIED)).alias("industry"), F.when(F.col("streak_raw") > 0, F.col("streak_raw").cast("int")).alias("streak"),
        F.when(F.col("breaks_raw") >= 0, F.col("breaks_raw").cast("int")).alias("breaks"), board_time(F.col("first_time_raw")).alias("first_time"), positive("funds_raw").alias("funds"), (positive("turnover_raw") / 100).alias("turnover"), positive("amount_raw").alias("amount"), "ingest_seq",
    )
    return keep_one(rows.where("code rlike '^[0-9]{6}$' and name <> ''"), [DAY, "code"], [F.asc("ingest_seq")]).drop("ingest_seq")


def ladder(pool: DataFrame) -> DataFrame:
    """AG2: rows of each streak level, and their share of all rows of the day."""
    levels = pool.groupBy(DAY, "streak").agg(F.count("*").alias("companies"))
    total = F.sum("companies").over(Window.partitionBy(DAY))
    return levels.withColumn("share", F.col("companies") / total).where("streak is not null")


def industries(pool: DataFrame) -> DataFrame:
    """AG3: count, repeat streaks, amount and exact median turnover of each industry and day, in order."""
    rows = pool.where(F.col("industry") != UNCLASSIFIED).groupBy(DAY, "industry")
    rows = rows.agg(F.count("*").alias("companies"), F.count_if(F.col("streak") >= 2).alias("repeats"), F.sum("amount").alias("amount"), F.percentile("turnover", 0.5).alias("median_turnover"))
    order = [F.desc("companies"), F.desc("repeats"), F.coalesce("amount", F.lit(-1.0)).desc(), F.asc("industry")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(DAY).orderBy(*order)))


def timing(pool: DataFrame, early: str = "10:00:00", high: float = 0.25, middle: float = 0.15) -> DataFrame:
    """AG4: how many first times and breaks are known, early and broken ones, and the leading industry's share."""
    day = pool.groupBy(DAY).agg(
        F.count("*").alias("companies"), F.count("first_time").alias("timed"), F.count_if(F.col("first_time") <= early).alias("early"), F.count("breaks").alias("break_known"), F.count_if(F.col("breaks") > 0).alias("broken"),
    )
    lead = industries(pool).where("place = 1").select(DAY, F.col("industry").alias("lead_industry"), F.col("companies").alias("lead_companies"))
    share = F.col("lead_companies") / F.col("companies")
    label = F.when(share.isNull(), "unavailable").when(share >= high, "high").when(share >= middle, "middle").otherwise("spread")
    return day.join(lead, DAY, "left").withColumns({"early_ratio": F.try_divide("early", "timed"), "broken_ratio": F.try_divide("broken", "break_known"), "lead_share": share, "concentration": label})


def order() -> list[Column]:
    """TK4's order."""
    return [F.coalesce("streak", F.lit(0)).desc(), F.asc_nulls_last("breaks"), F.asc_nulls_last("first_time"), F.coalesce("funds", F.lit(-1.0)).desc(), F.coalesce("turnover", F.lit(-1.0)).desc(), F.asc("code")]


def ranked(pool: DataFrame, top: int = 200) -> DataFrame:
    """TK4: the first rows of each day."""
    return pool.withColumn("place", F.row_number().over(Window.partitionBy(DAY).orderBy(*order()))).where(F.col("place") <= top)


def snapshot(pool: DataFrame) -> DataFrame:
    """AG5: one row a day; the leading industry is the most frequent, ties by name."""
    counts = pool.where(F.col("industry") != UNCLASSIFIED).groupBy(DAY, "industry").agg(F.count("*").alias("n"))
    lead = keep_one(counts, [DAY], [F.desc("n"), F.asc("industry")]).select(DAY, F.col("industry").alias("lead_industry"))
    day = pool.groupBy(DAY).agg(F.count("*").alias("companies"), F.count_if(F.col("streak") == 1).alias("first_board"), F.count_if(F.col("streak") >= 2).alias("repeats"), F.max("streak").alias("max_streak"), F.percentile("turnover", 0.5).alias("median_turnover"))
    return day.join(lead, DAY, "left")
