"""Readers of landed files: governed CSV facts and provider payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from equity_jobs.functions.rules import keep_one
from equity_jobs.operators.bars import marked_bars

# Localised headers and their canonical names.
BAR_ALIASES = {"日期": "trade_date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount", "涨跌幅": "pct_change", "换手率": "turnover"}
DIRECTORY_ALIASES = {"代码": "code", "股票代码": "code", "证券代码": "code", "名称": "name", "股票简称": "name", "证券简称": "name"}


def require(frame: DataFrame, columns: list[str]) -> DataFrame:
    """frame, if it has these columns; else an error that lists those missing."""
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def read_facts(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """IO1: CSV files with a header, read as text and cast to schema, so that codes keep their zeros and bad numbers are null.

    A byte order mark is ignored. Every column of schema must be there; no rows are an error.
    """
    wanted = StructType.fromDDL(schema)
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(paths)
    raw = require(raw.toDF(*(c.strip().lstrip("﻿") for c in raw.columns)), wanted.fieldNames())
    if raw.isEmpty():
        raise ValueError("the files hold no rows")
    return raw.select(*(F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in wanted))


def rename(frame: DataFrame, aliases: dict[str, str], identity: list[str]) -> DataFrame:
    """IO2: canonical names for known headers, unknown ones kept; the identity columns must then be there."""
    stripped = frame.toDF(*(c.strip() for c in frame.columns))
    return require(stripped.withColumnsRenamed(aliases), identity)


def amount_is_volume(bars: DataFrame) -> DataFrame:
    """IO2's adapter for a source that names its volume amount: moves it, and leaves no amount."""
    return bars.withColumns({"volume": F.col("amount"), "amount": F.lit(None).cast("double")})


def parse_bars(payloads: DataFrame, start: Column, end: Column) -> DataFrame:
    """IO3: bars of JSON payloads (instrument_id, payload): positional rows of nine and more, adjusted before plain days, within the dates."""
    body = F.from_json("payload", "qfqday array<array<string>>, day array<array<string>>")
    rows = payloads.select("instrument_id", F.explode(F.coalesce(body["qfqday"], body["day"])).alias("r")).where(F.size("r") >= 9)
    at = lambda i, name: F.get("r", i).try_cast("double").alias(name)
    bars = rows.select("instrument_id", F.get("r", 0).try_cast("date").alias("trade_date"), at(1, "open"), at(2, "close"), at(3, "high"), at(4, "low"), at(5, "volume"), at(7, "turnover"))
    return bars.where(F.col("trade_date").between(start, end))


def parse_disclosures(payloads: DataFrame) -> DataFrame:
    """IO4: rows of JSON payloads with the local date of their time and the detail url."""
    body = F.from_json("payload", "announcements array<struct<secCode:string,announcementTitle:string,announcementTime:bigint,announcementId:string,orgId:string>>")
    rows = payloads.select("instrument_id", F.explode(body["announcements"]).alias("a")).select("instrument_id", "a.*")
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("announcementTime"), "Asia/Shanghai"))
    url = F.concat(F.lit("https://www.cninfo.com.cn/new/disclosure/detail?stockCode="), "secCode", F.lit("&announcementId="), "announcementId", F.lit("&orgId="), F.url_encode("orgId"), F.lit("&announcementTime="), day.cast("string"))
    return rows.select("instrument_id", F.col("announcementId").try_cast("bigint").alias("announcement_id"), F.col("announcementTitle").alias("title"), day.alias("published_date"), url.alias("url"))


def _sources(named: dict[str, DataFrame]) -> DataFrame:
    """All rows with source, its rank, chunk (0 where there is none) and whether they are sound."""
    parts = [(rows if "chunk" in rows.columns else rows.withColumn("chunk", F.lit(0))).withColumns({"source": F.lit(name), "_rank": F.lit(i)}) for i, (name, rows) in enumerate(named.items())]
    return marked_bars(reduce(DataFrame.unionByName, parts))


def _elected(marked: DataFrame) -> DataFrame:
    """The first source of each instrument that has a sound row."""
    return marked.where("sound").groupBy("instrument_id").agg(F.min("_rank").alias("_rank"))


def merge_sources(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """IO5: of each instrument the sound rows of the first source that has any, with its name.

    Rows are validated before the source is chosen, so a primary of unsound rows loses.
    Of a date that chunks of one source share the later chunk counts, then the later row.
    """
    marked = _sources({"primary": primary, "fallback": fallback})
    rows = marked.where("sound").join(_elected(marked), ["instrument_id", "_rank"])
    return keep_one(rows, ["instrument_id", "trade_date"], [F.desc("chunk"), F.desc("ingest_seq")]).drop("_rank", "sound")


def source_coverage(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """IO5's evidence: of each instrument, source and chunk how many rows came, how many are sound, the sound dates, how many of them an earlier chunk has too, and whether the source was elected."""
    marked = _sources({"primary": primary, "fallback": fallback})
    keys = ["instrument_id", "_rank", "source", "chunk"]
    dates = marked.where("sound").groupBy(*keys, "trade_date").agg(F.count("*").alias("n"))
    again = F.min("chunk").over(Window.partitionBy("instrument_id", "_rank", "trade_date")) < F.col("chunk")
    sound = dates.withColumn("_again", again).groupBy(*keys).agg(F.sum("n").alias("sound"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count("*").alias("dates"), F.count_if("_again").alias("overlap"))
    rows = marked.groupBy(*keys).agg(F.count("*").alias("rows")).join(sound, keys, "left").join(_elected(marked).withColumn("_won", F.lit(True)), ["instrument_id", "_rank"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("instrument_id", "source", "chunk", "rows", zero("sound"), "first_date", "last_date", zero("dates"), zero("overlap"), F.coalesce("_won", F.lit(False)).alias("elected"))
