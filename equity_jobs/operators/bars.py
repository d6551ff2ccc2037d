"""Daily bars: validation, turnover, and point-in-time features per instrument.

All features use one window partitioning, by instrument and date, so a plan has one
exchange and one sort for them. Baselines exclude the session they are compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from equity_jobs.functions.ranks import with_prior_percentiles
from equity_jobs.functions.rules import finite, keep_one, price_limit

KEY = ["instrument_id", "trade_date"]


def by_session() -> WindowSpec:
    return Window.partitionBy("instrument_id").orderBy("trade_date")


def newest_first() -> WindowSpec:
    return Window.partitionBy("instrument_id").orderBy(F.desc("trade_date"))


def marked_bars(raw: DataFrame) -> DataFrame:
    """Numbers that are none become null; sound tells consistent, positive and dated bars."""
    cast = {c: finite(F.col(c)) for c in ("open", "high", "low", "close", "volume", "amount", "pct_change", "turnover")}
    sound = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")) & (F.least("open", "high", "low", "close") > 0) & (F.col("volume") >= 0)
    complete = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull() & F.col("trade_date").isNotNull()
    return raw.withColumns(cast).withColumn("sound", F.coalesce(complete & sound, F.lit(False)))


def validate_bars(raw: DataFrame) -> DataFrame:
    """CL1: numbers that are none become null; consistent, positive bars stay; of a date the last one to arrive."""
    return keep_one(marked_bars(raw).where("sound").drop("sound"), KEY, [F.desc("ingest_seq")]).drop("ingest_seq")


def ordinary_turnover(shares: DataFrame) -> DataFrame:
    """CL2: turnover in percent from volume and outstanding shares, else the provider's fraction; finite and not negative."""
    made = F.when(F.col("outstanding_share") > 0, F.col("volume") / F.col("outstanding_share") * 100)
    value = finite(F.coalesce(made, F.col("turnover_fraction") * 100))
    return keep_one(shares.select(*KEY, value.alias("turnover"), "ingest_seq").where("turnover >= 0"), KEY, [F.desc("ingest_seq")]).drop("ingest_seq")


def fill_turnover(bars: DataFrame, supplement: DataFrame, source: str = "supplement") -> DataFrame:
    """Turnover from the supplement where bars have none; turnover_filled and turnover_source say so."""
    right = supplement.select(*KEY, F.col("turnover").alias("_other"))
    joined = bars.join(right, KEY, "left")
    filled = F.col("turnover").isNull() & F.col("_other").isNotNull()
    return joined.withColumns({"turnover_filled": filled, "turnover_source": F.when(filled, source).when(F.col("turnover").isNotNull(), "primary"), "turnover": F.coalesce("turnover", "_other")}).drop("_other")


def moving_average(column: str, size: int) -> Column:
    """WN1: null until the window is full."""
    window = by_session().rowsBetween(1 - size, 0)
    return F.when(F.count(column).over(window) == size, F.avg(column).over(window))


def daily_return() -> tuple[Column, Column]:
    """WN4: the provider's change in percent if there is one, else close over the last close; and which it is."""
    before = F.lag("close").over(by_session())
    value = F.coalesce(F.col("pct_change") / 100, F.col("close") / before - 1)
    return value, F.when(F.col("pct_change").isNotNull(), "provider").when(before.isNotNull(), "close")


def features(bars: DataFrame, averages: bool = True, ranks: tuple[str, ...] = ("volume", "turnover")) -> DataFrame:
    """WN1-WN5 and the session numbers of validated bars.

    The ratio of WN2 (20 sessions) and the ranks of WN3 come from numpy, an instrument at a
    time: a rolling percentile in SQL sorts its window anew for each row. What Spark
    does not use behind that step it cannot leave out, so a caller that needs no
    averages and drawdown, or fewer ranks, says so.
    """
    change, basis = daily_return()
    made = {"session": F.row_number().over(by_session()), "sessions_back": (F.count(F.lit(1)).over(by_session().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.row_number().over(by_session()) + 1).cast("int"), "daily_return": change, "return_basis": basis}
    if averages:
        made |= {f"ma{n}": moving_average("close", n) for n in (5, 20, 60)}
        made |= {"drawdown": F.col("close") / F.max("close").over(by_session().rowsBetween(Window.unboundedPreceding, 0)) - 1}
    return with_prior_percentiles(bars.withColumns(made), list(ranks), ratios={"volume": 20})


def market_metrics(bars: DataFrame, steps: tuple[int, ...] = (20, 60, 250)) -> DataFrame:
    """AG1: latest close and change, returns over steps sessions, yearly volatility, deepest drawdown and count per instrument."""
    before = F.lag("close").over(by_session())
    marked = bars.withColumns({"_ret": F.col("close") / before - 1, "_down": F.col("close") / F.max("close").over(by_session().rowsBetween(Window.unboundedPreceding, 0)) - 1, "_back": F.row_number().over(newest_first())})
    at = lambda k: F.max(F.when(F.col("_back") == k + 1, F.col("close")))
    past = [F.when(at(k) != 0, at(0) / at(k) - 1).alias(f"return_{k}") for k in steps]
    vol = F.when(F.count("_ret") >= 2, F.stddev_samp("_ret") * F.sqrt(F.lit(250.0)))
    return marked.groupBy("instrument_id").agg(F.max("trade_date").alias("latest_date"), at(0).alias("latest_close"), F.max(F.when(F.col("_back") == 1, F.col("_ret"))).alias("daily_change"), *past, vol.alias("volatility"), F.min("_down").alias("max_drawdown"), F.count("*").alias("sessions"))


def with_limits(frame: DataFrame, identity: DataFrame) -> DataFrame:
    """frame with code, name, limit_reference and limit_up (null without a return); identity is a dimension."""
    joined = frame.join(identity, "instrument_id").withColumn("limit_reference", price_limit(F.col("code"), F.col("name"), F.col("trade_date")))
    return joined.withColumn("limit_up", F.col("daily_return") >= F.col("limit_reference") - 0.003)


def volume_signal(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "数据不足").when(ratio >= 2, "明显放量").when(ratio >= 1.3, "温和放量").when(ratio <= 0.7, "缩量").otherwise("接近常态")


def latest_activity(featured: DataFrame, identity: DataFrame) -> DataFrame:
    """WN6: the last session of each instrument, with its signal labels."""
    last = with_limits(featured.where("sessions_back = 1"), identity)
    status = F.when(F.col("daily_return").isNull(), "数据不足").when(F.col("limit_up"), "涨停候选").otherwise("未触及参考阈值")
    return last.withColumns({"volume_signal": volume_signal(F.col("volume_ratio")), "limit_status": status})


def _fired(featured: DataFrame, identity: DataFrame, lookback: int, ratio: float, percentile: float) -> DataFrame:
    """Sessions of the lookback with their signals, and labels in fixed order ("" if none fired)."""
    rows = with_limits(featured.where(F.col("sessions_back") <= lookback), identity)
    high_volume, high_turnover = F.coalesce(F.col("volume_ratio") >= ratio, F.lit(False)), F.coalesce(F.col("turnover_percentile") >= percentile, F.lit(False))
    limit_up = F.coalesce("limit_up", F.lit(False))
    labels = F.concat_ws(" + ", F.when(limit_up, "涨停候选"), F.when(high_volume, "明显放量"), F.when(high_turnover, "普通换手率高位"))
    return rows.withColumns({"limit_up": limit_up, "high_volume": high_volume, "high_turnover": high_turnover, "event_type": labels})


def activity_events(featured: DataFrame, identity: DataFrame, lookback: int = 250, ratio: float = 2.0, percentile: float = 0.9, top: int | None = 8) -> DataFrame:
    """WN7: sessions of the lookback that fired, newest first."""
    fired = _fired(featured, identity, lookback, ratio, percentile).where("event_type <> ''")
    return fired if top is None else fired.withColumn("place", F.row_number().over(newest_first())).where(F.col("place") <= top)


def latest_with_events(featured: DataFrame, identity: DataFrame, lookback: int = 250) -> DataFrame:
    """The last session of each instrument with `events`, how many of its lookback fired, in one aggregate over the features."""
    rows = _fired(featured, identity, lookback, 2.0, 0.9)
    last = F.max_by(F.struct(*(c for c in rows.columns if c != "instrument_id")), "trade_date")
    return rows.groupBy("instrument_id").agg(last.alias("_last"), F.count_if(F.col("event_type") != "").alias("events")).select("instrument_id", "_last.*", "events")


def recent_history(featured: DataFrame, lookback: int = 60) -> DataFrame:
    """WN8: the last sessions, with features that have seen the whole history."""
    return featured.where(F.col("sessions_back") <= lookback)


def price_volume_pattern(change: Column, ratio: Column) -> Column:
    plain = "量能接近常态"
    return (
        F.when(ratio.isNull(), "量能数据不足").when(change.isNull(), F.when(ratio >= 2, "明显放量").otherwise(plain))
        .when((ratio >= 1.3) & (change > 0), "放量上涨").when((ratio >= 1.3) & (change < 0), "放量下跌")
        .when((ratio <= 0.7) & (change > 0), "缩量上涨").when((ratio <= 0.7) & (change < 0), "缩量下跌").otherwise(plain)
    )


def participation(featured: DataFrame, recent: int = 20) -> DataFrame:
    """AG6: of the last sessions, those of high volume, of high turnover and of both; and the latest pattern."""
    rows = featured.where(F.col("sessions_back") <= recent)
    volume, turnover = F.col("volume_ratio") >= 2, F.col("turnover_percentile") >= 0.9
    last = F.col("sessions_back") == 1
    pattern = price_volume_pattern(F.max(F.when(last, F.col("daily_return"))), F.max(F.when(last, F.col("volume_ratio"))))
    return rows.groupBy("instrument_id").agg(F.count_if(volume).alias("high_volume_days"), F.count_if(turnover).alias("high_turnover_days"), F.count_if(volume & turnover).alias("both_days"), pattern.alias("pattern"))
