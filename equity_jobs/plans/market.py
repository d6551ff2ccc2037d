"""Queries of the market jobs: bars, radar and board, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equity_jobs.functions import rules
from equity_jobs.operators import bars as B
from equity_jobs.operators import board, radar
from equity_jobs.plans.registry import Registry
from equity_jobs.plans.views import duck, view

R = Registry()
AS_OF = "2001-12-31"


def six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def clean(spark: SparkSession, sf: str) -> DataFrame:
    return B.validate_bars(view(spark, sf, "raw_bars"))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return B.features(view(spark, sf, "bars"))


def signalled(spark: SparkSession, sf: str) -> DataFrame:
    """The features that signals rest on, and no others."""
    bars = view(spark, sf, "bars").select(*B.KEY, "close", "volume", "pct_change", "turnover")
    return B.features(bars, averages=False, ranks=("turnover",))


# Steps shared by the statements below.
CLEAN = """clean AS (
  SELECT instrument_id, trade_date, open, high, low, close, volume, amount, pct_change, turnover FROM (
    SELECT *, row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY ingest_seq DESC) AS n FROM {raw_bars}
    WHERE high >= greatest(open, close) AND low <= least(open, close) AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND open IS NOT NULL) WHERE n = 1)"""
FEATURED = """base AS (
  SELECT *, lag(close) OVER s AS prev, row_number() OVER s AS session, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS sessions_back,
         median(volume) OVER q AS med, count(volume) OVER q AS nq, coalesce(list(volume) OVER p, []) AS pv, list_filter(coalesce(list(turnover) OVER p, []), lambda x: x IS NOT NULL) AS pt,
         CASE WHEN count(close) OVER m5 = 5 THEN avg(close) OVER m5 END AS ma5, CASE WHEN count(close) OVER m20 = 20 THEN avg(close) OVER m20 END AS ma20, CASE WHEN count(close) OVER m60 = 60 THEN avg(close) OVER m60 END AS ma60,
         close / max(close) OVER s - 1 AS drawdown
  FROM {bars}
  WINDOW s AS (PARTITION BY instrument_id ORDER BY trade_date), q AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), p AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING),
         m5 AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), m20 AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), m60 AS (PARTITION BY instrument_id ORDER BY trade_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
feat AS (
  SELECT *, coalesce(pct_change / 100, close / prev - 1) AS daily_return, CASE WHEN pct_change IS NOT NULL THEN 'provider' WHEN prev IS NOT NULL THEN 'close' END AS return_basis,
         CASE WHEN nq = 20 AND med > 0 THEN volume / med END AS volume_ratio,
         CASE WHEN len(pv) >= 20 THEN (2 * len(list_filter(pv, lambda x: x < volume)) + len(list_filter(pv, lambda x: x = volume))) / 2.0 / len(pv) END AS volume_percentile,
         CASE WHEN len(pt) >= 20 AND turnover IS NOT NULL THEN (2 * len(list_filter(pt, lambda x: x < turnover)) + len(list_filter(pt, lambda x: x = turnover))) / 2.0 / len(pt) END AS turnover_percentile, len(pt)::INTEGER AS turnover_sessions
  FROM base)"""
LIMITED = """ident AS (SELECT *, CASE WHEN regexp_matches(code, '^(?:600|601|603|605|688|689)') THEN 'SH' WHEN regexp_matches(code, '^(?:000|001|002|003|300|301)') THEN 'SZ' WHEN regexp_matches(code, '^(?:4|8|920)') THEN 'BJ' END AS exchange FROM {identity}),
limited AS (
  SELECT f.*, code, name, CASE WHEN exchange = 'BJ' THEN 0.3e0 WHEN regexp_matches(code, '^(?:300|301|688|689)') THEN 0.2e0 WHEN name LIKE 'ST%' THEN CASE WHEN exchange = 'SH' AND trade_date >= DATE '2026-07-06' THEN 0.1e0 ELSE 0.05e0 END ELSE 0.1e0 END AS limit_reference
  FROM feat f JOIN ident i USING (instrument_id)),
marked AS (SELECT *, daily_return >= limit_reference - 0.003e0 AS limit_up FROM limited)"""
EVENTS = """events0 AS (
  SELECT *, coalesce(limit_up, false) AS lu, coalesce(volume_ratio >= 2, false) AS hv, coalesce(turnover_percentile >= 0.9e0, false) AS ht FROM marked WHERE sessions_back <= 250),
fired AS (SELECT *, concat_ws(' + ', CASE WHEN lu THEN '涨停候选' END, CASE WHEN hv THEN '明显放量' END, CASE WHEN ht THEN '普通换手率高位' END) AS event_type FROM events0 WHERE lu OR hv OR ht)"""
RADAR = """recent AS (SELECT instrument_id, count(*) AS events FROM fired GROUP BY instrument_id),
states AS (
  SELECT m.* EXCLUDE (limit_up), coalesce(limit_up, false) AS limit_up, coalesce(events, 0) AS events,
         CASE WHEN daily_return IS NULL THEN 'unavailable' WHEN coalesce(limit_up, false) THEN 'triggered' ELSE 'not_triggered' END AS price_state,
         CASE WHEN volume_ratio IS NULL THEN 'unavailable' WHEN volume_ratio >= 2 THEN 'triggered' ELSE 'not_triggered' END AS volume_state,
         CASE WHEN turnover_percentile IS NULL THEN 'unavailable' WHEN turnover_percentile >= 0.9e0 THEN 'triggered' ELSE 'not_triggered' END AS turnover_state,
         (daily_return IS NOT NULL)::INTEGER + (volume_ratio IS NOT NULL)::INTEGER + (turnover_percentile IS NOT NULL)::INTEGER AS available,
         coalesce(limit_up, false)::INTEGER + coalesce(volume_ratio >= 2, false)::INTEGER + coalesce(turnover_percentile >= 0.9e0, false)::INTEGER AS trigger_count,
         concat_ws(',', CASE WHEN limit_up THEN '涨停候选' END, CASE WHEN volume_ratio >= 2 THEN '明显放量' END, CASE WHEN turnover_percentile >= 0.9e0 THEN '普通换手率历史高位' END) AS signals
  FROM marked m LEFT JOIN recent USING (instrument_id) WHERE sessions_back = 1),
radar AS (
  SELECT *, CASE WHEN trigger_count >= 2 THEN '复合异动' WHEN trigger_count = 1 THEN '单项异动' WHEN available < 3 THEN '未触发（部分数据缺失）' ELSE '未触发' END AS radar_status,
         CASE WHEN trigger_count >= 2 THEN 'compound' WHEN trigger_count = 1 THEN 'single' WHEN available = 0 THEN 'insufficient' ELSE 'none' END AS anomaly_status,
         row_number() OVER (ORDER BY trigger_count DESC, limit_up DESC, coalesce(volume_ratio, -1) DESC, coalesce(turnover_percentile, -1) DESC, code)::INTEGER AS radar_rank
  FROM states)"""


@R.query("cl1_validate_bars", f"WITH {CLEAN} SELECT * FROM clean")
def cl1(spark, sf):
    return clean(spark, sf).select("instrument_id", "trade_date", "open", "high", "low", "close", "volume", "amount", "pct_change", "turnover")


TURNOVER = """t0 AS (SELECT instrument_id, trade_date, ingest_seq, coalesce(CASE WHEN outstanding_share > 0 THEN volume / outstanding_share * 100 END, turnover_fraction * 100) AS turnover FROM {shares}), turn AS (SELECT instrument_id, trade_date, turnover FROM t0 WHERE turnover >= 0)"""


@R.query("cl2_ordinary_turnover", f"WITH {TURNOVER} SELECT instrument_id, trade_date, round(turnover, 6) AS turnover FROM turn")
def cl2(spark, sf):
    return B.ordinary_turnover(view(spark, sf, "shares", daily=True)).select(*B.KEY, *six("turnover"))


@R.query(
    "j1_fill_turnover",
    f"""WITH {TURNOVER} SELECT b.instrument_id, b.trade_date, round(coalesce(b.turnover, t.turnover), 6) AS turnover, b.turnover IS NULL AND t.turnover IS NOT NULL AS turnover_filled,
    CASE WHEN b.turnover IS NULL AND t.turnover IS NOT NULL THEN 'supplement' WHEN b.turnover IS NOT NULL THEN 'primary' END AS turnover_source
    FROM {{bars}} b LEFT JOIN turn t ON b.instrument_id = t.instrument_id AND b.trade_date = t.trade_date""",
)
def j1(spark, sf):
    return B.fill_turnover(view(spark, sf, "bars", daily=True), B.ordinary_turnover(view(spark, sf, "shares", daily=True))).select(*B.KEY, *six("turnover"), "turnover_filled", "turnover_source")


FEATURE_COLUMNS = ["ma5", "ma20", "ma60", "volume_ratio", "volume_percentile", "turnover_percentile", "daily_return", "drawdown"]


@R.query("wn1_5_features", f"WITH {FEATURED} SELECT instrument_id, trade_date, session::INTEGER AS session, return_basis, turnover_sessions, {', '.join(f'round({c}, 6) AS {c}' for c in FEATURE_COLUMNS)} FROM feat")
def wn1(spark, sf):
    return featured(spark, sf).select(*B.KEY, "session", "return_basis", "turnover_sessions", *six(*FEATURE_COLUMNS))


@R.query(
    "wn6_latest_activity",
    f"""WITH {FEATURED}, {LIMITED} SELECT instrument_id, code, trade_date, round(daily_return, 6) AS daily_return, round(volume_ratio, 6) AS volume_ratio, limit_reference,
    CASE WHEN volume_ratio IS NULL THEN '数据不足' WHEN volume_ratio >= 2 THEN '明显放量' WHEN volume_ratio >= 1.3e0 THEN '温和放量' WHEN volume_ratio <= 0.7e0 THEN '缩量' ELSE '接近常态' END AS volume_signal,
    CASE WHEN daily_return IS NULL THEN '数据不足' WHEN limit_up THEN '涨停候选' ELSE '未触及参考阈值' END AS limit_status FROM marked WHERE sessions_back = 1""",
)
def wn6(spark, sf):
    return B.latest_activity(featured(spark, sf), view(spark, sf, "identity")).select("instrument_id", "code", "trade_date", *six("daily_return", "volume_ratio"), "limit_reference", "volume_signal", "limit_status")


@R.query(
    "wn7_activity_events",
    f"""WITH {FEATURED}, {LIMITED}, {EVENTS}, placed AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC)::INTEGER AS place FROM fired)
    SELECT instrument_id, trade_date, event_type, place, round(daily_return, 6) AS daily_return, round(volume_ratio, 6) AS volume_ratio, round(turnover_percentile, 6) AS turnover_percentile, lu AS limit_up FROM placed WHERE place <= 8""",
)
def wn7(spark, sf):
    return B.activity_events(signalled(spark, sf), view(spark, sf, "identity")).select(*B.KEY, "event_type", "place", *six("daily_return", "volume_ratio", "turnover_percentile"), "limit_up")


@R.query("wn8_recent_history", f"WITH {FEATURED} SELECT instrument_id, trade_date, volume, round(daily_return, 6) AS daily_return, round(volume_ratio, 6) AS volume_ratio, turnover FROM feat WHERE sessions_back <= 60")
def wn8(spark, sf):
    return B.recent_history(featured(spark, sf)).select(*B.KEY, "volume", *six("daily_return", "volume_ratio"), "turnover")


METRICS = """m0 AS (SELECT *, close / lag(close) OVER s - 1 AS ret, close / max(close) OVER s - 1 AS down, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date DESC) AS back FROM {bars} WINDOW s AS (PARTITION BY instrument_id ORDER BY trade_date)),
m1 AS (SELECT instrument_id, max(trade_date) AS latest_date, max(CASE WHEN back = 1 THEN close END) AS c0, max(CASE WHEN back = 1 THEN ret END) AS daily_change, max(CASE WHEN back = 21 THEN close END) AS c20, max(CASE WHEN back = 61 THEN close END) AS c60,
  max(CASE WHEN back = 251 THEN close END) AS c250, stddev_samp(ret) * sqrt(250e0) AS volatility, min(down) AS max_drawdown, count(*) AS sessions FROM m0 GROUP BY instrument_id)"""


@R.query("ag1_market_metrics", f"WITH {METRICS} SELECT instrument_id, latest_date, c0 AS latest_close, round(daily_change, 6) AS daily_change, round(c0 / c20 - 1, 6) AS return_20, round(c0 / c60 - 1, 6) AS return_60, round(c0 / c250 - 1, 6) AS return_250, round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown, sessions FROM m1")
def ag1(spark, sf):
    return B.market_metrics(view(spark, sf, "bars")).select("instrument_id", "latest_date", "latest_close", *six("daily_change", "return_20", "return_60", "return_250", "volatility", "max_drawdown"), "sessions")


@R.query(
    "ag6_participation",
    f"""WITH {FEATURED}, g AS (SELECT instrument_id, count(*) FILTER (volume_ratio >= 2) AS high_volume_days, count(*) FILTER (turnover_percentile >= 0.9e0) AS high_turnover_days, count(*) FILTER (volume_ratio >= 2 AND turnover_percentile >= 0.9e0) AS both_days,
      max(CASE WHEN sessions_back = 1 THEN daily_return END) AS r, max(CASE WHEN sessions_back = 1 THEN volume_ratio END) AS v FROM feat WHERE sessions_back <= 20 GROUP BY instrument_id)
    SELECT instrument_id, high_volume_days, high_turnover_days, both_days, CASE WHEN v IS NULL THEN '量能数据不足' WHEN r IS NULL THEN CASE WHEN v >= 2 THEN '明显放量' ELSE '量能接近常态' END WHEN v >= 1.3e0 AND r > 0 THEN '放量上涨' WHEN v >= 1.3e0 AND r < 0 THEN '放量下跌'
      WHEN v <= 0.7e0 AND r > 0 THEN '缩量上涨' WHEN v <= 0.7e0 AND r < 0 THEN '缩量下跌' ELSE '量能接近常态' END AS pattern FROM g""",
)
def ag6(spark, sf):
    return B.participation(featured(spark, sf))


def radar_rows(spark, sf):
    states = radar.signal_states(B.latest_with_events(signalled(spark, sf), view(spark, sf, "identity")))
    return radar.rank_radar(states.withColumn("scan_date", F.lit(AS_OF).cast("date")), ["scan_date"])


@R.query("tk1_signal_states", f"WITH {FEATURED}, {LIMITED}, {EVENTS}, {RADAR} SELECT instrument_id, price_state, volume_state, turnover_state, signals, trigger_count, available, radar_status, anomaly_status, events FROM radar")
def tk1(spark, sf):
    return radar_rows(spark, sf).select("instrument_id", "price_state", "volume_state", "turnover_state", F.concat_ws(",", "signals").alias("signals"), "trigger_count", "available", "radar_status", "anomaly_status", "events")


@R.query("tk2_radar_rank", f"WITH {FEATURED}, {LIMITED}, {EVENTS}, {RADAR} SELECT instrument_id, code, trigger_count, radar_rank FROM radar")
def tk2(spark, sf):
    return radar_rows(spark, sf).select("instrument_id", "code", "trigger_count", "radar_rank")


QUEUE = f"""valid AS (SELECT *, CASE attention WHEN '高' THEN 3 WHEN '中' THEN 2 ELSE 1 END AS level, date_diff('day', published_date, DATE '{AS_OF}') AS days_old FROM {{disclosures}} WHERE published_date <= DATE '{AS_OF}'),
dsum AS (SELECT instrument_id, max_by(title, row(published_date, level, title)) AS latest_title, max_by(days_old, row(published_date, level, title)) AS latest_days, max(level = 3 AND days_old <= 2) AS urgent,
  max_by(attention || ':' || category || ':' || days_old, row(published_date, level, title)) FILTER (level >= 2 AND days_old <= 7) AS recent_text FROM valid GROUP BY instrument_id),
q0 AS (SELECT r.*, latest_title, latest_days, recent_text, CASE WHEN trigger_count >= 2 OR coalesce(urgent, false) THEN 'P1' WHEN trigger_count = 1 OR recent_text IS NOT NULL THEN 'P2' ELSE 'P3' END AS priority, r.instrument_id % 10 <> 9 AS source_available
  FROM radar r LEFT JOIN dsum d ON r.instrument_id = d.instrument_id AND r.instrument_id % 10 <> 9),
queue AS (SELECT *, concat_ws(',', CASE WHEN trigger_count >= 1 THEN 'signals:' || trigger_count END, 'recent:' || recent_text, CASE WHEN NOT source_available THEN 'source_unavailable' WHEN latest_title IS NULL THEN 'none_found' END) AS why,
  row_number() OVER (ORDER BY priority, trigger_count DESC, coalesce(latest_days, 10000), code, instrument_id)::INTEGER AS queue_rank FROM q0)"""


def queue_rows(spark, sf):
    rows = radar_rows(spark, sf).withColumn("source_available", F.col("instrument_id") % 10 != 9)
    disclosures = view(spark, sf, "disclosures").where("instrument_id % 10 <> 9")
    return radar.rank_queue(radar.queue(rows, disclosures, F.lit(AS_OF).cast("date")), ["scan_date"])


@R.query("j4_queue_disclosures", f"WITH {FEATURED}, {LIMITED}, {EVENTS}, {RADAR}, {QUEUE} SELECT instrument_id, latest_title, latest_days::INTEGER AS latest_days, priority, CASE WHEN why = '' THEN 'quiet' ELSE why END AS reasons FROM queue")
def j4(spark, sf):
    return queue_rows(spark, sf).select("instrument_id", F.col("latest.title").alias("latest_title"), F.col("latest.days_old").alias("latest_days"), "priority", F.concat_ws(",", "reasons").alias("reasons"))


@R.query("tk3_research_queue", f"WITH {FEATURED}, {LIMITED}, {EVENTS}, {RADAR}, {QUEUE} SELECT queue_rank, instrument_id, code, name, priority, trigger_count, signals, latest_title FROM queue")
def tk3(spark, sf):
    """The flagship: bars to a ranked research queue."""
    return queue_rows(spark, sf).select("queue_rank", "instrument_id", "code", "name", "priority", "trigger_count", F.concat_ws(",", "signals").alias("signals"), F.col("latest.title").alias("latest_title"))


@R.query(
    "cl7_identity",
    """SELECT instrument_id, code, name, exchange, code || '.' || exchange AS canonical_code FROM (SELECT *, CASE WHEN regexp_matches(code, '^(?:600|601|603|605|688|689)') THEN 'SH' WHEN regexp_matches(code, '^(?:000|001|002|003|300|301)') THEN 'SZ' WHEN regexp_matches(code, '^(?:4|8|920)') THEN 'BJ' END AS exchange,
    row_number() OVER (PARTITION BY code ORDER BY instrument_id) AS n FROM {identity}) WHERE n = 1 AND exchange IS NOT NULL""",
)
def cl7(spark, sf):
    from equity_jobs.operators.identity import company_identity

    return company_identity(view(spark, sf, "identity"), [F.asc("instrument_id")])


@R.query(
    "cl9_price_limits",
    f"""WITH {FEATURED}, {LIMITED} SELECT code, limit_reference, count(*) AS sessions, count(*) FILTER (limit_up) AS limit_sessions FROM marked GROUP BY code, limit_reference""",
)
def cl9(spark, sf):
    rows = B.with_limits(featured(spark, sf), view(spark, sf, "identity"))
    return rows.groupBy("code", "limit_reference").agg(F.count("*").alias("sessions"), F.count_if("limit_up").alias("limit_sessions"))


@R.query(
    "cl11_effective_turnover",
    f"""WITH {TURNOVER} SELECT s.instrument_id, s.trade_date, round(CASE WHEN outstanding_share > 0 AND free_float > 0 AND free_float <= outstanding_share AND t.turnover >= 0 THEN t.turnover * outstanding_share / free_float END, 6) AS effective_turnover
    FROM {{shares}} s LEFT JOIN turn t ON s.instrument_id = t.instrument_id AND s.trade_date = t.trade_date""",
)
def cl11(spark, sf):
    shares = view(spark, sf, "shares", daily=True)
    rows = shares.join(B.ordinary_turnover(shares), B.KEY, "left")
    return rows.select(*B.KEY, F.round(rules.effective_turnover(rows["turnover"], F.col("outstanding_share"), F.col("free_float")), 6).alias("effective_turnover"))


POOL = """pool0 AS (
  SELECT trade_date, lpad(regexp_replace(code, '\\.0$', ''), 6, '0') AS code, name, industry_raw AS industry, CASE WHEN streak_raw > 0 THEN streak_raw END AS streak, CASE WHEN breaks_raw >= 0 THEN breaks_raw::INTEGER END AS breaks,
         lpad(first_time_raw, 6, '0') AS t, CASE WHEN funds_raw >= 0 THEN funds_raw END AS funds, CASE WHEN turnover_raw >= 0 THEN turnover_raw / 100 END AS turnover, amount_raw AS amount, ingest_seq FROM {board_raw}),
pool AS (
  SELECT trade_date, code, name, industry, streak, breaks, CASE WHEN regexp_matches(t, '^([01][0-9]|2[0-3])[0-5][0-9][0-5][0-9]$') THEN t[1:2] || ':' || t[3:4] || ':' || t[5:6] END AS first_time, funds, turnover, amount
  FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, code ORDER BY ingest_seq) AS n FROM pool0) WHERE n = 1)"""
INDUSTRY = """ind AS (
  SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY companies DESC, repeats DESC, coalesce(amount, -1) DESC, industry)::INTEGER AS place FROM (
    SELECT trade_date, industry, count(*) AS companies, count(*) FILTER (streak >= 2) AS repeats, sum(amount) AS amount, median(turnover) AS median_turnover FROM pool GROUP BY trade_date, industry))"""


def pool(spark, sf):
    return board.validate_pool(view(spark, sf, "board_raw"))


@R.query("cl3_limit_up_pool", f"WITH {POOL} SELECT trade_date, code, name, industry, streak, breaks, first_time, funds, round(turnover, 6) AS turnover, amount FROM pool")
def cl3(spark, sf):
    return pool(spark, sf).select("trade_date", "code", "name", "industry", "streak", "breaks", "first_time", "funds", *six("turnover"), "amount")


@R.query("ag2_streak_ladder", f"WITH {POOL} SELECT trade_date, streak, companies, round(companies / total, 6) AS share FROM (SELECT trade_date, streak, count(*) AS companies, sum(count(*)) OVER (PARTITION BY trade_date) AS total FROM pool GROUP BY trade_date, streak) WHERE streak IS NOT NULL")
def ag2(spark, sf):
    return board.ladder(pool(spark, sf)).select("trade_date", "streak", "companies", *six("share"))


@R.query("ag3_industries", f"WITH {POOL}, {INDUSTRY} SELECT trade_date, industry, companies, repeats, round(amount, 2) AS amount, round(median_turnover, 6) AS median_turnover, place FROM ind")
def ag3(spark, sf):
    return board.industries(pool(spark, sf)).select("trade_date", "industry", "companies", "repeats", F.round("amount", 2).alias("amount"), *six("median_turnover"), "place")


@R.query(
    "ag4_board_timing",
    f"""WITH {POOL}, {INDUSTRY}, d AS (SELECT trade_date, count(*) AS companies, count(first_time) AS timed, count(*) FILTER (first_time <= '10:00:00') AS early, count(breaks) AS break_known, count(*) FILTER (breaks > 0) AS broken FROM pool GROUP BY trade_date)
    SELECT d.trade_date, d.companies, timed, early, break_known, broken, round(early / nullif(timed, 0), 6) AS early_ratio, round(broken / nullif(break_known, 0), 6) AS broken_ratio, i.industry AS lead_industry, round(i.companies / d.companies, 6) AS lead_share,
    CASE WHEN i.companies IS NULL THEN 'unavailable' WHEN i.companies / d.companies >= 0.25e0 THEN 'high' WHEN i.companies / d.companies >= 0.15e0 THEN 'middle' ELSE 'spread' END AS concentration FROM d LEFT JOIN ind i ON d.trade_date = i.trade_date AND i.place = 1""",
)
def ag4(spark, sf):
    return board.timing(pool(spark, sf)).select("trade_date", "companies", "timed", "early", "break_known", "broken", *six("early_ratio", "broken_ratio"), "lead_industry", *six("lead_share"), "concentration")


@R.query(
    "ag5_board_snapshot",
    f"""WITH {POOL}, c AS (SELECT trade_date, industry, row_number() OVER (PARTITION BY trade_date ORDER BY count(*) DESC, industry) AS n FROM pool GROUP BY trade_date, industry)
    SELECT p.trade_date, count(*) AS companies, count(*) FILTER (streak = 1) AS first_board, count(*) FILTER (streak >= 2) AS repeats, max(streak) AS max_streak, round(median(turnover), 6) AS median_turnover, any_value(c.industry) AS lead_industry
    FROM pool p LEFT JOIN c ON p.trade_date = c.trade_date AND c.n = 1 GROUP BY p.trade_date""",
)
def ag5(spark, sf):
    return board.snapshot(pool(spark, sf)).select("trade_date", "companies", "first_board", "repeats", "max_streak", *six("median_turnover"), "lead_industry")


@R.query("tk4_board_rank", f"WITH {POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY coalesce(streak, 0) DESC, breaks NULLS LAST, first_time NULLS LAST, coalesce(funds, -1) DESC, coalesce(turnover, -1) DESC, code)::INTEGER AS place FROM pool) SELECT trade_date, code, streak, place FROM k WHERE place <= 200")
def tk4(spark, sf):
    return board.ranked(pool(spark, sf)).select("trade_date", "code", "streak", "place")


QUERIES, ORACLE_SQL = R.queries, {name: duck(text) for name, text in R.sql.items()}
