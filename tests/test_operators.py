"""Semantics on hand-made frames: nulls against zeros, ties, look-ahead, and invariance to order and partitioning."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from equity_jobs.functions import rules
from equity_jobs.operators import analogs, asof, bars, board, disclosures, fundamentals, identity, peers, radar, statements, text, vectors
from equity_jobs.sources import landed, sinks
from equity_jobs.streaming import feed

BAR = "instrument_id bigint, trade_date date, open double, high double, low double, close double, volume double, amount double, pct_change double, turnover double"


def made(n, **changed):
    start = dt.date(2024, 1, 1)
    rows = []
    for i in range(n):
        row = {"open": 100 + i * 0.2 - 0.2, "high": 100 + i * 0.2 + 0.6, "low": 100 + i * 0.2 - 0.8, "close": 100 + i * 0.2, "volume": 1e6, "amount": None, "pct_change": None, "turnover": 2.5}
        row |= {k: v(i, row[k]) for k, v in changed.items()}
        rows.append((1, start + dt.timedelta(days=i), *row.values()))
    return rows


def featured(spark, rows, parts=3):
    return {r.trade_date: r for r in bars.features(spark.createDataFrame(rows, BAR).repartition(parts)).collect()}


def test_baselines_exclude_the_session_and_need_twenty(spark):
    rows = made(22, volume=lambda i, v: 3e6 if i in (19, 20) else v)
    got = featured(spark, rows)
    days = sorted(got)
    assert got[days[19]].volume_ratio is None and got[days[20]].volume_ratio == 3.0
    assert got[days[19]].volume_percentile is None and got[days[20]].volume_percentile == (19 + 0.5) / 20
    assert got[days[3]].ma5 is None and got[days[4]].ma5 == pytest.approx(100.4)


def test_missing_turnover_is_not_zero(spark):
    got = featured(spark, made(40, turnover=lambda i, v: None if i % 2 else v))
    days = sorted(got)
    assert got[days[39]].turnover_percentile is None and got[days[38]].turnover_percentile is None and got[days[38]].turnover_sessions == 19


def test_future_rows_change_no_feature(spark):
    rows = made(60, volume=lambda i, v: v + i * i % 7 * 1e5)
    past, full = featured(spark, rows[:50], 1), featured(spark, rows[::-1], 5)
    drop = {"sessions_back"}
    for day, row in past.items():
        assert {k: v for k, v in row.asDict().items() if k not in drop} == {k: v for k, v in full[day].asDict().items() if k not in drop}


def test_validation_keeps_the_last_of_a_date(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, 1.0, 2.0, 0.5, 1.5, 10.0, None, None, None, 1), (1, day, 1.0, 3.0, 0.5, 1.5, 0.0, None, None, None, 2), (1, day, 1.0, 1.2, 0.5, 1.5, 10.0, None, None, None, 3), (1, day, float("nan"), 3.0, 0.5, 1.5, 10.0, None, None, None, 4), (1, None, 1.0, 3.0, 0.5, 1.5, 1.0, None, None, None, 5)]
    got = bars.validate_bars(spark.createDataFrame(rows, BAR + ", ingest_seq int")).collect()
    assert [(r.high, r.volume) for r in got] == [(3.0, 0.0)]


def test_metrics_of_short_histories(spark):
    got = bars.market_metrics(spark.createDataFrame(made(2), BAR)).first()
    assert got.volatility is None and got.return_20 is None and got.sessions == 2


def test_rules(spark):
    frame = spark.createDataFrame(
        [("600001", "ST x", dt.date(2026, 7, 5)), ("600001", "*ST x", dt.date(2026, 7, 6)), ("000001", "S T x", dt.date(2026, 7, 6)), ("300001", "x", dt.date(2026, 1, 1)), ("830001", "ST x", dt.date(2026, 1, 1)), ("600001", "x", dt.date(2026, 1, 1))], "code string, name string, day date"
    )
    assert [r[0] for r in frame.select(rules.price_limit(F.col("code"), F.col("name"), F.col("day"))).collect()] == [0.05, 0.10, 0.05, 0.20, 0.30, 0.10]
    urls = spark.createDataFrame([("https://www.cninfo.com.cn/a",), ("http://evilcninfo.com.cn/a",), ("ftp://cninfo.com.cn",), (None,), ("::bad::",), ("https://CNINFO.com.cn:443/x",)], "u string")
    assert [r[0] for r in urls.select(rules.allowed_url(F.col("u"))).collect()] == [True, False, False, False, False, True]
    units = spark.createDataFrame([("人民币 万元",), ("元",), ("箱",), (None,)], "u string")
    assert [r[0] for r in units.select(rules.unit_multiplier(F.col("u"))).collect()] == [10_000, 1, None, None]
    titles = spark.createDataFrame([("年度报告摘要及回购",), ("无关",), (None,)], "t string")
    assert [tuple(r) for r in titles.select(*rules.classify(F.col("t"))).collect()] == [("财务报告", "高"), ("其他公告", "低"), ("其他公告", "低")]
    turns = spark.createDataFrame([(2.0, 100.0, 50.0), (2.0, 100.0, 150.0), (None, 1.0, 1.0), (-1.0, 2.0, 1.0)], "t double, c double, f double")
    assert [r[0] for r in turns.select(rules.effective_turnover(F.col("t"), F.col("c"), F.col("f"))).collect()] == [4.0, None, None, None]


def test_queue_tells_unavailable_from_none(spark):
    base = [(1, 0, True, "a"), (2, 0, False, "b"), (3, 2, True, "c"), (4, 0, True, "d")]
    rows = spark.createDataFrame(base, "instrument_id bigint, trigger_count int, source_available boolean, code string")
    day = dt.date(2024, 5, 10)
    url = "https://www.sse.com.cn/x"
    found = spark.createDataFrame([(4, "new", day, url, "低", "x"), (4, "old", day - dt.timedelta(days=2), url, "高", "y"), (4, "future", day + dt.timedelta(days=1), url, "高", "z")], "instrument_id bigint, title string, published_date date, url string, attention string, category string")
    got = {r.instrument_id: r for r in radar.rank_queue(radar.queue(rows, found, F.lit(day)).withColumn("scan", F.lit(1)), ["scan"]).collect()}
    assert got[1].reasons == ["none_found"] and got[2].reasons == ["source_unavailable"] and got[3].priority == "P1"
    assert got[4].priority == "P1" and got[4].latest.title == "new" and got[4].reasons == ["recent:高:y:2"]
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1].queue_rank)] == [3, 4, 1, 2]


def test_board(spark):
    times = spark.createDataFrame([("92500",), ("09:25:00",), ("9:5",), ("250000",), (None,)], "t string")
    assert [r[0] for r in times.select(board.board_time(F.col("t"))).collect()] == ["09:25:00", "09:25:00", None, None, None]
    raw = [(dt.date(2024, 1, 1), "1.0", " A ", None, 0, -1, "93000", float("nan"), 5.0, 1.0, 2), (dt.date(2024, 1, 1), "000001", "B", "x", 2, 1, None, 1.0, -5.0, 1.0, 1), (dt.date(2024, 1, 1), "2", "", "x", 2, 1, None, 1.0, 5.0, 1.0, 3)]
    pool = board.validate_pool(spark.createDataFrame(raw, "trade_date date, code string, name string, industry_raw string, streak_raw int, breaks_raw int, first_time_raw string, funds_raw double, turnover_raw double, amount_raw double, ingest_seq int"))
    assert [(r.code, r.name, r.turnover) for r in pool.collect()] == [("000001", "B", None)]
    assert board.timing(pool).first().early_ratio is None and board.ladder(pool.limit(0)).count() == 0


def test_windows_and_annual_reports(spark):
    day = dt.date(2024, 6, 30)
    marks = spark.createDataFrame([(1, None), (2, dt.date(2024, 6, 1)), (3, dt.date(2020, 1, 1)), (4, dt.date(2025, 1, 1))], "instrument_id bigint, checked_on date")
    got = {r.instrument_id: r for r in disclosures.evidence_windows(marks, F.lit(day)).collect()}
    assert got[1].start_date == day - dt.timedelta(days=29) == got[4].start_date and got[2].start_date == dt.date(2024, 6, 1) and got[3].truncated and got[3].start_date == day - dt.timedelta(days=364)
    titles = [(1, 1, "2023年年度报告（英文版）", day), (1, 2, "2023年年度报告", day - dt.timedelta(days=5)), (1, 3, "2023年半年度报告", day), (1, 4, "2022年年度报告", day), (2, 5, "年度报告", day), (1, 6, "2023年年度报告摘要", day)]
    rows = spark.createDataFrame(titles, "instrument_id bigint, announcement_id bigint, title string, published_date date")
    assert {r.instrument_id: r.announcement_id for r in disclosures.latest_annual(rows).collect()} == {1: 2, 2: 5}
    assert [(r.report_year, r.announcement_id) for r in disclosures.recent_annual(rows).orderBy(F.desc("report_year")).collect()] == [(2023, 2), (2022, 4)]


def test_as_of_on_a_weekend_and_without_history(spark):
    rows = spark.createDataFrame(made(5), BAR)
    asked = spark.createDataFrame([(1, dt.date(2024, 1, 10)), (1, dt.date(2023, 12, 1)), (1, dt.date(2024, 1, 3))], "instrument_id bigint, as_of date")
    got = {r.as_of: (r.effective, r.next) for r in asof.sessions_around(asked, rows).collect()}
    assert got == {dt.date(2024, 1, 10): (dt.date(2024, 1, 5), None), dt.date(2023, 12, 1): (None, dt.date(2024, 1, 1)), dt.date(2024, 1, 3): (dt.date(2024, 1, 3), dt.date(2024, 1, 4))}
    late = asof.later_outcomes(rows, (2,)).orderBy("trade_date").collect()
    assert late[0].status_2 == "ok" and late[-1].status_2 == "insufficient_future_data" and late[-1].gain_2 is None


def test_analogs_are_strictly_earlier_and_need_a_number(spark):
    schema = "instrument_id bigint, trade_date date, daily_return double, volume_ratio double, turnover_percentile double, limit_up boolean, high_turnover boolean"
    d = [dt.date(2024, 1, i) for i in range(1, 5)]
    rows = spark.createDataFrame([(1, d[0], 0.1, 3.0, None, True, False), (1, d[1], 0.1, 3.0, None, True, False), (1, d[2], None, None, None, True, False), (2, d[3], 0.1, 3.0, None, True, False)], schema)
    got = analogs.find_analogs(rows, rows).collect()
    assert [(r.event_date, r.analog_date, round(r.score, 9), r.components) for r in got] == [(d[1], d[0], 1.0, 3)]


def test_analogs_tie_at_nine_digits(spark):
    schema = "instrument_id bigint, trade_date date, daily_return double, volume_ratio double, turnover_percentile double, limit_up boolean, high_turnover boolean"
    d = [dt.date(2024, 1, i) for i in range(1, 6)]
    # the first is nearer by 1e-12 only, so the three tie and the later ones go first
    rows = spark.createDataFrame([(1, d[0], 0.1 - 1e-12, None, None, True, False), (1, d[1], 0.1 - 2e-12, None, None, True, False), (1, d[2], 0.1 - 3e-12, None, None, True, False), (1, d[3], 0.1, None, None, True, False)], schema)
    got = analogs.find_analogs(rows.where(F.col("trade_date") == d[3]), rows).collect()
    assert [r.analog_date for r in sorted(got, key=lambda r: r.place)] == [d[2], d[1], d[0]]


def test_vintages_are_visible_only_once_published(spark):
    rows = spark.createDataFrame([(1, 2020, 2020, dt.date(2021, 3, 31), "original", 100.0, 0.0, -5.0, 200.0, 50.0), (1, 2020, 2021, dt.date(2022, 4, 1), "restated", 110.0, 10.0, 5.0, 210.0, 50.0), (1, 2022, 2022, dt.date(2023, 3, 31), "original", 220.0, 20.0, 5.0, 300.0, 50.0)], "company bigint, period_year int, report_year int, published_date date, accounting_basis string, revenue double, net_profit double, operating_cash_flow double, total_assets double, total_liabilities double")
    cuts = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2021, 3, 31),), (dt.date(2023, 12, 31),)], "as_of date")
    points = {(r.as_of.year, r.period_year): r for r in fundamentals.trend_points(fundamentals.select_as_of(rows, cuts)).collect()}
    assert set(points) == {(2021, 2020), (2023, 2020), (2023, 2022)}
    assert points[2021, 2020].revenue == 100 and points[2023, 2020].revenue == 110 and points[2021, 2020].cash_conversion is None
    assert points[2023, 2022].revenue_growth == 1.0 and points[2023, 2020].revenue_growth is None  # against the previous available period


def test_peer_positions_keep_all_ties(spark):
    rows = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 1.0), ("g", 3, 2.0), ("g", 4, None)], "peer_group string, company bigint, m double")
    got = {r.company: r for r in peers.sample_positions(rows, ["peer_group"], "m").collect()}
    assert got[1].at_min and got[2].at_min and got[3].at_max and got[1].position == "near" and got[4].position == "unavailable" and got[4].sample == 3


def test_watchlist_and_lookup(spark):
    lists = spark.createDataFrame([("a", "600001，600001; 12 000002、000003 000004 000005 000006"), ("b", "")], "owner string, text string")
    got = {r.owner: r for r in identity.watchlist_codes(lists, "owner", "text", rules.watchlist(F.col("text"))).collect()}
    assert got["a"].codes == ["600001", "000002", "000003", "000004", "000005"] and (got["a"].duplicates, got["a"].invalid, got["a"].over_cap) == (1, 1, 1)
    directory = spark.createDataFrame([("600001", "Alpha Co"), ("000002", "Alpha"), ("000003", "Beta")], "code string, name string")
    asked = spark.createDataFrame([(1, "SH600001 news"), (2, "alpha"), (3, "Co"), (4, "zz")], "query_id bigint, text string")
    assert {(r.query_id, r.code) for r in identity.resolve(asked, directory).collect()} == {(1, "600001"), (2, "000002"), (3, "600001")}


def greedy(body, most, overlap):
    lines = [x for x in (re.sub(r"[\s\xa0]+", " ", raw).strip() for raw in body.split("\n")) if x]
    out, at = [], 0
    while at < len(lines):
        took = [lines[at]]
        for line in lines[at + 1 :]:
            if len("\n".join([*took, line])) > most:
                break
            took.append(line)
        out.append("\n".join(took))
        if at + len(took) >= len(lines):
            break
        at = max(at + 1, at + len(took) - overlap)
    return out


def test_chunks(spark):
    bodies = ["a\n\n b\xa0 c \n" + "x" * 50 + "\nd\ne\nf\ng", "", None, "\n".join(f"line {i}" for i in range(40)), "y" * 200]
    pages = spark.createDataFrame([("d", i, b, "clash") for i, b in enumerate(bodies)], "doc_id string, page_number bigint, text string, chunk_index string")
    got = {}
    for r in text.chunk_pages(pages, 30, 2).orderBy("page_number", "chunk_index").collect():
        got.setdefault(r.page_number, []).append(r.text)
    assert got == {i: greedy(b, 30, 2) for i, b in enumerate(bodies) if b}


def test_statement_reading():
    titles, _, labels = statements.STATEMENTS["income"]
    four = [(7, "Consolidated income statement\n52 weeks\n£m\nii. Revenue\n1,787\n1\n(1,650)\n2\nNet profit\n—\n5\n6\n7")]
    got = statements.read_statement(four, titles, labels)
    assert got["figures"] == {"revenue": (1787.0, -1650.0), "net_profit": (0.0, 6.0)} and got["unit"] == "£m" and got["weeks"] == 52
    assert statements.read_statement([(1, "Revenue\n1\n2")], titles, labels) is None
    assert statements.read_statement([(1, "Income statement\nRevenue\n1\n2")], titles, labels) is None


def test_parsed_numbers(spark):
    rows = spark.createDataFrame([("1,787",), ("（153）",), ("－12",), ("–",), ("abc",), (None,), ("",)], "v string")
    assert [r[0] for r in rows.select(statements.parse_number(F.col("v"))).collect()] == [1787.0, -153.0, -12.0, 0.0, None, None, None]


def test_facts_must_have_their_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿code,year,value\n000001,2020,1.5\n000002,x,\n")
    got = landed.read_facts(spark, str(tmp_path / "a.csv"), "code string, year int, value double").orderBy("code").collect()
    assert [tuple(r) for r in got] == [("000001", 2020, 1.5), ("000002", None, None)]
    with pytest.raises(ValueError, match="missing columns: a, b"):
        landed.read_facts(spark, str(tmp_path / "a.csv"), "b int, code string, a int")
    (tmp_path / "b.csv").write_text("code\n")
    with pytest.raises(ValueError, match="no rows"):
        landed.read_facts(spark, str(tmp_path / "b.csv"), "code string")


def test_payloads(spark):
    body = json.dumps({"day": [["2024-01-02", "1", "2", "3", "0.5", "10", "", "1.5", ""], ["2024-01-03", "1"], ["2030-01-01"] + ["1"] * 8]})
    rows = spark.createDataFrame([(1, body), (2, "not json"), (3, None)], "instrument_id bigint, payload string")
    got = landed.parse_bars(rows, F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date")).collect()
    assert [(r.instrument_id, r.close, r.high, r.turnover) for r in got] == [(1, 2.0, 3.0, 1.5)]


def test_audit_packages_sort_their_keys(spark):
    row = sinks.audit_packages(spark.createDataFrame([(1, None, "x")], "b int, a string, c string"), ["b"]).first()
    assert row.payload == '{"a":null,"b":1,"c":"x"}' and len(row.sha256) == 64


def test_feed_stores_each_row_once(spark, tmp_path):
    schema = "instrument_id bigint, announcement_id bigint, title string, published_date date, url string"
    url, day = "https://www.sse.com.cn/x", dt.date(2024, 1, 1)
    first = [(1, 1, "回购", day, url), (1, 1, "回购", day, url), (2, 2, "", day, url), (3, 3, "x", day, "http://bad.org")]
    place = {n: str(tmp_path / n) for n in ("landed", "store", "checkpoint")}
    for rows in (first, [(1, 9, "回购", day, url), (4, 4, "年度报告", day, url)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place["landed"])
        feed.run_feed(feed.disclosure_feed(spark, place["landed"], schema), place["store"], place["checkpoint"])
    assert sorted((r.instrument_id, r.category) for r in spark.read.parquet(place["store"]).collect()) == [(1, "分红与回购"), (4, "财务报告")]


def test_cosine_of_zero_vectors_and_blocks(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0])], "id bigint, vector array<double>")
    got = vectors.cosine_top_k(table, table, 3, block=1).collect()
    assert {(r.query_id, r.passage_id): r.semantic for r in got if r.query_id == 0} == {(0, 2): 1.0, (0, 1): 0.0, (0, 3): -1.0}
