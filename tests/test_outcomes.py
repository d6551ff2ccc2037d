"""Later outcomes, distributed ranks and the feed's restart."""

import datetime as dt
import glob
import os
import random
import statistics

from pyspark.sql import functions as F

from equity_jobs.operators import asof, radar
from equity_jobs.streaming import feed

DAY = dt.date(2020, 1, 1)


def test_outcomes_equal_brute_force(spark):
    draw = random.Random(4)
    closes = {i: [round(draw.uniform(1, 9), 2) for _ in range(n)] for i, n in ((1, 97), (2, 3), (3, 1), (4, 60))}
    closes[5] = [float(x) for x in range(50, 0, -1)]
    rows = [(i, DAY + dt.timedelta(days=j), c, "x") for i, own in closes.items() for j, c in enumerate(own)]
    table = spark.createDataFrame(rows, "instrument_id bigint, trade_date date, close double, _session string").repartition(5)
    horizons = (1, 2, 7, 20)
    out = asof.later_outcomes(table, horizons)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {(r.instrument_id, r.trade_date): r for r in out.collect()}
    assert len(got) == len(rows)
    for i, own in closes.items():
        for j, c in enumerate(own):
            r = got[i, DAY + dt.timedelta(days=j)]
            for k in horizons:
                if j + k >= len(own):
                    assert (r[f"status_{k}"], r[f"return_{k}"], r[f"gain_{k}"], r[f"fall_{k}"], r[f"date_{k}"]) == ("insufficient_future_data", None, None, None, None)
                    continue
                path = own[j : j + k + 1]
                fall = min(x / max(path[: n + 1]) - 1 for n, x in enumerate(path))
                assert (r[f"return_{k}"], r[f"gain_{k}"], r[f"fall_{k}"]) == (path[-1] / c - 1, max(path) / c - 1, fall)
                assert r[f"date_{k}"] == DAY + dt.timedelta(days=j + k)
    assert asof.later_outcomes(table.limit(0)).count() == 0


def test_market_ranks_are_dealt_out(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([0, 1, 2]), draw.random() < 0.5, draw.choice([None, 1.5, 2.0, 3.0]), draw.choice([None, 0.5, 0.9]), f"{i * 7919 % 10007:06d}", "now") for i in range(3000)]
    table = spark.createDataFrame(rows, "instrument_id bigint, trigger_count int, limit_up boolean, volume_ratio double, turnover_percentile double, code string, scan string").repartition(6)
    out = radar.rank_radar(table, ["scan"])
    order = sorted(rows, key=lambda r: (-r[1], not r[2], -(r[3] if r[3] is not None else -1), -(r[4] if r[4] is not None else -1), r[5]))
    assert {r.instrument_id: r.radar_rank for r in out.collect()} == {r[0]: i for i, r in enumerate(order, 1)}
    plan = out._jdf.queryExecution().toString()
    assert "row_number" not in plan and "SinglePartition" not in plan


SCHEMA = "instrument_id bigint, announcement_id bigint, title string, published_date date, url string"
URL = "https://www.sse.com.cn/x"


def land(spark, place, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place["landed"])


def read(spark, place):
    feed.run_feed(feed.disclosure_feed(spark, place["landed"], SCHEMA, files=1), place["store"], place["checkpoint"])
    return sorted((r.instrument_id, r.title, r.published_date) for r in spark.read.parquet(place["store"]).collect())


def test_a_batch_that_failed_is_stored_once(spark, tmp_path):
    place = {n: str(tmp_path / n) for n in ("landed", "store", "checkpoint")}
    first = [(i % 5, i, f"回购{i % 7}", DAY + dt.timedelta(days=i % 3), URL) for i in range(40)]
    land(spark, place, first)
    want = {(i, t, d) for i, _, t, d, _ in first}
    assert read(spark, place) == sorted(want)
    # the next batch is stored, but its commit is lost: it runs again from the state before it
    more = [(1, 900, "年度报告", DAY + dt.timedelta(days=5), URL), first[0], (2, 901, "同日", DAY, URL)]
    land(spark, place, more)
    want |= {(i, t, d) for i, _, t, d, _ in more}
    assert read(spark, place) == sorted(want)
    commits = sorted((int(os.path.basename(f)), f) for f in glob.glob(f"{place['checkpoint']}/commits/*") if os.path.basename(f).isdigit())
    os.remove(commits[-1][1])
    crc = f"{place['checkpoint']}/commits/.{commits[-1][0]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    land(spark, place, [(3, 902, "合同", DAY, URL), more[0]])
    want |= {(3, "合同", DAY)}
    assert read(spark, place) == sorted(want)
    stored = spark.read.parquet(place["store"])
    assert stored.count() == len(want) and stored.where(F.col("title") == "年度报告").count() == 1


def test_a_batch_does_not_read_the_store(spark, tmp_path):
    place = {n: str(tmp_path / n) for n in ("landed", "store", "checkpoint")}
    land(spark, place, [(1, 1, "回购", DAY, URL)])
    read(spark, place)
    for f in glob.glob(f"{place['store']}/batch=*/*"):  # what was stored is moved on by someone else
        os.remove(f)
    land(spark, place, [(1, 2, "回购", DAY, URL), (1, 3, "合同", DAY, URL)])
    assert read(spark, place) == [(1, "合同", DAY)]


def test_equal_codes_are_ranked_by_instrument(spark):
    rows = [(i, 1, False, 2.0, 0.5, "600001", "now", "P2", None) for i in range(2000, 0, -1)]
    table = spark.createDataFrame(rows, "instrument_id bigint, trigger_count int, limit_up boolean, volume_ratio double, turnover_percentile double, code string, scan string, priority string, latest struct<days_old int>").repartition(5)
    for rank, name in ((radar.rank_radar, "radar_rank"), (radar.rank_queue, "queue_rank")):
        assert {r["instrument_id"]: r[name] for r in rank(table, ["scan"]).collect()} == {i: i for i in range(1, 2001)}


def test_outcomes_are_dealt_to_the_given_tasks(spark):
    table = spark.createDataFrame([(i, DAY + dt.timedelta(days=j), float(1 + (i * 7 + j) % 5)) for i in range(40) for j in range(30)], "instrument_id bigint, trade_date date, close double")
    whole, dealt = asof.later_outcomes(table, (5,)), asof.later_outcomes(table, (5,), parts=13)
    assert dealt.rdd.getNumPartitions() == 13 and sorted(whole.collect()) == sorted(dealt.collect())


def test_snapshots_equal_brute_force(spark):
    draw = random.Random(8)
    closes = {i: [round(draw.uniform(1, 9), 2) if draw.random() < 0.9 else None for _ in range(n)] for i, n in ((1, 97), (2, 3), (3, 1), (4, 60))}
    table = spark.createDataFrame([(i, DAY + dt.timedelta(days=2 * j), c) for i, own in closes.items() for j, c in enumerate(own)], "instrument_id bigint, trade_date date, close double").repartition(5)
    asked = [(i, DAY + dt.timedelta(days=draw.randint(-5, 210))) for i in (1, 2, 3, 4, 5) for _ in range(40)]
    requests = spark.createDataFrame([*asked, *asked, (1, None), (None, DAY)], "instrument_id bigint, as_of date")
    size = 62
    out = asof.historical_snapshot(requests, table, size)
    assert "Generate" not in out._jdf.queryExecution().toString()  # no request meets its sessions row by row
    rows = out.collect()
    got = {(r.instrument_id, r.as_of): r for r in rows}
    assert len(got) == len(rows) and set(got) == {(i, d) for i, d in asked if i in closes and d >= DAY}
    for (i, day), r in got.items():
        last = min((day - DAY).days // 2, len(closes[i]) - 1)
        own = closes[i][max(0, last - size + 1) : last + 1]
        back = lambda k, own=own: own[-1] / own[-1 - k] - 1 if len(own) > k and None not in (own[-1], own[-1 - k]) else None
        change = [b / a - 1 for a, b in zip(own, own[1:], strict=False) if None not in (a, b)]
        falls = [c / max(x for x in own[: n + 1] if x is not None) - 1 for n, c in enumerate(own) if c is not None]
        assert (r.effective, r.close, r.sessions, r.max_drawdown) == (DAY + dt.timedelta(days=2 * last), own[-1], len(own), min(falls, default=None))
        assert (r.return_20, r.return_60, r.return_61) == (back(20), back(60), back(61))
        want = statistics.stdev(change) * 250**0.5 if len(change) >= 2 else None
        assert r.volatility is None if want is None else abs(r.volatility - want) < 1e-9
    assert asof.historical_snapshot(requests, table.limit(0)).count() == asof.historical_snapshot(requests.limit(0), table).count() == 0
