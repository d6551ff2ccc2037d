"""How bars are made: one pass over the line items, and tasks whose number grows with them."""

import datetime as dt
import random
import re
import statistics

import duckdb
import pytest

from equity_jobs.operators import bars
from equity_jobs.plans import catalog, views

DAY = dt.date(2020, 1, 1)
SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_raw_bars_are_the_view_in_one_pass(spark):
    got = views.view(spark, SF, "raw_bars")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{SF}/lineitem.parquet'")
    want = con.execute(views.duck("SELECT * FROM {raw_bars}"))
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert plan(views.view(spark, SF, "raw_bars")).count("FileScan") == 1 and plan(catalog.QUERIES["cl1_validate_bars"](spark, SF)).count("Exchange") == 1


@pytest.mark.parametrize(("name", "exchanges"), [("j1_fill_turnover", 2), ("cl11_effective_turnover", 2), ("cl1_validate_bars", 1), ("wn12_later_outcomes", 1)])
def test_tasks_grow_with_the_line_items(spark, monkeypatch, name, exchanges):
    monkeypatch.setattr(views, "ITEMS_A_TASK", 500)
    parts = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 500 + 1
    found = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", plan(catalog.QUERIES[name](spark, SF)))
    assert found == [(str(parts), "REPARTITION_BY_NUM")] * exchanges


def test_volume_ratio_and_counts_come_without_rolling_lists(spark):
    draw = random.Random(3)
    own = {1: [draw.choice([0.0, 1.0, 2.5, 7.0, None] if i < 60 else [0.0, 0.0, 4.0]) for i in range(120)], 2: [5.0] * 20, 3: [float(draw.randint(1, 9)) for _ in range(90)]}
    rows = [(i, DAY + dt.timedelta(days=n), 1.0 + n, v, None, v) for i, values in own.items() for n, v in enumerate(values)]
    table = spark.createDataFrame(rows, "instrument_id bigint, trade_date date, close double, volume double, pct_change double, turnover double").repartition(3)
    out = bars.features(table, averages=False, ranks=("turnover",))
    assert "percentile(volume" not in plan(out) and not {"ma5", "drawdown", "volume_percentile"} & set(out.columns)
    for r in out.collect():
        at, values = (r.trade_date - DAY).days, own[r.instrument_id]
        before = values[max(0, at - 20) : at]
        known = len(before) == 20 and None not in before and statistics.median(before) > 0
        assert r.volume_ratio == (values[at] / statistics.median(before) if known and values[at] is not None else None)
        assert (r.session, r.sessions_back) == (at + 1, len(values) - at)
        assert r.turnover_sessions == sum(v is not None for v in values[max(0, at - 250) : at])
