"""Records at many cut-offs against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from equity_jobs.operators import asof, fundamentals

DAY = dt.date(2000, 1, 1)


@pytest.mark.parametrize("many", [0, 1, 40])
def test_cutoffs_equal_brute_force(spark, many):
    draw = random.Random(many)
    day = lambda: DAY + dt.timedelta(days=draw.randint(0, 400))
    cuts = [day() for _ in range(many)] + [None] + ([DAY + dt.timedelta(days=200)] * 2 if many > 1 else [])
    rows = [(draw.randint(1, 5), draw.randint(2000, 2002), draw.randint(2002, 2004), draw.choice([day(), day(), None]), draw.choice(["original", "restated", None]), i, "x") for i in range(200)] + [(9, 2000, 2000, None, "original", 900, "x")]
    table = spark.createDataFrame(rows, "company bigint, period_year int, report_year int, published_date date, accounting_basis string, id int, reason string").repartition(4)
    frame = spark.createDataFrame([(c,) for c in cuts], "as_of date")
    days = sorted({c for c in cuts if c})
    assert sorted((r.as_of, r.id) for r in asof.point_in_time(table, frame).collect()) == sorted((c, r[5]) for c in days for r in rows if r[3] and r[3] <= c)
    late = {r.id: (r.excluded_at, r.reason) for r in asof.exclusions(table, frame).collect()}
    assert late == {r[5]: (n, "future" if r[3] else "undated") for r in rows if (n := sum(not r[3] or r[3] > c for c in days))}
    got = {(r.as_of, r.company): (r.accepted, r.restated, r.future, r.undated) for r in asof.counts_as_of(table, frame, ["company"], {"restated": F.col("accounting_basis") == "restated"}).collect()}
    want = {}
    for c in days:
        for company in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == company]
            seen = [r for r in own if r[3] and r[3] <= c]
            want[c, company] = (len(seen), sum(r[4] == "restated" for r in seen), sum(bool(r[3]) for r in own) - len(seen), sum(not r[3] for r in own))
    assert got == want
    latest = {(r.as_of, r.company, r.period_year): (r.published_date, r.report_year) for r in fundamentals.select_as_of(table, frame).collect()}
    best = {}
    for c in days:
        for r in rows:
            if r[3] and r[3] <= c:
                best[c, r[0], r[1]] = max(best.get((c, r[0], r[1]), (DAY, 0)), (r[3], r[2]))
    assert latest == best
