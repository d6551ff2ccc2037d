"""Ranks over whole scans against a sort in Python."""

import random

from pyspark.sql import functions as F

from equity_jobs.operators.ranking import ranked


def test_ranked_equals_sort(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["big"] * 6 + ["a", "b", None]), draw.choice([None, 1, 2, 3, 4]), i, "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "scan string, score int, id int, rank_ string").repartition(7)
    order = [F.desc_nulls_last("score"), F.asc("id")]
    got = {r.id: r.place for r in ranked(table, order, "place", ["scan"]).collect()}
    want = {}
    for scan in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == scan), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: i for i, r in enumerate(own, 1)}
    assert got == want
    whole = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert {r.id: r.place for r in ranked(table, order, "place").collect()} == {r[2]: i for i, r in enumerate(whole, 1)}
    assert ranked(table.limit(0), order, "place", ["scan"]).count() == 0


def test_ranked_deals_out_one_scan_and_tied_rows(spark):
    table = spark.range(20_000).select(F.lit("all").alias("scan"), (F.col("id") % 2).alias("score"), "id")
    out = ranked(table, [F.desc("score"), F.asc("id")], "place", ["scan"])
    plan = out._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert out.agg(F.sum("place"), F.max("place")).first()[:] == (20_000 * 20_001 // 2, 20_000)
    tied = ranked(table.select("scan", F.lit(1).alias("score")), [F.desc("score")], "place", ["scan"])
    assert sorted(r.place for r in tied.collect()) == list(range(1, 20_001))
