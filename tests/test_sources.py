"""The election of a source, and the reconciliation of peer facts."""

import datetime as dt

from equity_jobs.operators import peers
from equity_jobs.sources import landed

D = [dt.date(2024, 1, i) for i in range(1, 9)]
BAR = "instrument_id bigint, trade_date date, open double, high double, low double, close double, volume double, amount double, pct_change double, turnover double, ingest_seq int, chunk int"


def bar(i, d, seq=1, chunk=1, high=3.0, volume=1.0):
    return (i, d, 2.0, high, 1.0, 2.0, volume, 1.0, None, None, seq, chunk)


def test_a_primary_of_unsound_rows_loses(spark):
    primary = [bar(1, D[0]), bar(1, D[1], chunk=1, volume=1.0), bar(1, D[1], chunk=2, volume=2.0), bar(1, D[2], seq=2, high=0.5), bar(1, D[2], seq=1), bar(2, D[0], high=0.1), bar(2, D[1], high=float("nan")), bar(2, None), bar(3, D[0])]
    fallback = [bar(1, D[0], volume=9.0), bar(2, D[0], volume=9.0), bar(2, D[3], volume=9.0), bar(2, D[4], high=0.1), bar(4, D[0], volume=9.0), bar(5, D[0], high=0.1)]
    first, second = spark.createDataFrame(primary, BAR), spark.createDataFrame(fallback, BAR).drop("chunk")
    got = {(r.instrument_id, r.trade_date): (r.source, r.volume) for r in landed.merge_sources(first, second).collect()}
    assert got == {(1, D[0]): ("primary", 1.0), (1, D[1]): ("primary", 2.0), (1, D[2]): ("primary", 1.0), (3, D[0]): ("primary", 1.0), (2, D[0]): ("fallback", 9.0), (2, D[3]): ("fallback", 9.0), (4, D[0]): ("fallback", 9.0)}
    seen = {(r.instrument_id, r.source, r.chunk): tuple(r)[3:] for r in landed.source_coverage(first, second).collect()}
    assert seen[1, "primary", 1] == (4, 3, D[0], D[2], 3, 0, True) and seen[1, "primary", 2] == (1, 1, D[1], D[1], 1, 1, True)
    assert seen[2, "primary", 1] == (3, 0, None, None, 0, 0, False) and seen[2, "fallback", 0] == (3, 2, D[0], D[3], 2, 0, True) and seen[5, "fallback", 0] == (1, 0, None, None, 0, 0, False)
    assert landed.merge_sources(first.limit(0), second.limit(0)).count() == 0


def test_each_differing_field_is_a_row(spark):
    kind = "company bigint, period_year int, company_name string, published_date date, report_title string, source_url string"
    amounts = ", revenue double, net_profit double, operating_cash_flow double, total_assets double"
    extra = ", cost double, inventory double, prior_inventory double, contract_liabilities double, prior_contract_liabilities double"
    same = ("A", D[0], "t", "u")
    points = spark.createDataFrame([(c, 2020, *same, 100.0, 10.0, 5.0 if c != 4 else -5.0, 200.0) for c in (1, 2, 3, 4, 5, 7)], kind + amounts)
    facts = spark.createDataFrame([(1, 2020, *same, 40.0, 20.0, 10.0, 30.0, 20.0), (2, 2020, "B", D[1], None, "u", 40.0, 20.0, 10.0, 30.0, 20.0), (3, 2020, *same, 100.0, 20.0, 10.0, 30.0, 20.0), (4, 2020, *same, 40.0, 20.0, 10.0, 30.0, 20.0), (6, 2020, *same, 40.0, 20.0, 10.0, 30.0, 20.0), (7, 2020, *same, 40.0, 20.0, 10.0, 30.0, None)], kind + extra)
    good, bad, differ = peers.enrich(points, facts)
    row = good.first()
    assert good.count() == 1 and (row.gross_margin, row.inventory_to_assets, row.inventory_growth, row.contract_liabilities_to_revenue, row.contract_liabilities_growth, row.cash_conversion) == (0.6, 0.1, 1.0, 0.3, 0.5, 0.5)
    assert {r.company: r.reason for r in bad.collect()} == {2: "identity", 3: "cost", 4: "amounts", 5: "no_facts", 6: "no_point", 7: "amounts"}
    assert {(r.company, r.field, r.point_value, r.fact_value) for r in differ.collect()} == {(2, "company_name", "A", "B"), (2, "published_date", "2024-01-01", "2024-01-02"), (2, "report_title", "t", None)}
