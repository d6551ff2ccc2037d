"""Domain views over the driver's tables, in SQL that Spark and DuckDB both read.

A view names the tables and views it reads in braces; `sql()` resolves them into one
statement, for Spark with the tables bound as DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # line items by supplier and ship date as daily bars; seq is the order in which rows arrived
    "priced": """
        SELECT l_suppkey AS instrument_id, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice / l_quantity AS price, l_quantity, l_extendedprice,
               (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS seq
        FROM {lineitem}""",
    "day_bars": """
        SELECT instrument_id, trade_date, min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close,
               sum(l_quantity) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount
        FROM {priced} GROUP BY instrument_id, trade_date""",
    "bars": """
        SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) % 10 = 0 THEN (close / open - 1) * 100 END AS pct_change,
               CASE WHEN day(trade_date) % 7 <> 0 THEN 100e0 * volume / (1000 + 10 * instrument_id) END AS turnover
        FROM {day_bars}""",
    "raw_bars": """
        SELECT instrument_id, trade_date, open, high, low, close, volume, amount, pct_change, turnover, 1 AS ingest_seq FROM {bars}
        UNION ALL SELECT instrument_id, trade_date, open, low - 1, high, close, volume, amount, pct_change, turnover, 2 FROM {bars} WHERE day(trade_date) = 3
        UNION ALL SELECT instrument_id, trade_date, open, high, 0e0, close, volume, amount, pct_change, turnover, 3 FROM {bars} WHERE day(trade_date) = 5
        UNION ALL SELECT instrument_id, trade_date, open, high * 2, low, high, volume + 1, amount, pct_change, turnover, 4 FROM {bars} WHERE day(trade_date) = 9
        UNION ALL SELECT instrument_id, trade_date, NULL, high, low, close, volume, amount, pct_change, turnover, 5 FROM {bars} WHERE day(trade_date) = 11""",
    "identity": """
        SELECT s_suppkey AS instrument_id,
               CASE s_suppkey % 7 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' WHEN 3 THEN '688' WHEN 4 THEN '830' WHEN 5 THEN '002' ELSE '777' END || lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0') AS code,
               CASE WHEN s_suppkey % 11 = 0 THEN 'ST ' ELSE '' END || s_name AS name
        FROM {supplier}""",
    "shares": """
        SELECT instrument_id, trade_date, volume, CASE WHEN day(trade_date) % 5 = 0 THEN NULL ELSE 1000e0 + 10 * instrument_id END AS outstanding_share,
               CASE WHEN day(trade_date) % 3 = 0 THEN NULL WHEN day(trade_date) = 20 THEN -1e0 ELSE volume / 2048e0 END AS turnover_fraction, 600e0 + 6 * instrument_id AS free_float, 1 AS ingest_seq
        FROM {bars}""",
    # one disclosure per order
    "disclosures_raw": """
        SELECT o_custkey % (SELECT count(*) FROM {supplier}) AS instrument_id, o_orderkey AS announcement_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN '关于立案调查的风险提示' WHEN '2-HIGH' THEN CAST(1 + year(o_orderdate) AS STRING) || '年年度报告' WHEN '3-MEDIUM' THEN '关于股份回购的进展'
                    WHEN '4-NOT SPECIFIED' THEN '董事会决议' ELSE '其他事项' END || CASE o_orderstatus WHEN 'P' THEN '（英文版）' WHEN 'O' THEN '' ELSE '（更新）' END AS title,
               CAST(o_orderdate AS DATE) AS published_date,
               CASE o_orderkey % 5 WHEN 0 THEN 'https://www.cninfo.com.cn/new/disclosure/detail?announcementId=' || lpad(CAST(o_orderkey AS STRING), 10, '0') || '&announcementTime=' || CAST(CAST(o_orderdate AS DATE) AS STRING)
                    WHEN 1 THEN 'http://www.sse.com.cn/x/' || CAST(o_orderkey AS STRING) WHEN 2 THEN 'https://disc.static.szse.cn/' || CAST(o_orderkey AS STRING) WHEN 3 THEN 'https://evil-cninfo.com.cn/x' ELSE 'ftp://www.bse.cn/x' END AS url
        FROM {orders}""",
    "disclosures": """
        SELECT instrument_id, announcement_id, title, published_date, url,
               CASE WHEN title LIKE '%风险提示%' THEN '监管与风险' WHEN title LIKE '%年度报告%' THEN '财务报告' WHEN title LIKE '%回购%' THEN '分红与回购' WHEN title LIKE '%董事%' THEN '公司治理' ELSE '其他公告' END AS category,
               CASE WHEN title LIKE '%风险提示%' OR title LIKE '%年度报告%' THEN '高' WHEN title LIKE '%回购%' OR title LIKE '%董事%' THEN '中' ELSE '低' END AS attention
        FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, title, published_date ORDER BY announcement_id) AS n FROM {disclosures_raw}
              WHERE url LIKE 'https://www.cninfo.com.cn/%' OR url LIKE 'http://www.sse.com.cn/%' OR url LIKE 'https://disc.static.szse.cn/%') WHERE n = 1""",
    "checkpoints": """
        SELECT s_suppkey AS instrument_id, CASE s_suppkey % 4 WHEN 1 THEN CAST('1998-06-15' AS DATE) WHEN 2 THEN CAST('1995-03-01' AS DATE) WHEN 3 THEN CAST('2030-01-01' AS DATE) END AS checked_on
        FROM {supplier}""",
    # limit-up pool: as delivered, with repeated codes
    "board_raw": """
        SELECT CAST(l_shipdate AS DATE) AS trade_date, CAST(l_partkey AS STRING) || '.0' AS code, p_name AS name, p_type AS industry_raw, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS streak_raw,
               CASE WHEN l_quantity % 11 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 4 END AS breaks_raw, CAST(90000 + l_orderkey * 37 % 70000 AS STRING) AS first_time_raw, l_extendedprice AS funds_raw,
               CASE WHEN l_linestatus = 'O' AND l_quantity % 5 = 0 THEN -1e0 ELSE 100 * l_tax END AS turnover_raw, l_extendedprice * 2 AS amount_raw, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS ingest_seq
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    # yearly figures as published: the original, and for every third company a later restatement
    "yearly": """
        SELECT l_suppkey AS company, CAST(year(l_shipdate) AS INT) AS period_year, sum(CASE WHEN l_linenumber <= 4 THEN cents END) / 100e0 AS revenue0, sum(cents) / 100e0 AS revenue1, sum(CASE WHEN l_linenumber <= 4 THEN cents * disc END) / 10000e0 AS profit0, sum(cents * disc) / 10000e0 AS profit1,
               sum(CASE WHEN l_linenumber <= 4 THEN cents * (tax - 3) END) / 10000e0 AS cash0, sum(cents * (tax - 3)) / 10000e0 AS cash1
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax FROM {lineitem}) WHERE NOT (l_suppkey % 10 = 3 AND year(l_shipdate) = 1998) GROUP BY l_suppkey, CAST(year(l_shipdate) AS INT)""",
    "vintages": """
        SELECT company, period_year, report_year, published_date, accounting_basis, revenue, profit AS net_profit, cash AS operating_cash_flow, 2 * revenue AS total_assets, 2 * revenue * (company % 10) / 10e0 AS total_liabilities
        FROM (SELECT company, period_year, period_year AS report_year, make_date(period_year + 1, 3, 31) AS published_date, 'original' AS accounting_basis, revenue0 AS revenue, profit0 AS profit, cash0 AS cash FROM {yearly} WHERE revenue0 > 0
              UNION ALL SELECT company, period_year, period_year + 1, make_date(period_year + 2, 4, 15), 'restated', revenue1, profit1, cash1 FROM {yearly} WHERE company % 3 = 0)""",
    "peers": """
        SELECT s_suppkey AS company, s_name AS company_name, n_name AS peer_group, r_name AS scope FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "cutoffs": """SELECT CAST(d AS DATE) AS as_of FROM (VALUES ('1996-04-01'), ('1998-04-15'), ('2002-12-31')) AS t(d)""",
    # bridge components: this year against last, by return flag and line status
    "bridge": """
        SELECT l_suppkey AS company, year(l_shipdate) AS period_year, l_returnflag || l_linestatus AS component, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS value
        FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate), l_returnflag || l_linestatus""",
}


def _needs(body: str, found: dict[str, str]) -> dict[str, str]:
    """The views that body reads, each after those it reads itself."""
    for name in re.findall(r"\{(\w+)\}", body):
        if name in VIEWS and name not in found:
            _needs(VIEWS[name], found)
            found[name] = VIEWS[name]
    return found


def sql(body: str) -> str:
    """body with its views as common table expressions; tables stay in braces."""
    views = _needs(body, {})
    plain = lambda text: re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in VIEWS else m[0], text)
    parts = [f"{name} AS ({plain(text)})" for name, text in views.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + plain(body)


def duck(body: str) -> str:
    """The statement for DuckDB; a body that begins with WITH goes on from the views."""
    text = re.sub(r"\{(\w+)\}", r"\1", sql(body))
    return re.sub(r"\)\s+WITH\s", "), ", text, count=1) if text.startswith("WITH") and body.lstrip().upper().startswith("WITH") else text


ITEMS_A_TASK = 100_000


def dealt(items: DataFrame, *keys: str | Column) -> DataFrame:
    """Line items dealt out by keys, a task for every 100,000 of them (their number comes from the files' footers), so what a task holds does not grow with the table."""
    return items.repartition(items.count() // ITEMS_A_TASK + 1, *keys)


def view(spark: SparkSession, sf_dir: str, name: str, daily: bool = False) -> DataFrame:
    """A view as a DataFrame.

    Bars are made of line items that are dealt out by supplier, so they and the windows of an
    instrument need no other exchange. With daily the line items are dealt out by supplier
    and day: for what joins on (instrument, date) and reads no column that needs such a window.
    """
    if name == "raw_bars":
        return raw_bars(view(spark, sf_dir, "bars"))
    text = sql(f"SELECT * FROM {{{name}}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", text))}
    if "priced" in _needs(f"{{{name}}}", {}):
        tables["lineitem"] = dealt(tables["lineitem"], "l_suppkey", *([F.col("l_shipdate").cast("date")] if daily else []))
    return spark.sql(text, **tables)


def raw_bars(bars: DataFrame) -> DataFrame:
    """The view raw_bars in one pass: each bar with the copies that its day calls for, where the view reads bars five times."""
    day = F.day("trade_date")

    def copy(seq: int, **changed: Column) -> Column:
        kept = ("open", "high", "low", "close", "volume")
        return F.struct(*((changed[c].cast("double") if c in changed else F.col(c)).alias(c) for c in kept), F.lit(seq).alias("ingest_seq"))

    copies = F.array(
        copy(1), F.when(day == 3, copy(2, high=F.col("low") - 1, low=F.col("high"))), F.when(day == 5, copy(3, low=F.lit(0))),
        F.when(day == 9, copy(4, high=F.col("high") * 2, close=F.col("high"), volume=F.col("volume") + 1)), F.when(day == 11, copy(5, open=F.lit(None))),
    )
    rows = bars.withColumn("_copy", F.explode(F.array_compact(copies)))
    return rows.select("instrument_id", "trade_date", *(f"_copy.{c}" for c in ("open", "high", "low", "close", "volume")), "amount", "pct_change", "turnover", "_copy.ingest_seq")
