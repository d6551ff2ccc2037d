"""Queries of the disclosure, as-of, analog, fundamentals and peer jobs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from equity_jobs.functions import rules
from equity_jobs.operators import analogs, asof, constraints, disclosures, fundamentals, identity, peers
from equity_jobs.operators import bars as B
from equity_jobs.plans.market import EVENTS, FEATURED, LIMITED, signalled, six
from equity_jobs.plans.registry import Registry
from equity_jobs.plans.views import duck, view
from equity_jobs.sources.shared import written

R = Registry()
TODAY = "1998-07-01"
ALLOWED = "(url LIKE 'https://www.cninfo.com.cn/%' OR url LIKE 'http://www.sse.com.cn/%' OR url LIKE 'https://disc.static.szse.cn/%')"
CATEGORY = """CASE WHEN regexp_matches(title, '退市|立案|处罚|风险提示|重大诉讼') THEN '监管与风险' WHEN regexp_matches(title, '年度报告|季度报告|半年报') THEN '财务报告' WHEN regexp_matches(title, '业绩预告|业绩快报') THEN '业绩动态' WHEN regexp_matches(title, '回购|分红|权益分派') THEN '分红与回购'
  WHEN regexp_matches(title, '增持|减持|股权变动') THEN '股权与资本' WHEN regexp_matches(title, '董事|监事|高管|治理') THEN '公司治理' WHEN regexp_matches(title, '合同|项目|投资|并购') THEN '经营动态' ELSE '其他公告' END"""
NORMAL = f"""normal AS (SELECT instrument_id, announcement_id, title, published_date, url, {CATEGORY} AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument_id, title, published_date ORDER BY announcement_id) AS n FROM {{disclosures_raw}} WHERE {ALLOWED}) WHERE n = 1),
graded AS (SELECT *, CASE WHEN category IN ('监管与风险', '财务报告', '业绩动态') THEN '高' WHEN category = '其他公告' THEN '低' ELSE '中' END AS attention FROM normal)"""
WINDOWS = f"""win AS (SELECT instrument_id, CASE WHEN fresh THEN DATE '{TODAY}' - 29 ELSE greatest(checked_on, DATE '{TODAY}' - 364) END AS start_date, DATE '{TODAY}' AS end_date, CASE WHEN NOT fresh THEN checked_on END AS baseline, CASE WHEN fresh THEN '首次基准' ELSE '增量复核' END AS mode,
  NOT fresh AND checked_on < DATE '{TODAY}' - 364 AS truncated FROM (SELECT *, checked_on IS NULL OR checked_on > DATE '{TODAY}' AS fresh FROM {{checkpoints}}))"""
ITEMS = """items AS (SELECT g.*, baseline, CASE WHEN baseline IS NULL THEN '首次基准' WHEN published_date = baseline THEN '同日待复核' ELSE '新增' END AS status,
  CASE WHEN category IN ('财务报告', '业绩动态') THEN '财务与业绩' WHEN category = '经营动态' THEN '经营事项' WHEN category IN ('分红与回购', '股权与资本') THEN '资本运作' WHEN category IN ('公司治理', '监管与风险') THEN '治理与风险' ELSE '其他' END AS "group"
  FROM graded g JOIN win w ON g.instrument_id = w.instrument_id AND published_date BETWEEN start_date AND end_date)"""


def day(text):
    return F.lit(text).cast("date")


def normal(spark, sf):
    return disclosures.normalise(view(spark, sf, "disclosures_raw"))


def windows(spark, sf):
    return disclosures.evidence_windows(view(spark, sf, "checkpoints"), day(TODAY))


def items(spark, sf):
    return disclosures.delta_items(normal(spark, sf), windows(spark, sf))


@R.query("cl8_disclosure_urls", f"""SELECT announcement_id, {ALLOWED} AS allowed, CASE WHEN url LIKE 'https://www.cninfo.com.cn/%' THEN 'https://static.cninfo.com.cn/finalpage/' || published_date::VARCHAR || '/' || lpad(announcement_id::VARCHAR, 10, '0') || '.PDF' END AS pdf_url FROM {{disclosures_raw}}""")
def cl8(spark, sf):
    return view(spark, sf, "disclosures_raw").select("announcement_id", rules.allowed_url(F.col("url")).alias("allowed"), rules.static_pdf_url(F.col("url")).alias("pdf_url"))


@R.query("ds1_normalise_disclosures", f"WITH {NORMAL} SELECT instrument_id, announcement_id, title, published_date, category, attention FROM graded")
def ds1(spark, sf):
    return normal(spark, sf).select("instrument_id", "announcement_id", "title", "published_date", "category", "attention")


@R.query("ds2_classify_titles", f"WITH {NORMAL}, c AS (SELECT title, {CATEGORY} AS category FROM {{disclosures_raw}}) SELECT category, CASE WHEN category IN ('监管与风险', '财务报告', '业绩动态') THEN '高' WHEN category = '其他公告' THEN '低' ELSE '中' END AS attention, count(*) AS titles FROM c GROUP BY category")
def ds2(spark, sf):
    category, attention = rules.classify(F.col("title"))
    return view(spark, sf, "disclosures_raw").groupBy(category.alias("category"), attention.alias("attention")).agg(F.count("*").alias("titles"))


@R.query("ds3_evidence_windows", f"WITH {WINDOWS} SELECT instrument_id, start_date, end_date, baseline, mode, truncated FROM win")
def ds3(spark, sf):
    return windows(spark, sf).select("instrument_id", "start_date", "end_date", "baseline", "mode", "truncated")


@R.query("ds3_delta_items", f"""WITH {NORMAL}, {WINDOWS}, {ITEMS} SELECT instrument_id, announcement_id, status, "group" FROM items""")
def ds3_items(spark, sf):
    return items(spark, sf).select("instrument_id", "announcement_id", "status", "group")


@R.query(
    "tk5_delta_order",
    f"""WITH {NORMAL}, {WINDOWS}, {ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY published_date DESC, CASE attention WHEN '高' THEN 0 WHEN '中' THEN 1 ELSE 2 END, title DESC, announcement_id)::INTEGER AS place, count(*) OVER (PARTITION BY instrument_id) AS total FROM items)
    SELECT instrument_id, announcement_id, place, total, total > 100 AS limited FROM o WHERE place <= 100""",
)
def tk5(spark, sf):
    return disclosures.delta_ranked(items(spark, sf)).select("instrument_id", "announcement_id", "place", "total", "limited")


GROUPS = ", ".join(f"""coalesce(count(*) FILTER (i."group" = '{g}'), 0) AS group_{n}""" for n, g in enumerate(rules.EVIDENCE_GROUP_ORDER))


@R.query("ag7_group_counts", f"WITH {NORMAL}, {WINDOWS}, {ITEMS} SELECT c.instrument_id, count(i.announcement_id) AS total, count(*) FILTER (i.attention = '高') AS high, {GROUPS} FROM {{checkpoints}} c LEFT JOIN items i ON c.instrument_id = i.instrument_id GROUP BY c.instrument_id")
def ag7(spark, sf):
    return disclosures.group_counts(items(spark, sf), view(spark, sf, "checkpoints"))


ANNUAL = """ann AS (SELECT *, try_cast(nullif(regexp_extract(title, '((?:19|20)[0-9][0-9])年年度报告', 1), '') AS INTEGER) AS report_year, regexp_matches(title, '英文(?:版|译本)?|English', 'i')::INTEGER AS translated FROM graded
  WHERE regexp_matches(title, '年度报告') AND NOT regexp_matches(title, '半年度报告|摘要|取消|问询|回复'))"""


@R.query("tk6_latest_annual", f"""WITH {NORMAL}, {ANNUAL}, t AS (SELECT *, max(report_year) OVER (PARTITION BY instrument_id) AS top FROM ann), k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY translated, published_date DESC, announcement_id) AS n FROM t WHERE top IS NULL OR report_year = top)
SELECT instrument_id, announcement_id, report_year, translated FROM k WHERE n = 1""")
def tk6(spark, sf):
    return disclosures.latest_annual(normal(spark, sf)).select("instrument_id", "announcement_id", "report_year", "translated")


@R.query("tk7_recent_annual", f"""WITH {NORMAL}, {ANNUAL}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, report_year ORDER BY translated, published_date DESC, announcement_id) AS n FROM ann WHERE report_year IS NOT NULL), d AS (SELECT *, dense_rank() OVER (PARTITION BY instrument_id ORDER BY report_year DESC)::INTEGER AS place FROM k WHERE n = 1)
SELECT instrument_id, report_year, announcement_id, place FROM d WHERE place <= 3""")
def tk7(spark, sf):
    return disclosures.recent_annual(normal(spark, sf)).select("instrument_id", "report_year", "announcement_id", "place")


def theses(spark, sf):
    topic = F.when(F.col("o_orderkey") % 3 == 0, "财务与业绩").when(F.col("o_orderkey") % 3 == 1, "治理与风险").otherwise("资本运作")
    count = spark.read.parquet(f"{sf}/supplier.parquet").count()
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("thesis_id"), (F.col("o_custkey") % count).alias("instrument_id"), topic.alias("topic"), F.col("o_orderstatus").alias("status"))


@R.query(
    "j11_thesis_evidence",
    f"""WITH {NORMAL}, {WINDOWS}, {ITEMS}, th AS (SELECT o_orderkey AS thesis_id, o_custkey % (SELECT count(*) FROM supplier) AS instrument_id, CASE o_orderkey % 3 WHEN 0 THEN '财务与业绩' WHEN 1 THEN '治理与风险' ELSE '资本运作' END AS topic FROM orders),
    k AS (SELECT thesis_id, announcement_id, row_number() OVER (PARTITION BY thesis_id ORDER BY published_date DESC, title DESC, announcement_id)::INTEGER AS place FROM th JOIN items i ON th.instrument_id = i.instrument_id AND th.topic = i."group")
    SELECT * FROM k WHERE place <= 5""",
)
def j11(spark, sf):
    return disclosures.thesis_evidence(theses(spark, sf), items(spark, sf)).select("thesis_id", "announcement_id", "place")


@R.query("ag7_thesis_status", """SELECT count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", 0::BIGINT AS "X" FROM orders""")
def ag7_status(spark, sf):
    return disclosures.status_counts(theses(spark, sf), ["O", "P", "X"])


REQUESTS = "requests AS (SELECT DISTINCT instrument_id, published_date AS as_of FROM {disclosures})"


def requests(spark, sf):
    return view(spark, sf, "disclosures").select("instrument_id", F.col("published_date").alias("as_of")).distinct()


@R.query("j2_sessions_around", f"WITH {REQUESTS} SELECT r.instrument_id, r.as_of, max(trade_date) FILTER (trade_date <= as_of) AS effective, min(trade_date) FILTER (trade_date > as_of) AS next FROM requests r JOIN {{bars}} b ON r.instrument_id = b.instrument_id GROUP BY r.instrument_id, r.as_of")
def j2(spark, sf):
    return asof.sessions_around(requests(spark, sf), view(spark, sf, "bars"))


CHAIN = f"""{FEATURED}, {LIMITED}, {EVENTS}, ev AS (SELECT instrument_id, trade_date AS event_date FROM fired),
hits AS (SELECT e.instrument_id, e.event_date, announcement_id, title, date_diff('day', published_date, event_date)::INTEGER AS gap FROM ev e JOIN {{disclosures}} d ON e.instrument_id = d.instrument_id AND published_date BETWEEN event_date - 6 AND event_date)"""


def fired(spark, sf):
    """All events, written: joins that read them twice compute the features once."""
    return written(B.activity_events(signalled(spark, sf), view(spark, sf, "identity"), top=None), "events")


@R.query("j3_evidence_chain", f"WITH {CHAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, event_date ORDER BY gap, title, announcement_id)::INTEGER AS place FROM hits) SELECT instrument_id, event_date, announcement_id, gap, CASE WHEN gap = 0 THEN 'same_day' ELSE 'before' END AS relation, place FROM k WHERE place <= 5")
def j3(spark, sf):
    chain, _ = asof.evidence_chain(fired(spark, sf).withColumnRenamed("trade_date", "event_date"), view(spark, sf, "disclosures"))
    return chain.select("instrument_id", "event_date", "announcement_id", "gap", "relation", "place")


@R.query(
    "j3_evidence_summary",
    f"""WITH {CHAIN}, s AS (SELECT instrument_id, event_date, count(*) AS matched, count(*) FILTER (gap = 0) AS same_day, min(gap) AS nearest_gap FROM hits GROUP BY instrument_id, event_date)
    SELECT e.instrument_id, e.event_date, coalesce(matched, 0) AS matched, coalesce(same_day, 0) AS same_day, nearest_gap, (SELECT count(*) FROM {{disclosures}} d WHERE d.instrument_id = e.instrument_id AND d.published_date > e.event_date) AS future_excluded,
    CASE WHEN same_day > 0 THEN 'same_day' WHEN matched > 0 THEN 'before' ELSE 'none' END AS status FROM ev e LEFT JOIN s USING (instrument_id, event_date)""",
)
def j3_summary(spark, sf):
    _, summary = asof.evidence_chain(fired(spark, sf).withColumnRenamed("trade_date", "event_date"), view(spark, sf, "disclosures"))
    return summary.select("instrument_id", "event_date", "matched", "same_day", "nearest_gap", "future_excluded", "status")


@R.query(
    "wn11_historical_snapshot",
    f"""WITH {REQUESTS}, num AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS session FROM {{bars}}), last AS (SELECT r.instrument_id, r.as_of, max(session) AS last, max(trade_date) AS effective FROM requests r JOIN num n ON r.instrument_id = n.instrument_id AND n.trade_date <= r.as_of GROUP BY r.instrument_id, r.as_of),
    w AS (SELECT l.*, n.session, n.close, n.close / lag(n.close) OVER s - 1 AS ret, n.close / max(n.close) OVER s - 1 AS down FROM last l JOIN num n ON l.instrument_id = n.instrument_id AND n.session BETWEEN l.last - 250 AND l.last WINDOW s AS (PARTITION BY l.instrument_id, l.as_of ORDER BY n.session))
    SELECT instrument_id, as_of, effective, max(close) FILTER (session = last) AS close, round(max(close) FILTER (session = last) / max(close) FILTER (session = last - 20) - 1, 6) AS return_20, round(max(close) FILTER (session = last) / max(close) FILTER (session = last - 250) - 1, 6) AS return_250,
    round(stddev_samp(ret) * sqrt(250e0), 6) AS volatility, round(min(down), 6) AS max_drawdown, count(*) AS sessions FROM w GROUP BY instrument_id, as_of, effective""",
)
def wn11(spark, sf):
    return asof.historical_snapshot(requests(spark, sf), view(spark, sf, "bars")).select("instrument_id", "as_of", "effective", "close", *six("return_20", "return_250", "volatility", "max_drawdown"), "sessions")


HORIZONS = (20, 60, 120)
OUTCOME = """max(d) FILTER (k = #) AS date_#, round(max(close / start - 1) FILTER (k = #), 6) AS return_#, CASE WHEN max(k) >= # THEN round(max(close / start - 1) FILTER (k <= #), 6) END AS gain_#, CASE WHEN max(k) >= # THEN round(min(close / peak - 1) FILTER (k <= #), 6) END AS fall_#,
    CASE WHEN max(k) >= # THEN 'ok' ELSE 'insufficient_future_data' END AS status_#"""


@R.query(
    "wn12_later_outcomes",
    f"""WITH num AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trade_date) AS session FROM {{bars}}), path AS (SELECT b.instrument_id, b.trade_date, b.close AS start, n.session - b.session AS k, n.close, n.trade_date AS d, max(n.close) OVER (PARTITION BY b.instrument_id, b.trade_date ORDER BY n.session) AS peak FROM num b JOIN num n ON b.instrument_id = n.instrument_id AND n.session BETWEEN b.session AND b.session + 120)
    SELECT instrument_id, trade_date, {", ".join(OUTCOME.replace("#", str(k)) for k in HORIZONS)} FROM path GROUP BY instrument_id, trade_date""",
)
def wn12(spark, sf):
    made = [c for k in HORIZONS for c in (f"date_{k}", *six(f"return_{k}", f"gain_{k}", f"fall_{k}"), f"status_{k}")]
    # bars are dealt out with a bounded number a task already
    return asof.later_outcomes(view(spark, sf, "bars"), HORIZONS).select("instrument_id", "trade_date", *made)


@R.query(
    "j5_analogs",
    f"""WITH {FEATURED}, {LIMITED}, {EVENTS}, e AS (SELECT instrument_id, trade_date, daily_return AS r, volume_ratio AS v, turnover_percentile AS t, list_filter([CASE WHEN lu THEN '涨停候选' END, CASE WHEN hv THEN '明显放量' END, CASE WHEN ht THEN '普通换手率高位' END], lambda x: x IS NOT NULL) AS sig FROM fired),
    p AS (SELECT s.instrument_id, s.trade_date AS event_date, c.trade_date AS analog_date, list_sort(list_intersect(s.sig, c.sig)) AS shared, len(list_intersect(s.sig, c.sig)) / len(list_distinct(list_concat(s.sig, c.sig))) AS jac,
      greatest(0, 1 - abs(s.r - c.r) / 0.1e0) AS a, CASE WHEN s.r IS NULL OR c.r IS NULL THEN 0 ELSE 1 END AS ka, CASE WHEN s.v > 0 AND c.v > 0 THEN greatest(0, 1 - abs(log2(s.v / c.v)) / 2) END AS b, CASE WHEN s.v > 0 AND c.v > 0 THEN 1 ELSE 0 END AS kb,
      greatest(0, 1 - abs(s.t - c.t)) AS d, CASE WHEN s.t IS NULL OR c.t IS NULL THEN 0 ELSE 1 END AS kd FROM e s JOIN e c ON s.instrument_id = c.instrument_id AND c.trade_date < s.trade_date),
    q AS (SELECT *, (jac * 0.4e0 + CASE WHEN ka = 1 THEN a * 0.2e0 ELSE 0 END + CASE WHEN kb = 1 THEN b * 0.2e0 ELSE 0 END + CASE WHEN kd = 1 THEN d * 0.2e0 ELSE 0 END) / (0.4e0 + (ka + kb + kd) * 0.2e0) AS score FROM p WHERE ka + kb + kd >= 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, event_date ORDER BY round(score, 9) DESC, analog_date DESC)::INTEGER AS place FROM q WHERE score >= 0.25e0)
    SELECT instrument_id, event_date, analog_date, round(score, 6) AS score, (1 + ka + kb + kd)::INTEGER AS components, array_to_string(shared, ',') AS shared, place FROM k WHERE place <= 3""",
)
def j5(spark, sf):
    events = fired(spark, sf)
    return analogs.find_analogs(events, events).select("instrument_id", "event_date", "analog_date", *six("score"), "components", F.concat_ws(",", "shared").alias("shared"), "place")


# ---- fundamentals

SELECTED = """sel AS (SELECT * EXCLUDE (n) FROM (SELECT c.as_of, v.*, row_number() OVER (PARTITION BY c.as_of, company, period_year ORDER BY published_date DESC, report_year DESC) AS n FROM {vintages} v JOIN {cutoffs} c ON v.published_date <= c.as_of) WHERE n = 1)"""
POINTS = f"""{SELECTED}, pts0 AS (SELECT *, net_profit / nullif(revenue, 0) AS net_margin, operating_cash_flow / nullif(net_profit, 0) AS cash_conversion, total_liabilities / nullif(total_assets, 0) AS liabilities_to_assets FROM sel),
pts AS (SELECT *, (revenue - lag(revenue) OVER w) / abs(nullif(lag(revenue) OVER w, 0)) AS revenue_growth, (net_profit - lag(net_profit) OVER w) / abs(nullif(lag(net_profit) OVER w, 0)) AS net_profit_growth, (operating_cash_flow - lag(operating_cash_flow) OVER w) / abs(nullif(lag(operating_cash_flow) OVER w, 0)) AS operating_cash_flow_growth,
  net_margin - lag(net_margin) OVER w AS net_margin_change, liabilities_to_assets - lag(liabilities_to_assets) OVER w AS liabilities_to_assets_change FROM pts0 WINDOW w AS (PARTITION BY as_of, company ORDER BY period_year))"""


def points(spark, sf):
    return fundamentals.trend_points(fundamentals.select_as_of(view(spark, sf, "vintages"), view(spark, sf, "cutoffs")))


@R.query("cl13_point_in_time", "SELECT as_of, company, count(*) FILTER (published_date <= as_of) AS accepted, count(*) FILTER (published_date > as_of) AS excluded FROM {vintages}, {cutoffs} GROUP BY as_of, company")
def cl13(spark, sf):
    counts = asof.counts_as_of(view(spark, sf, "vintages"), view(spark, sf, "cutoffs"), ["company"])
    return counts.select("as_of", "company", "accepted", F.col("future").alias("excluded"))


@R.query("cl13_accepted_records", "SELECT as_of, company, period_year, report_year, published_date FROM {vintages}, {cutoffs} WHERE published_date <= as_of")
def cl13_accepted(spark, sf):
    return asof.point_in_time(view(spark, sf, "vintages"), view(spark, sf, "cutoffs")).select("as_of", "company", "period_year", "report_year", "published_date")


@R.query("cl13_excluded_records", "SELECT company, period_year, report_year, count(*)::INTEGER AS excluded_at, 'future' AS reason FROM {vintages}, {cutoffs} WHERE published_date > as_of GROUP BY company, period_year, report_year")
def cl13_excluded(spark, sf):
    return asof.exclusions(view(spark, sf, "vintages"), view(spark, sf, "cutoffs")).select("company", "period_year", "report_year", "excluded_at", "reason")


@R.query("wn9_latest_vintage", f"WITH {SELECTED} SELECT as_of, company, period_year, report_year, published_date, accounting_basis, revenue FROM sel")
def wn9(spark, sf):
    return fundamentals.select_as_of(view(spark, sf, "vintages"), view(spark, sf, "cutoffs")).select("as_of", "company", "period_year", "report_year", "published_date", "accounting_basis", "revenue")


@R.query("wn9_vintage_counts", "SELECT as_of, company, count(*) FILTER (published_date <= as_of) AS available, count(*) FILTER (published_date > as_of) AS future, count(*) FILTER (published_date <= as_of AND accounting_basis = 'restated') AS restated FROM {vintages}, {cutoffs} GROUP BY as_of, company")
def wn9_counts(spark, sf):
    return fundamentals.vintage_counts(view(spark, sf, "vintages"), view(spark, sf, "cutoffs"))


CHANGES = ["net_margin", "cash_conversion", "liabilities_to_assets", "revenue_growth", "net_profit_growth", "operating_cash_flow_growth", "net_margin_change", "liabilities_to_assets_change"]


@R.query("wn10_trend_points", f"WITH {POINTS} SELECT as_of, company, period_year, {', '.join(f'round({c}, 6) AS {c}' for c in CHANGES)} FROM pts")
def wn10(spark, sf):
    return points(spark, sf).select("as_of", "company", "period_year", *six(*CHANGES))


@R.query(
    "ag11_trend_review",
    f"""WITH {POINTS}, g AS (SELECT as_of, company, min(period_year) AS start_year, max(period_year) AS end_year, count(*) AS periods, min_by(revenue, period_year) AS r0, max_by(revenue, period_year) AS r1, arg_max_null(revenue_growth, period_year) AS rg, arg_max_null(net_profit_growth, period_year) AS pg, arg_max_null(operating_cash_flow_growth, period_year) AS cg,
      count(*) FILTER (accounting_basis = 'restated') AS restatements FROM pts GROUP BY as_of, company)
    SELECT as_of, company, start_year::INTEGER AS start_year, end_year::INTEGER AS end_year, periods, round(CASE WHEN end_year > start_year AND r0 > 0 AND r1 > 0 THEN pow(r1 / r0, 1.0 / (end_year - start_year)) - 1 END, 6) AS revenue_cagr, restatements,
    CASE WHEN rg IS NULL OR pg IS NULL THEN '比较期不足' WHEN sign(rg) = sign(pg) THEN '收入与利润同向' ELSE '收入与利润方向不一致' END AS growth_alignment, CASE WHEN pg IS NULL OR cg IS NULL THEN '比较期不足' WHEN sign(pg) = sign(cg) THEN '利润与经营现金同向' ELSE '利润与经营现金方向不一致' END AS cash_alignment FROM g""",
)
def ag11(spark, sf):
    return fundamentals.trend_review(points(spark, sf)).select("as_of", "company", "start_year", "end_year", "periods", *six("revenue_cagr"), "restatements", "growth_alignment", "cash_alignment")


def candidates(spark, sf):
    """Vintages with the identity and source columns of a governed file, some of them spoilt, some twice."""
    c = F.col("company")
    url = F.when(c % 13 == 0, "http://www.cninfo.com.cn/a").when(c % 13 == 1, "https://cninfo.com.cn.evil.org/a").otherwise("https://static.cninfo.com.cn/a.PDF")
    name = F.concat(F.lit("C"), c.cast("string"))
    rows = view(spark, sf, "vintages").withColumns(
        {
            "company_name": F.when(c % 17 == 0, " ").when((c % 21 == 4) & (F.col("accounting_basis") == "restated"), F.concat(name, F.lit(" new"))).otherwise(name), "source_url": url, "report_title": F.when(c % 23 == 1, "").otherwise(F.concat(F.col("report_year").cast("string"), F.lit("年年度报告"))),
            "evidence_grade": F.when(c % 7 == 0, "B").otherwise("A"), "verification_status": F.when(c % 5 == 0, "candidate").otherwise("verified"), "total_liabilities": F.when(c % 9 == 8, F.col("total_assets") * 2).otherwise(F.col("total_liabilities")),
            "summary_page": F.when(c % 19 == 2, 0).otherwise(5), "balance_sheet_page": F.when(c % 19 != 3, 60),
        }
    )
    return rows.unionByName(rows.where("company % 29 = 5 and accounting_basis = 'original'"))


CANDIDATES = """cand0 AS (SELECT * REPLACE (CASE WHEN company % 9 = 8 THEN total_assets * 2 ELSE total_liabilities END AS total_liabilities), CASE WHEN company % 17 = 0 THEN ' ' WHEN company % 21 = 4 AND accounting_basis = 'restated' THEN 'C' || company || ' new' ELSE 'C' || company END AS company_name, CASE WHEN company % 23 = 1 THEN '' ELSE report_year || '年年度报告' END AS report_title,
  CASE WHEN company % 13 = 0 THEN 'http://www.cninfo.com.cn/a' WHEN company % 13 = 1 THEN 'https://cninfo.com.cn.evil.org/a' ELSE 'https://static.cninfo.com.cn/a.PDF' END AS source_url FROM {vintages}), cand1 AS (FROM cand0 UNION ALL FROM cand0 WHERE company % 29 = 5 AND accounting_basis = 'original'),
cand2 AS (SELECT *, concat_ws('/', company, period_year, report_year, published_date) AS k FROM cand1),
cand AS (SELECT *, count(*) OVER (PARTITION BY k) AS times, min({{'v': company_name, 'k': k}}) OVER (PARTITION BY company) AS fst, max({{'v': company_name, 'k': k}}) OVER (PARTITION BY company) AS lst FROM cand2),
led AS (SELECT *, list_filter([CASE WHEN company % 17 = 0 THEN {{'rule': 'identity', 'value': company_name, 'partner': NULL::VARCHAR}} END, CASE WHEN company % 23 = 1 THEN {{'rule': 'report_title', 'value': report_title, 'partner': NULL}} END, CASE WHEN company % 13 IN (0, 1) THEN {{'rule': 'source', 'value': source_url, 'partner': NULL}} END,
  CASE WHEN company % 7 = 0 THEN {{'rule': 'grade', 'value': 'B', 'partner': NULL}} END, CASE WHEN company % 5 = 0 THEN {{'rule': 'status', 'value': 'candidate', 'partner': NULL}} END, CASE WHEN NOT (revenue > 0 AND net_profit > 0 AND operating_cash_flow > 0 AND total_assets > 0 AND total_liabilities > 0) THEN {{'rule': 'amounts', 'value': NULL, 'partner': NULL}} END,
  CASE WHEN company % 19 IN (2, 3) THEN {{'rule': 'pages', 'value': NULL, 'partner': NULL}} END, CASE WHEN total_liabilities > total_assets THEN {{'rule': 'balance', 'value': NULL, 'partner': NULL}} END, CASE WHEN times > 1 THEN {{'rule': 'unique', 'value': k, 'partner': k}} END,
  CASE WHEN fst.v <> lst.v THEN {{'rule': 'one_name', 'value': company_name, 'partner': CASE WHEN company_name = fst.v THEN lst.k ELSE fst.k END}} END], lambda x: x IS NOT NULL) AS vs FROM cand)""".replace("{{", "{").replace("}}", "}")


@R.query("cl4_validate_vintages", f"WITH {CANDIDATES} SELECT company, period_year, report_year, array_to_string(list_transform(vs, lambda x: x.rule), ',') AS reasons FROM led")
def cl4(spark, sf):
    return fundamentals.validate_vintages(candidates(spark, sf)).select("company", "period_year", "report_year", F.concat_ws(",", "reject_reasons").alias("reasons"))


@R.query("cl4_violations", f"WITH {CANDIDATES}, u AS (SELECT company, period_year, report_year, unnest(vs) AS x FROM led) SELECT company, period_year, report_year, x.rule AS rule, x.value AS value, x.partner AS partner FROM u")
def cl4_violations(spark, sf):
    return constraints.ledger(fundamentals.validate_vintages(candidates(spark, sf)), ["company", "period_year", "report_year"])


EXCHANGE_NAME = "CASE exchange " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in fundamentals.EXCHANGE_NAMES.items()) + " END"
CATALOGUE = f"""cat0 AS (SELECT i.instrument_id AS company, code, CASE WHEN instrument_id % 15 = 7 THEN ' ' ELSE 'C' || instrument_id END AS company_name, CASE WHEN instrument_id % 7 IN (0, 3) THEN 'SH' WHEN instrument_id % 7 = 4 THEN 'BJ' ELSE 'SZ' END AS exchange, CASE WHEN instrument_id % 8 = 0 THEN 'bad name.csv' ELSE 'f' || instrument_id::VARCHAR || '.csv' END AS data_file,
  CASE WHEN instrument_id % 6 = 5 THEN 'draft' ELSE 'verified' END AS status, 1995 AS start_year, CASE WHEN instrument_id % 4 = 0 THEN 2001 WHEN instrument_id % 12 = 1 THEN 1994 ELSE 2000 END AS end_year, 7 AS verified_periods, CASE WHEN instrument_id % 9 = 0 THEN DATE '2030-01-01' ELSE DATE '2002-01-01' END AS reviewed_on FROM {{identity}} i),
cat AS (SELECT *, CASE WHEN company % 10 = 1 THEN '北交所' ELSE {EXCHANGE_NAME} END AS exchange_name, CASE WHEN company % 25 = 3 THEN 'X' ELSE code || '.' || exchange END AS canonical_code FROM cat0)"""


def catalogue(spark, sf):
    i = F.col("instrument_id")
    rows = view(spark, sf, "identity").select(
        i.alias("company"), "code", F.when(i % 15 == 7, " ").otherwise(F.concat(F.lit("C"), i.cast("string"))).alias("company_name"), F.when((i % 7).isin(0, 3), "SH").when(i % 7 == 4, "BJ").otherwise("SZ").alias("exchange"), F.when(i % 8 == 0, "bad name.csv").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(".csv"))).alias("data_file"),
        F.when(i % 6 == 5, "draft").otherwise("verified").alias("status"), F.lit(1995).alias("start_year"), F.when(i % 4 == 0, 2001).when(i % 12 == 1, 1994).otherwise(2000).alias("end_year"), F.lit(7).alias("verified_periods"), F.when(i % 9 == 0, day("2030-01-01")).otherwise(day("2002-01-01")).alias("reviewed_on"),
    )
    named = F.coalesce(*(F.when(F.col("exchange") == e, F.lit(n)) for e, n in fundamentals.EXCHANGE_NAMES.items()))
    return rows.withColumns({"exchange_name": F.when(F.col("company") % 10 == 1, "北交所").otherwise(named), "canonical_code": F.when(F.col("company") % 25 == 3, "X").otherwise(F.concat_ws(".", "code", "exchange"))})


@R.query(
    "cl5_validate_catalogue",
    f"""WITH {CATALOGUE} SELECT company, concat_ws(',', CASE WHEN company % 15 = 7 THEN 'name' END, CASE WHEN company % 7 = 6 THEN 'exchange' END, CASE WHEN company % 10 = 1 THEN 'exchange_name' END, CASE WHEN canonical_code = 'X' THEN 'canonical' END, CASE WHEN company % 8 = 0 THEN 'file' END, CASE WHEN status <> 'verified' THEN 'status' END,
    CASE WHEN start_year > end_year THEN 'range' END, CASE WHEN end_year <> 2001 THEN 'periods' END, CASE WHEN reviewed_on > DATE '2026-01-01' THEN 'reviewed' END,
    CASE WHEN count(*) OVER (PARTITION BY code) > 1 THEN 'unique_code' END, CASE WHEN count(*) OVER (PARTITION BY canonical_code) > 1 THEN 'unique_canonical' END, CASE WHEN count(*) OVER (PARTITION BY data_file) > 1 THEN 'unique_file' END) AS reasons FROM cat""",
)
def cl5(spark, sf):
    return fundamentals.validate_catalogue(catalogue(spark, sf), day("2026-01-01")).select("company", F.concat_ws(",", "reject_reasons").alias("reasons"))


@R.query(
    "cl5_industry_profiles",
    """WITH p AS (SELECT company, CASE WHEN company % 14 = 3 THEN '000001' ELSE lpad(company::VARCHAR, 6, '0') END AS code FROM {peers}) SELECT company, concat_ws(',', CASE WHEN company % 11 = 2 THEN 'disclosed_industry' END, CASE WHEN company % 13 = 5 THEN 'notes' END, CASE WHEN company % 6 = 1 THEN 'group' END, CASE WHEN company % 8 = 3 THEN 'exchange' END,
    CASE WHEN company % 7 IN (1, 2) THEN 'source' END, CASE WHEN company % 9 = 4 THEN 'page' END, CASE WHEN company % 10 = 6 THEN 'reviewed' END, CASE WHEN company % 12 = 8 THEN 'grade' END, CASE WHEN count(*) OVER (PARTITION BY code) > 1 THEN 'unique_code' END) AS reasons FROM p""",
)
def cl5_profiles(spark, sf):
    c = F.col("company")
    rows = view(spark, sf, "peers").select(
        "company", F.when(c % 14 == 3, "000001").otherwise(F.lpad(c.cast("string"), 6, "0")).alias("company_code"), "company_name", F.lit("annual report").alias("classification_basis"), F.when(c % 11 == 2, F.lit(None).cast("string")).otherwise("liquor").alias("disclosed_industry"), F.when(c % 6 == 1, "Bad Group").otherwise("group_1").alias("peer_group_code"),
        F.col("peer_group").alias("peer_group_name"), F.when(c % 8 == 3, "NY").otherwise("sh").alias("exchange"), F.when(c % 7 == 1, "https://static.cninfo.com.cn/a.html").when(c % 7 == 2, "https://example.org/a.pdf").otherwise("https://static.cninfo.com.cn/a.PDF").alias("source_url"), F.lit("report").alias("source_title"),
        F.when(c % 9 == 4, 0).otherwise(12).alias("source_page"), F.when(c % 10 != 6, day("2002-01-01")).alias("reviewed_on"), F.when(c % 12 == 8, "B").otherwise("A").alias("evidence_grade"), F.when(c % 13 == 5, "  ").otherwise("n").alias("notes"),
    )
    return fundamentals.validate_profiles(rows).select("company", F.concat_ws(",", "reject_reasons").alias("reasons"))


@R.query(
    "cl6_supplementary_facts",
    """WITH f0 AS (SELECT company, period_year, revenue FROM {vintages} WHERE accounting_basis = 'original'), f AS (FROM f0 UNION ALL FROM f0 WHERE company % 19 = 6) SELECT company, period_year, concat_ws(',', CASE WHEN company % 17 = 1 THEN 'texts' END, CASE WHEN company % 11 = 5 THEN 'published' END, CASE WHEN company % 7 = 4 THEN 'source' END, CASE WHEN company % 9 = 2 THEN 'grade' END, CASE WHEN company % 8 = 7 THEN 'status' END,
    CASE WHEN company % 10 = 3 THEN 'inventory' END, CASE WHEN company % 12 = 5 THEN 'contract_liabilities' END, CASE WHEN company % 13 = 6 THEN 'inventory_page' END, CASE WHEN count(*) OVER (PARTITION BY company, period_year) > 1 THEN 'unique' END) AS reasons FROM f""",
)
def cl6_facts(spark, sf):
    c, one = F.col("company"), F.col("revenue") / 8
    rows = view(spark, sf, "vintages").where("accounting_basis = 'original'").select(
        "company", "period_year", F.when(c % 17 == 1, "").otherwise("C").alias("company_name"), F.lit("report").alias("report_title"), F.lit("n").alias("notes"), F.when(c % 11 == 5, day("2030-01-01")).otherwise(F.col("published_date")).alias("published_date"), F.when(c % 7 == 4, "https://static.cninfo.com.cn/a").otherwise("https://static.cninfo.com.cn/a.pdf").alias("source_url"),
        F.when(c % 9 == 2, F.lit(None).cast("string")).otherwise("A").alias("evidence_grade"), F.when(c % 8 == 7, "candidate").otherwise("verified").alias("verification_status"), one.alias("cost_of_sales"), F.when(c % 10 == 3, F.lit(float("nan"))).otherwise(one).alias("inventory"), one.alias("prior_year_inventory"),
        F.when(c % 12 == 5, -one).otherwise(one).alias("contract_liabilities"), one.alias("prior_year_contract_liabilities"), F.lit(1).alias("income_statement_page"), F.when(c % 13 == 6, 0).otherwise(2).alias("inventory_page"), F.lit(3).alias("contract_liabilities_page"),
    )
    rows = rows.unionByName(rows.where("company % 19 = 6"))
    return fundamentals.validate_facts(rows, day("2026-01-01")).select("company", "period_year", F.concat_ws(",", "reject_reasons").alias("reasons"))


CASES = """cs0 AS (SELECT company, period_year, component, value, CASE WHEN company % 13 = 2 AND period_year = 1996 THEN company * 10000 + 1997 ELSE company * 10000 + period_year END AS case_id FROM {bridge}), cs AS (SELECT *, CASE WHEN company % 11 = 3 AND component LIKE 'R%' THEN 'other' ELSE 'C' || company END AS company_name FROM cs0)"""


@R.query(
    "cl6_bridge_components",
    f"""WITH {CASES}, m AS (SELECT *, min(company_name) OVER w <> max(company_name) OVER w AS names, min(period_year) OVER w <> max(period_year) OVER w AS years, count(*) OVER (PARTITION BY case_id, component) > 1 AS twice, min(case_id) OVER v <> max(case_id) OVER v AS cases FROM cs WINDOW w AS (PARTITION BY case_id), v AS (PARTITION BY company, period_year))
    SELECT case_id, component AS component_code, company, period_year, concat_ws(',', CASE WHEN company % 9 = 5 THEN 'canonical' END, CASE WHEN company % 6 = 2 THEN 'page' END, CASE WHEN names THEN 'one_company_name' END, CASE WHEN years THEN 'one_period_year' END, CASE WHEN years THEN 'one_comparison_year' END, CASE WHEN twice THEN 'unique_component' END, CASE WHEN cases THEN 'one_case' END) AS reasons FROM m""",
)
def cl6_components(spark, sf):
    c, year = F.col("company"), F.col("period_year")
    code = F.lpad(c.cast("string"), 6, "0")
    rows = view(spark, sf, "bridge").select(
        F.when((c % 13 == 2) & (year == 1996), c * 10000 + 1997).otherwise(c * 10000 + year).alias("case_id"), "company", code.alias("company_code"), F.when((c % 11 == 3) & F.col("component").startswith("R"), "other").otherwise(F.concat(F.lit("C"), c.cast("string"))).alias("company_name"),
        F.concat(code, F.when(c % 9 == 5, ".NY").otherwise(".sh")).alias("canonical_code"), "period_year", (year - 1).alias("comparison_year"), F.lit("report").alias("report_title"), F.lit("https://www.sse.com.cn/a.pdf").alias("source_url"), F.when(c % 6 == 2, 0).otherwise(7).alias("source_page"),
        F.col("component").alias("component_code"), F.col("component").alias("component_label"), F.col("value").alias("current_value"), F.lit(0.0).alias("comparison_value"), F.lit("A").alias("evidence_grade"), F.lit("verified").alias("verification_status"),
    )
    return fundamentals.validate_components(rows).select("case_id", "component_code", "company", "period_year", F.concat_ws(",", "reject_reasons").alias("reasons"))


@R.query("cl6_coverage", """WITH f AS (SELECT DISTINCT company, period_year FROM {vintages} WHERE accounting_basis = 'original'), g AS (SELECT s_suppkey AS company, y.y AS period_year FROM supplier, (VALUES (1996), (1997), (1998)) AS y(y) WHERE s_suppkey % 4 <> 3)
SELECT company, period_year, 'missing' AS status FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.company = g.company AND f.period_year = g.period_year) UNION ALL SELECT company, period_year, 'unexpected' FROM f WHERE NOT EXISTS (SELECT 1 FROM g WHERE f.company = g.company AND f.period_year = g.period_year)""")
def cl6_coverage(spark, sf):
    facts = view(spark, sf, "vintages").where("accounting_basis = 'original'")
    expected = view(spark, sf, "peers").where("company % 4 <> 3").select("company", F.explode(F.array(*map(F.lit, (1996, 1997, 1998)))).alias("period_year"))
    return constraints.coverage(facts, expected, ["company", "period_year"])


@R.query("cl6_expected_grid", """WITH f AS (SELECT company, period_year, count(*) AS n, count(*) FILTER (NOT net_profit > 0) AS bad FROM {vintages} WHERE accounting_basis = 'original' GROUP BY company, period_year), g AS (SELECT s_suppkey AS company, y.y AS period_year FROM supplier, (VALUES (1996), (1997), (1998)) AS y(y) WHERE s_suppkey % 4 <> 3)
SELECT coalesce(f.company, g.company) AS company, coalesce(f.period_year, g.period_year)::INTEGER AS period_year, CASE WHEN n IS NULL THEN 'missing' WHEN g.company IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN bad > 0 THEN 'bad_amount' ELSE 'ok' END AS status FROM f FULL JOIN g ON f.company = g.company AND f.period_year = g.period_year""")
def cl6(spark, sf):
    facts = view(spark, sf, "vintages").where("accounting_basis = 'original'").select("company", "period_year", F.col("net_profit").alias("value"))
    return fundamentals.validate_grid(facts, view(spark, sf, "peers").where("company % 4 <> 3"), [1996, 1997, 1998])


BRIDGE = """b AS (SELECT coalesce(n.company, p.company) AS company, coalesce(n.period_year, p.period_year + 1) AS period_year, coalesce(n.component, p.component) AS component, coalesce(n.value, 0) AS current, coalesce(p.value, 0) AS comparison FROM {bridge} n FULL JOIN {bridge} p ON n.company = p.company AND n.component = p.component AND n.period_year = p.period_year + 1),
bsum AS (SELECT company, period_year, sum(current) AS current, sum(comparison) AS comparison, count(*) AS components FROM b GROUP BY company, period_year), tot AS (SELECT company, period_year, CASE WHEN company % 6 = 1 THEN sum(value) + 5 ELSE sum(value) END AS total FROM {bridge} GROUP BY company, period_year)"""


def bridge(spark, sf):
    rows = view(spark, sf, "bridge")
    before = rows.select("company", (F.col("period_year") + 1).alias("period_year"), "component", F.col("value").alias("comparison"))
    return rows.withColumnRenamed("value", "current").join(before, ["company", "period_year", "component"], "full_outer").fillna(0.0, ["current", "comparison"])


@R.query(
    "ag12_bridge_review",
    f"""WITH {POINTS}, {BRIDGE}, h AS (SELECT t.*, revenue_growth, net_profit_growth, operating_cash_flow FROM tot t LEFT JOIN pts p ON t.company = p.company AND t.period_year = p.period_year AND p.as_of = DATE '2002-12-31')
    SELECT s.company, s.period_year::INTEGER AS period_year, components, abs(current - h.total) <= greatest(1, abs(h.total) * 1e-10) AS current_ok, abs(comparison - o.total) <= greatest(1, abs(o.total) * 1e-10) AS comparison_ok, abs((current - comparison) - (h.total - o.total)) <= greatest(1, abs(h.total - o.total) * 1e-10) AS change_ok,
    coalesce(h.revenue_growth > 0 AND h.net_profit_growth > 0 AND h.operating_cash_flow < 0, false) AS divergence FROM bsum s JOIN h ON s.company = h.company AND s.period_year = h.period_year JOIN tot o ON s.company = o.company AND s.period_year = o.period_year + 1""",
)
def ag12(spark, sf):
    total = view(spark, sf, "bridge").groupBy("company", "period_year").agg(F.sum("value").alias("total")).withColumn("total", F.when(F.col("company") % 6 == 1, F.col("total") + 5).otherwise(F.col("total")))
    last = points(spark, sf).where(F.col("as_of") == day("2002-12-31")).select("company", "period_year", "revenue_growth", "net_profit_growth", "operating_cash_flow")
    return fundamentals.bridge_review(bridge(spark, sf), total.join(last, ["company", "period_year"], "left")).select("company", "period_year", "components", "current_ok", "comparison_ok", "change_ok", "divergence")


@R.query(
    "wn13_bridge_drivers",
    f"""WITH {BRIDGE}, c AS (SELECT *, current - comparison AS contribution, row_number() OVER (PARTITION BY company, period_year ORDER BY abs(current - comparison) DESC, component)::INTEGER AS place, CASE WHEN current > comparison THEN 'up' WHEN current < comparison THEN 'down' ELSE 'flat' END AS direction FROM b),
    d AS (SELECT *, row_number() OVER (PARTITION BY company, period_year, direction ORDER BY place) AS n FROM c) SELECT company, period_year::INTEGER AS period_year, component, round(contribution, 2) AS contribution, place, direction, CASE WHEN direction = 'down' AND n = 1 THEN 'largest_fall' WHEN direction = 'up' AND n <= 3 THEN 'offset' END AS role FROM d""",
)
def wn13(spark, sf):
    return fundamentals.drivers(bridge(spark, sf)).select("company", "period_year", "component", F.round("contribution", 2).alias("contribution"), "place", "direction", "role")


REPORTS = """rep0 AS (SELECT * FROM {vintages} WHERE accounting_basis = 'original'), rep AS (SELECT a.company, a.report_year, CASE WHEN a.company % 10 = 2 AND a.report_year = 1997 THEN '千元' ELSE '元' END AS unit, a.revenue, a.net_profit, CASE WHEN a.company % 3 = 0 THEN r.revenue ELSE p.revenue END AS revenue_previous, p.net_profit AS net_profit_previous
  FROM rep0 a LEFT JOIN rep0 p ON a.company = p.company AND a.report_year = p.report_year + 1 LEFT JOIN {vintages} r ON r.company = a.company AND r.period_year = a.report_year - 1 AND r.accounting_basis = 'restated')"""


def reports(spark, sf):
    rows = view(spark, sf, "vintages")
    own = rows.where("accounting_basis = 'original'").select("company", "report_year", "revenue", "net_profit")
    before = own.select("company", (F.col("report_year") + 1).alias("report_year"), F.col("revenue").alias("_r0"), F.col("net_profit").alias("net_profit_previous"))
    restated = rows.where("accounting_basis = 'restated'").select("company", (F.col("period_year") + 1).alias("report_year"), F.col("revenue").alias("_r1"))
    joined = own.join(before, ["company", "report_year"], "left").join(restated, ["company", "report_year"], "left")
    unit = F.when((F.col("company") % 10 == 2) & (F.col("report_year") == 1997), "千元").otherwise("元")
    return joined.withColumns({"unit": unit, "revenue_previous": F.when(F.col("company") % 3 == 0, F.col("_r1")).otherwise(F.col("_r0"))}).drop("_r0", "_r1")


@R.query(
    "j8_restatement_clues",
    f"""WITH {REPORTS}, tall AS (SELECT company, report_year, unit, 'revenue' AS metric, revenue AS value, revenue_previous AS previous FROM rep UNION ALL SELECT company, report_year, unit, 'net_profit', net_profit, net_profit_previous FROM rep)
    SELECT a.company, a.report_year, a.metric, CASE WHEN a.previous IS NULL OR o.value IS NULL OR a.unit <> o.unit THEN 'not_comparable' WHEN abs(a.previous - o.value) <= greatest(0.5e0, 1e-9 * greatest(abs(a.previous), abs(o.value))) THEN 'unchanged' ELSE 'changed_or_restated' END AS status
    FROM tall a JOIN tall o ON a.company = o.company AND a.metric = o.metric AND a.report_year = o.report_year + 1""",
)
def j8(spark, sf):
    return fundamentals.restatement_clues(reports(spark, sf), ["revenue", "net_profit"]).select("company", "report_year", "metric", "status")


@R.query("j9_pending_reports", "SELECT company, report_year FROM {vintages} v WHERE accounting_basis = 'original' AND NOT (company % 2 = 0 AND report_year < 1998)")
def j9(spark, sf):
    rows = view(spark, sf, "vintages").where("accounting_basis = 'original'").select("company", "report_year")
    return fundamentals.pending_reports(rows, rows.where("company % 2 = 0 and report_year < 1998"), ["company", "report_year"])


AUDITED = f"""{CATALOGUE}, f AS (SELECT company, list_sort(list(DISTINCT period_year)) AS years, count(*) AS vintages, list_sort(list(DISTINCT CASE WHEN company % 18 = 4 AND accounting_basis = 'restated' THEN 'new' WHEN company % 14 = 9 THEN 'other' ELSE 'C' || company END)) AS names FROM {{vintages}} GROUP BY company),
aud AS (SELECT c.company, start_year, end_year, verified_periods, coalesce(vintages, 0) AS vintages, coalesce(len(years), 0)::INTEGER AS periods, coalesce(years = range(start_year, end_year + 1), false) AS complete, coalesce(names = [company_name], false) AS names_ok FROM cat c LEFT JOIN f ON c.company = f.company)"""


def audited(spark, sf):
    c = F.col("company")
    name = F.when((c % 18 == 4) & (F.col("accounting_basis") == "restated"), "new").when(c % 14 == 9, "other").otherwise(F.concat(F.lit("C"), c.cast("string")))
    return fundamentals.audit_catalogue(catalogue(spark, sf), view(spark, sf, "vintages").withColumn("company_name", name))


@R.query("ag9_audit_catalogue", f"WITH {AUDITED} SELECT *, complete AND names_ok AS passed FROM aud")
def ag9(spark, sf):
    return audited(spark, sf)


@R.query("ag9_totals", f"WITH {AUDITED} SELECT count(*) AS companies, sum(verified_periods)::BIGINT AS declared_periods, sum(vintages)::BIGINT AS vintages, count(*) FILTER (NOT (complete AND names_ok)) AS failed, bool_and(complete AND names_ok) AS all_passed FROM aud")
def ag9_totals(spark, sf):
    return fundamentals.catalogue_totals(audited(spark, sf))


@R.query("cl12_currency_units", "SELECT company, report_year, revenue * CASE WHEN company % 10 = 2 AND report_year = 1997 THEN 1000 ELSE 1 END AS revenue_yuan, company % 10 = 9 AS unknown_unit FROM {vintages} WHERE accounting_basis = 'original' AND company % 10 <> 9 UNION ALL SELECT company, report_year, NULL, true FROM {vintages} WHERE accounting_basis = 'original' AND company % 10 = 9")
def cl12(spark, sf):
    rows = reports(spark, sf).withColumn("unit", F.when(F.col("company") % 10 == 9, "箱").when(F.col("company") % 2 == 0, F.concat(F.lit("人民币 "), F.col("unit"))).otherwise(F.col("unit")))
    factor = rules.unit_multiplier(F.col("unit"))
    return rows.select("company", "report_year", (F.col("revenue") * factor).alias("revenue_yuan"), factor.isNull().alias("unknown_unit"))


# ---- peers


def latest_points(spark, sf):
    return points(spark, sf).where(F.col("as_of") == day("2002-12-31"))


@R.query("j6_common_periods", f"""WITH {POINTS}, m AS (SELECT peer_group, count(DISTINCT company) AS members FROM {{peers}} GROUP BY peer_group), c AS (SELECT p.peer_group, t.period_year, count(DISTINCT t.company) AS n FROM pts t JOIN {{peers}} p ON t.company = p.company WHERE as_of = DATE '2002-12-31' GROUP BY p.peer_group, t.period_year)
SELECT c.peer_group, period_year::INTEGER AS period_year, members, period_year = max(period_year) OVER (PARTITION BY c.peer_group) AS is_latest FROM c JOIN m ON c.peer_group = m.peer_group WHERE n = members AND members >= 2""")
def j6(spark, sf):
    return peers.common_periods(view(spark, sf, "peers").select("company", "peer_group"), latest_points(spark, sf)).select("peer_group", F.col("period_year").cast("int").alias("period_year"), "members", "is_latest")


@R.query("ag10_sample_positions", f"""WITH {POINTS}, g AS (SELECT p.peer_group, t.company, t.period_year, net_margin, median(net_margin) OVER w AS med, min(net_margin) OVER w AS lo, max(net_margin) OVER w AS hi, count(net_margin) OVER w AS sample FROM pts t JOIN {{peers}} p ON t.company = p.company WHERE as_of = DATE '2002-12-31' WINDOW w AS (PARTITION BY p.peer_group, t.period_year))
SELECT peer_group, company, period_year::INTEGER AS period_year, round(med, 6) AS median, sample, CASE WHEN abs(net_margin - med) <= greatest(1e-12, 1e-9 * greatest(abs(net_margin), abs(med))) THEN 'near' WHEN net_margin > med THEN 'above' ELSE 'below' END AS position, net_margin = lo AS at_min, net_margin = hi AS at_max FROM g""")
def ag10(spark, sf):
    rows = latest_points(spark, sf).join(view(spark, sf, "peers").select("company", "peer_group"), "company")
    return peers.sample_positions(rows, ["peer_group", "period_year"], "net_margin").select("peer_group", "company", "period_year", *six("median"), "sample", "position", "at_min", "at_max")


@R.query("ag8_peer_coverage", "SELECT peer_group, count(*) AS companies, string_agg(company_name, ',' ORDER BY company_name) AS names, greatest(0, 2 - count(*)) AS needed, count(*) >= 2 AS ready FROM {peers} GROUP BY peer_group")
def ag8(spark, sf):
    return peers.peer_coverage(view(spark, sf, "peers")).withColumn("names", F.concat_ws(",", "names"))


@R.query("ag8_peer_scope", "SELECT scope AS selection, count(DISTINCT peer_group) AS groups, string_agg(DISTINCT peer_group, ',' ORDER BY peer_group) AS group_names, count(DISTINCT peer_group) = 1 AS same_group FROM {peers} GROUP BY scope")
def ag8_scope(spark, sf):
    rows = view(spark, sf, "peers")
    return peers.peer_scope(rows.select(F.col("scope").alias("selection"), "company"), rows).withColumn("group_names", F.concat_ws(",", "group_names"))


FACTS = """fct AS (SELECT v.company, v.period_year, CASE WHEN v.company % 9 = 4 THEN 'other' ELSE s_name END AS company_name, CASE WHEN v.company % 8 = 1 THEN published_date + 1 ELSE published_date END AS published_date, CASE WHEN v.company % 12 = 5 THEN NULL ELSE v.report_year || '年年度报告' END AS report_title,
  CASE WHEN v.company % 11 = 6 THEN 'https://www.sse.com.cn/b' ELSE 'https://www.sse.com.cn/a' END AS source_url, revenue * CASE WHEN v.company % 7 = 3 THEN 1.5e0 ELSE 0.5e0 END AS cost, revenue / 8 AS inventory, revenue / 10 AS prior_inventory, revenue / 4 AS contract_liabilities, revenue / CASE WHEN v.company % 13 = 7 THEN -5 ELSE 5 END AS prior_contract_liabilities FROM {vintages} v JOIN supplier ON v.company = s_suppkey WHERE accounting_basis = 'original' AND v.company % 5 <> 2)"""


def enriched(spark, sf):
    names = view(spark, sf, "peers").select("company", "company_name")
    c, r, title = F.col("company"), F.col("revenue"), F.concat(F.col("report_year").cast("string"), F.lit("年年度报告"))
    facts = view(spark, sf, "vintages").where("accounting_basis = 'original' and company % 5 <> 2").join(names, "company").select(
        "company", "period_year", F.when(c % 9 == 4, "other").otherwise(F.col("company_name")).alias("company_name"), F.when(c % 8 == 1, F.date_add("published_date", 1)).otherwise(F.col("published_date")).alias("published_date"), F.when(c % 12 != 5, title).alias("report_title"),
        F.when(c % 11 == 6, "https://www.sse.com.cn/b").otherwise("https://www.sse.com.cn/a").alias("source_url"), (r * F.when(c % 7 == 3, 1.5).otherwise(0.5)).alias("cost"), (r / 8).alias("inventory"), (r / 10).alias("prior_inventory"), (r / 4).alias("contract_liabilities"), (r / F.when(c % 13 == 7, -5).otherwise(5)).alias("prior_contract_liabilities"),
    )
    points_ = latest_points(spark, sf).join(names, "company").withColumns({"report_title": title, "source_url": F.lit("https://www.sse.com.cn/a")})
    return peers.enrich(points_, facts)


JOINED = f"""{POINTS}, {FACTS}, pn AS (SELECT p.*, s_name AS company_name, p.report_year || '年年度报告' AS report_title, 'https://www.sse.com.cn/a' AS source_url FROM pts p JOIN supplier ON p.company = s_suppkey WHERE as_of = DATE '2002-12-31'),
jn AS (SELECT coalesce(p.company, f.company) AS company, coalesce(p.period_year, f.period_year)::INTEGER AS period_year, p.company IS NOT NULL AS here, f.company IS NOT NULL AS there, p.* EXCLUDE (company, period_year), f.company_name AS f_name, f.published_date AS f_date, f.report_title AS f_title, f.source_url AS f_url, cost, inventory, prior_inventory, contract_liabilities, prior_contract_liabilities FROM pn p FULL JOIN fct f ON p.company = f.company AND p.period_year = f.period_year),
df AS (SELECT *, here AND there AS paired, list_filter([CASE WHEN company_name IS DISTINCT FROM f_name THEN {{'f': 'company_name', 'a': company_name, 'b': f_name}} END, CASE WHEN published_date IS DISTINCT FROM f_date THEN {{'f': 'published_date', 'a': published_date::VARCHAR, 'b': f_date::DATE::VARCHAR}} END, CASE WHEN report_title IS DISTINCT FROM f_title THEN {{'f': 'report_title', 'a': report_title, 'b': f_title}} END,
  CASE WHEN source_url IS DISTINCT FROM f_url THEN {{'f': 'source_url', 'a': source_url, 'b': f_url}} END], lambda x: x IS NOT NULL) AS diffs FROM jn),
rs AS (SELECT *, CASE WHEN NOT there THEN 'no_facts' WHEN NOT here THEN 'no_point' WHEN len(diffs) > 0 THEN 'identity' WHEN NOT coalesce(revenue > 0 AND net_profit > 0 AND operating_cash_flow > 0 AND total_assets > 0 AND cost > 0 AND inventory > 0 AND prior_inventory > 0 AND contract_liabilities > 0 AND prior_contract_liabilities > 0, false) THEN 'amounts' WHEN NOT cost < revenue THEN 'cost' END AS reason FROM df)""".replace("{{", "{").replace("}}", "}")
RATIOS = ["gross_margin", "inventory_to_assets", "inventory_growth", "contract_liabilities_to_revenue", "contract_liabilities_growth", "cash_conversion"]


@R.query("j7_peer_enrichment", f"WITH {JOINED} SELECT company, period_year, round((revenue - cost) / revenue, 6) AS gross_margin, round(inventory / total_assets, 6) AS inventory_to_assets, round(inventory / prior_inventory - 1, 6) AS inventory_growth, round(contract_liabilities / revenue, 6) AS contract_liabilities_to_revenue, round(contract_liabilities / prior_contract_liabilities - 1, 6) AS contract_liabilities_growth, round(operating_cash_flow / net_profit, 6) AS cash_conversion FROM rs WHERE reason IS NULL")
def j7(spark, sf):
    return enriched(spark, sf)[0].select("company", "period_year", *six(*RATIOS))


@R.query("j7_peer_mismatches", f"WITH {JOINED} SELECT company, period_year, reason FROM rs WHERE reason IS NOT NULL")
def j7_mismatch(spark, sf):
    return enriched(spark, sf)[1]


@R.query("j7_field_ledger", f"WITH {JOINED}, u AS (SELECT company, period_year, unnest(diffs) AS x FROM df WHERE paired) SELECT company, period_year, x.f AS field, x.a AS point_value, x.b AS fact_value FROM u")
def j7_ledger(spark, sf):
    return enriched(spark, sf)[2]


@R.query("j10_identity_audit", f"""WITH {CATALOGUE}, i AS (SELECT instrument_id AS company, code AS code2, CASE WHEN instrument_id % 3 = 0 THEN 'SH' WHEN instrument_id % 7 IN (0, 3) THEN 'SH' WHEN instrument_id % 7 = 4 THEN 'BJ' ELSE 'SZ' END AS exchange2 FROM {{identity}} WHERE instrument_id % 10 <> 5 UNION ALL SELECT 1000000, '600001', 'SH')
SELECT coalesce(c.company, i.company) AS company, CASE WHEN i.company IS NULL THEN 'missing' WHEN c.company IS NULL THEN 'extra' WHEN code <> code2 AND exchange <> exchange2 THEN 'mismatch:code+exchange' WHEN code <> code2 THEN 'mismatch:code' WHEN exchange <> exchange2 THEN 'mismatch:exchange' ELSE 'ok' END AS status FROM cat c FULL JOIN i ON c.company = i.company""")
def j10(spark, sf):
    rows = catalogue(spark, sf).select("company", "code", "exchange")
    other = rows.where("company % 10 <> 5").withColumn("exchange", F.when(F.col("company") % 3 == 0, "SH").otherwise(F.col("exchange")))
    extra = rows.agg(F.lit(1_000_000).cast("bigint").alias("company"), F.lit("600001").alias("code"), F.lit("SH").alias("exchange"))
    return peers.audit_identities(rows, other.unionByName(extra), ["company"], ["code", "exchange"])


@R.query("so1_keep_one", "SELECT trade_date, code, name, streak_raw FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, code ORDER BY ingest_seq) AS n FROM {board_raw}) WHERE n = 1")
def so1(spark, sf):
    return rules.keep_one(view(spark, sf, "board_raw"), ["trade_date", "code"], [F.asc("ingest_seq")]).select("trade_date", "code", "name", "streak_raw")


@R.query(
    "cl10_watchlists",
    f"""WITH t AS (SELECT o_custkey AS owner, o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'x' || o_orderkey ELSE lpad((o_orderkey % 9)::VARCHAR, 6, '6') END AS token FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY owner, token ORDER BY o_orderkey) AS n, o_orderkey % 6 <> 0 AS sound FROM t),
    k AS (SELECT *, sum((sound AND n = 1)::INTEGER) OVER (PARTITION BY owner ORDER BY o_orderkey) AS pos FROM f)
    SELECT owner, coalesce(string_agg(CASE WHEN sound AND n = 1 AND pos <= 5 THEN token END, ',' ORDER BY o_orderkey), '') AS codes, count(*) FILTER (sound AND n > 1) AS duplicates, count(*) FILTER (NOT sound) AS invalid, coalesce(string_agg(CASE WHEN NOT sound THEN token END, ',' ORDER BY o_orderkey), '') AS invalid_tokens, count(*) FILTER (sound AND n = 1 AND pos > 5) AS over_cap FROM k GROUP BY owner""",
)
def cl10(spark, sf):
    token = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise(F.lpad((F.col("o_orderkey") % 9).cast("string"), 6, "6"))
    texts = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").alias("owner")).agg(F.concat_ws("，; ", F.sort_array(F.collect_list(F.struct("o_orderkey", token.alias("t"))))["t"]).alias("text"))
    return identity.watchlist_codes(texts, "owner", "text", rules.watchlist(F.col("text"))).withColumns({c: F.concat_ws(",", c) for c in ("codes", "invalid_tokens")})


@R.query(
    "j14_company_lookup",
    """WITH d AS (SELECT code, name, regexp_replace(upper(name), '\\s+', '', 'g') AS plain FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY instrument_id) AS n FROM {identity}) WHERE n = 1 AND NOT code LIKE '777%'),
    q AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'about SH' || code || '.SH ?' WHEN 1 THEN lower(i.name) ELSE right(i.name, 4) END AS text FROM orders JOIN {identity} i ON o_custkey % (SELECT count(*) FROM supplier) = instrument_id),
    p AS (SELECT *, regexp_replace(upper(text), '\\s+', '', 'g') AS plain, CASE WHEN text LIKE 'about%' THEN substr(text, 9, 6) ELSE '' END AS qcode FROM q),
    h AS (SELECT query_id, d.code, d.name, 1 AS tier FROM p JOIN d ON p.qcode = d.code UNION ALL SELECT query_id, d.code, d.name, 2 FROM p JOIN d ON qcode = '' AND p.plain = d.plain UNION ALL SELECT query_id, d.code, d.name, 3 FROM p JOIN d ON qcode = '' AND contains(d.plain, p.plain)),
    b AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY tier) AS best FROM h), k AS (SELECT DISTINCT query_id, code, tier FROM b WHERE best = 1), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY code)::INTEGER AS place FROM k) SELECT query_id, code, tier, place FROM r WHERE place <= 8""",
)
def j14(spark, sf):
    names = view(spark, sf, "identity")
    count = spark.read.parquet(f"{sf}/supplier.parquet").count()
    asked = spark.read.parquet(f"{sf}/orders.parquet").withColumn("instrument_id", F.col("o_custkey") % count).join(names, "instrument_id")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("about SH"), F.col("code"), F.lit(".SH ?"))).when(F.col("o_orderkey") % 3 == 1, F.lower("name")).otherwise(F.substring("name", -4, 4))
    return identity.resolve(asked.select(F.col("o_orderkey").alias("query_id"), text.alias("text")), identity.company_identity(names, [F.asc("instrument_id")])).select("query_id", "code", "tier", "place")


QUERIES, ORACLE_SQL = R.queries, {name: duck(text) for name, text in R.sql.items()}
