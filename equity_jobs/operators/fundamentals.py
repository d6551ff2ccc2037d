"""Point-in-time fundamentals: validation, vintages, changes, trends, bridges and restatements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.functions.rules import allowed_url, exchange, finite
from equity_jobs.operators.asof import Cutoffs, counts_as_of
from equity_jobs.operators.constraints import Depends, Holds, Unique, broken, checked

NATURAL_KEY = ["company", "period_year", "report_year", "published_date"]
METRICS = ["revenue", "net_profit", "operating_cash_flow", "total_assets", "total_liabilities"]


def _text(*columns: str) -> Column:
    """Whether all of them say something."""
    test = F.lit(True)
    for c in columns:
        test &= F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return test


def _positive(*columns: str) -> Column:
    """Whether all of them are finite and above 0."""
    test = F.lit(True)
    for c in columns:
        test &= F.coalesce(finite(F.col(c)) > 0, F.lit(False))
    return test


def _source(pdf: bool = False) -> Column:
    url = F.trim("source_url")
    secure = allowed_url(url) & F.lower(url).startswith("https://")
    return secure & F.lower(F.try_parse_url(url, F.lit("PATH"))).endswith(".pdf") if pdf else secure


def vintage_rules() -> list[Holds | Unique | Depends]:
    """CL4: what a publication vintage must fulfil."""
    return [
        Holds("identity", _text("company_name"), F.col("company_name")), Holds("report_title", _text("report_title"), F.col("report_title")), Holds("source", _source(), F.col("source_url")), Holds("grade", F.col("evidence_grade") == "A", F.col("evidence_grade")),
        Holds("status", F.col("verification_status") == "verified", F.col("verification_status")), Holds("basis", F.col("accounting_basis").isin("original", "restated", "reported"), F.col("accounting_basis")), Holds("period", F.col("period_year") <= F.col("report_year")),
        Holds("amounts", _positive(*METRICS)), Holds("pages", _positive("summary_page", "balance_sheet_page")), Holds("balance", F.col("total_liabilities") <= F.col("total_assets")), Holds("published", F.year("published_date") > F.col("report_year"), F.col("published_date")),
        Unique("unique", tuple(NATURAL_KEY)), Depends("one_name", ("company",), "company_name"),
    ]


def validate_vintages(rows: DataFrame) -> DataFrame:
    """CL4: violations of every vintage, and their rules as reject_reasons; none: accepted."""
    return checked(rows, NATURAL_KEY, vintage_rules()).withColumn("reject_reasons", broken())


EXCHANGE_NAMES = {"SH": "上海证券交易所", "SZ": "深圳证券交易所", "BJ": "北京证券交易所"}


def validate_catalogue(rows: DataFrame, today: Column) -> DataFrame:
    """CL5: violations and reject_reasons of catalogue rows: code, exchange, its name and the canonical code agree, a safe file name, verified, a full range, reviewed by today, nothing twice."""
    named = F.coalesce(*(F.when(F.col("exchange") == code, F.lit(name)) for code, name in EXCHANGE_NAMES.items()))
    rules = [
        Holds("name", _text("company_name")), Holds("exchange", exchange(F.col("code")) == F.col("exchange"), F.col("exchange")), Holds("exchange_name", F.col("exchange_name") == named, F.col("exchange_name")), Holds("canonical", F.col("canonical_code") == F.concat_ws(".", "code", "exchange"), F.col("canonical_code")),
        Holds("file", F.col("data_file").rlike(r"^[A-Za-z0-9_\-]+\.csv$"), F.col("data_file")), Holds("status", F.col("status") == "verified", F.col("status")), Holds("range", (F.col("start_year") > 0) & (F.col("start_year") <= F.col("end_year"))),
        Holds("periods", F.col("verified_periods") == F.col("end_year") - F.col("start_year") + 1, F.col("verified_periods")), Holds("reviewed", F.col("reviewed_on") <= today, F.col("reviewed_on")),
        Unique("unique_code", ("code",)), Unique("unique_canonical", ("canonical_code",)), Unique("unique_file", ("data_file",)),
    ]
    return checked(rows, ["company"], rules).withColumn("reject_reasons", broken())


def validate_profiles(rows: DataFrame) -> DataFrame:
    """CL5: violations and reject_reasons of industry profiles: all texts there, a six-digit code used once, a slug as group, an allowed https PDF with its page, grade A."""
    texts = ["company_name", "classification_basis", "disclosed_industry", "peer_group_name", "source_title", "notes"]
    rules = [
        *(Holds(c, _text(c)) for c in texts), Holds("code", F.col("company_code").rlike("^[0-9]{6}$"), F.col("company_code")), Holds("group", F.col("peer_group_code").rlike("^[a-z][a-z0-9_]{2,63}$"), F.col("peer_group_code")), Holds("exchange", F.upper("exchange").isin("SH", "SZ", "BJ"), F.col("exchange")),
        Holds("source", _source(pdf=True), F.col("source_url")), Holds("page", F.col("source_page") > 0, F.col("source_page")), Holds("reviewed", F.col("reviewed_on").isNotNull()), Holds("grade", F.col("evidence_grade") == "A", F.col("evidence_grade")), Unique("unique_code", ("company_code",)),
    ]
    return checked(rows, ["company_code"], rules).withColumn("reject_reasons", broken())


FACT_AMOUNTS = ["cost_of_sales", "inventory", "prior_year_inventory", "contract_liabilities", "prior_year_contract_liabilities"]
FACT_PAGES = ["income_statement_page", "inventory_page", "contract_liabilities_page"]


def validate_facts(rows: DataFrame, today: Column) -> DataFrame:
    """CL6: violations and reject_reasons of supplementary facts (company, period_year); the grid they must cover is constraints.coverage()'s."""
    rules = [
        Holds("texts", _text("company_name", "report_title", "notes")), Holds("period", F.col("period_year") > 0), Holds("published", F.col("published_date") <= today, F.col("published_date")), Holds("source", _source(pdf=True), F.col("source_url")), Holds("grade", F.col("evidence_grade") == "A", F.col("evidence_grade")),
        Holds("status", F.col("verification_status") == "verified", F.col("verification_status")), *(Holds(c, _positive(c), F.col(c)) for c in FACT_AMOUNTS), *(Holds(c, _positive(c), F.col(c)) for c in FACT_PAGES), Unique("unique", ("company", "period_year")),
    ]
    return checked(rows, ["company", "period_year"], rules).withColumn("reject_reasons", broken())


CASE_IDENTITY = ["company_code", "company_name", "canonical_code", "period_year", "comparison_year", "report_title", "source_url", "source_page"]


def validate_components(rows: DataFrame) -> DataFrame:
    """CL6: violations and reject_reasons of bridge components: sound rows, one identity a case, no component twice in it, no other case of its company and years."""
    rules = [
        Holds("code", F.col("company_code").rlike("^[0-9]{6}$"), F.col("company_code")), Holds("texts", _text("company_name", "report_title", "component_code", "component_label")), Holds("canonical", F.upper("canonical_code").isin(F.concat_ws(".", "company_code", F.lit("SZ")), F.concat_ws(".", "company_code", F.lit("SH"))), F.col("canonical_code")),
        Holds("source", _source(), F.col("source_url")), Holds("grade", F.col("evidence_grade") == "A", F.col("evidence_grade")), Holds("status", F.col("verification_status") == "verified", F.col("verification_status")), Holds("years", (F.col("comparison_year") > 0) & (F.col("comparison_year") < F.col("period_year"))),
        Holds("page", F.col("source_page") > 0, F.col("source_page")), Holds("values", finite(F.col("current_value")).isNotNull() & finite(F.col("comparison_value")).isNotNull()), *(Depends(f"one_{c}", ("case_id",), c) for c in CASE_IDENTITY), Unique("unique_component", ("case_id", "component_code")),
        Depends("one_case", ("company_code", "period_year", "comparison_year"), "case_id"),
    ]
    return checked(rows, ["case_id", "component_code"], rules).withColumn("reject_reasons", broken())


def validate_grid(facts: DataFrame, companies: DataFrame, years: list[int]) -> DataFrame:
    """CL6: facts against the expected company and year grid: missing and unexpected cells, repeats, and bad amounts."""
    grid = companies.select("company").distinct().withColumn("period_year", F.explode(F.array(*(F.lit(y) for y in years))))
    found = facts.groupBy("company", "period_year").agg(F.count("*").alias("n"), F.count_if(~(F.col("value") > 0)).alias("bad"))
    joined = grid.withColumn("_expected", F.lit(True)).join(found, ["company", "period_year"], "full_outer")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("_expected").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("bad") > 0, "bad_amount").otherwise("ok")
    return joined.select("company", "period_year", status.alias("status"))


def select_as_of(vintages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """WN9: of each cut-off, company and period the latest version published by then.

    A version is valid from its publication until the next one's of the period, and meets
    the cut-offs in that interval alone. Undated versions are visible nowhere.
    """
    versions = Window.partitionBy("company", "period_year").orderBy("published_date", "report_year")
    valid = vintages.drop("as_of").where("published_date is not null").withColumn("_until", F.lead("published_date").over(versions))
    return valid.withColumn("as_of", F.explode(Cutoffs(cutoffs).within(F.col("published_date"), F.col("_until")))).drop("_until")


def vintage_counts(vintages: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """WN9's audit: visible, future and restated versions at each cut-off and company."""
    counts = counts_as_of(vintages, cutoffs, ["company"], {"restated": F.col("accounting_basis") == "restated"})
    return counts.select("as_of", "company", F.col("accepted").alias("available"), "future", "restated")


def trend_points(selected: DataFrame) -> DataFrame:
    """WN10: ratios, and changes against the previous available period; null on the first and on a zero base."""
    order = Window.partitionBy("as_of", "company").orderBy("period_year")
    rows = selected.withColumns({"net_margin": F.try_divide("net_profit", "revenue"), "cash_conversion": F.try_divide("operating_cash_flow", "net_profit"), "liabilities_to_assets": F.try_divide("total_liabilities", "total_assets")})
    before = lambda c: F.lag(c).over(order)
    growth = {f"{c}_growth": F.when(before(c) != 0, (F.col(c) - before(c)) / F.abs(before(c))) for c in ("revenue", "net_profit", "operating_cash_flow")}
    change = {f"{c}_change": F.col(c) - before(c) for c in ("net_margin", "cash_conversion", "liabilities_to_assets")}
    return rows.withColumns(growth | change)


def alignment(a: Column, b: Column, same: str, other: str) -> Column:
    return F.when(a.isNull() | b.isNull(), "比较期不足").when(F.signum(a) == F.signum(b), same).otherwise(other)


def trend_review(points: DataFrame) -> DataFrame:
    """AG11: first and last year, compound growth, the latest changes, and whether they point the same way."""
    first, last = lambda c: F.min_by(c, "period_year"), lambda c: F.max_by(c, "period_year")
    span = F.max("period_year") - F.min("period_year")
    cagr = [F.when((span > 0) & (first(c) > 0) & (last(c) > 0), F.pow(last(c) / first(c), F.lit(1.0) / span) - 1).alias(f"{c}_cagr") for c in ("revenue", "net_profit", "operating_cash_flow")]
    latest = [last(c).alias(f"latest_{c}") for c in ("revenue_growth", "net_profit_growth", "operating_cash_flow_growth", "net_margin_change", "liabilities_to_assets_change")]
    rows = points.groupBy("as_of", "company").agg(F.min("period_year").alias("start_year"), F.max("period_year").alias("end_year"), F.count("*").alias("periods"), *cagr, *latest, F.count_if(F.col("accounting_basis") == "restated").alias("restatements"))
    return rows.withColumns(
        {"growth_alignment": alignment(F.col("latest_revenue_growth"), F.col("latest_net_profit_growth"), "收入与利润同向", "收入与利润方向不一致"), "cash_alignment": alignment(F.col("latest_net_profit_growth"), F.col("latest_operating_cash_flow_growth"), "利润与经营现金同向", "利润与经营现金方向不一致")}
    )


def near(a: Column, b: Column) -> Column:
    """Equal within max(1, |b| * 1e-10)."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(b) * 1e-10)


def bridge_review(components: DataFrame, history: DataFrame) -> DataFrame:
    """AG12: whether the components of a case add up to the reported totals of both years, and the divergence signal.

    components: company, period_year, component, current, comparison. history: company, period_year, total, revenue_growth, net_profit_growth, operating_cash_flow.
    """
    sums = components.groupBy("company", "period_year").agg(F.sum("current").alias("current"), F.sum("comparison").alias("comparison"), F.count("*").alias("components"))
    now = history.select("company", "period_year", F.col("total").alias("reported"), "revenue_growth", "net_profit_growth", "operating_cash_flow")
    before = history.select("company", (F.col("period_year") + 1).alias("period_year"), F.col("total").alias("reported_before"))
    rows = sums.join(now, ["company", "period_year"]).join(before, ["company", "period_year"])
    signal = (F.col("revenue_growth") > 0) & (F.col("net_profit_growth") > 0) & (F.col("operating_cash_flow") < 0)
    return rows.withColumns(
        {"current_ok": near(F.col("current"), F.col("reported")), "comparison_ok": near(F.col("comparison"), F.col("reported_before")), "change_ok": near(F.col("current") - F.col("comparison"), F.col("reported") - F.col("reported_before")), "divergence": F.coalesce(signal, F.lit(False))}
    )


def drivers(components: DataFrame, top: int = 3) -> DataFrame:
    """WN13: contributions by size; which is the largest fall, and the first rises that offset it."""
    case = Window.partitionBy("company", "period_year")
    rows = components.withColumn("contribution", F.col("current") - F.col("comparison"))
    rows = rows.withColumn("place", F.row_number().over(case.orderBy(F.abs("contribution").desc(), "component")))
    direction = F.when(F.col("contribution") > 0, "up").when(F.col("contribution") < 0, "down").otherwise("flat")
    rows = rows.withColumn("direction", direction)
    within = F.row_number().over(Window.partitionBy("company", "period_year", "direction").orderBy("place"))
    role = F.when((F.col("direction") == "down") & (F.col("_n") == 1), "largest_fall").when((F.col("direction") == "up") & (F.col("_n") <= top), "offset")
    return rows.withColumn("_n", within).withColumn("role", role).drop("_n")


def restatement_clues(reports: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A report's comparative figure against the earlier report's own, for report years one apart.

    reports: company, report_year, unit, and for each metric m the columns m and m_previous.
    """
    names = metrics or METRICS
    tall = reports.select("company", "report_year", "unit", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.col(f"{m}_previous").cast("double").alias("previous")) for m in names))))
    older = tall.select("company", "metric", (F.col("report_year") + 1).alias("report_year"), F.col("value").alias("original"), F.col("unit").alias("old_unit"))
    rows = tall.join(older, ["company", "metric", "report_year"])
    gap = F.abs(F.col("previous") - F.col("original"))
    same = gap <= F.greatest(F.lit(0.5), 1e-9 * F.greatest(F.abs("previous"), F.abs("original")))
    status = F.when(F.col("previous").isNull() | F.col("original").isNull() | ~F.col("unit").eqNullSafe(F.col("old_unit")), "not_comparable").when(same, "unchanged").otherwise("changed_or_restated")
    return rows.withColumn("status", status)


def pending_reports(reports: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Reports that have no result yet."""
    return reports.join(done, keys, "left_anti")


def audit_catalogue(catalogue: DataFrame, vintages: DataFrame) -> DataFrame:
    """AG9: of each declared company its coverage against the periods there are, and whether all names agree.

    names_ok: the vintages have one name, and it is the catalogue's. passed: complete and names_ok.
    """
    found = vintages.groupBy("company").agg(F.sort_array(F.collect_set("period_year")).alias("years"), F.count("*").alias("vintages"), F.min(F.coalesce("company_name", F.lit(""))).alias("_least"), F.max(F.coalesce("company_name", F.lit(""))).alias("_most"))
    rows = catalogue.join(found, "company", "left")
    complete = F.coalesce((F.col("start_year") <= F.col("end_year")) & (F.col("years") == F.sequence("start_year", F.greatest("start_year", "end_year"))), F.lit(False))
    names = F.coalesce((F.col("_least") == F.col("_most")) & (F.col("_least") == F.col("company_name")), F.lit(False))
    out = rows.select("company", "start_year", "end_year", "verified_periods", F.coalesce("vintages", F.lit(0)).alias("vintages"), F.coalesce(F.size("years"), F.lit(0)).alias("periods"), complete.alias("complete"), names.alias("names_ok"))
    return out.withColumn("passed", F.col("complete") & F.col("names_ok"))


def catalogue_totals(audited: DataFrame) -> DataFrame:
    """AG9's summary: companies, declared periods, vintages, and whether every check passed (null for no companies)."""
    return audited.agg(F.count("*").alias("companies"), F.coalesce(F.sum("verified_periods"), F.lit(0)).alias("declared_periods"), F.coalesce(F.sum("vintages"), F.lit(0)).alias("vintages"), F.count_if(~F.col("passed")).alias("failed"), F.every("passed").alias("all_passed"))
