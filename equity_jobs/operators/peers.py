"""Peers: common periods, sample positions, coverage and identity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equity_jobs.functions.rules import finite


def common_periods(members: DataFrame, points: DataFrame) -> DataFrame:
    """Periods that every member of a group of two or more has, and which is the latest."""
    size = members.groupBy("peer_group").agg(F.countDistinct("company").alias("members"))
    rows = points.join(members, "company").groupBy("peer_group", "period_year").agg(F.countDistinct("company").alias("n")).join(size, "peer_group")
    common = rows.where((F.col("n") == F.col("members")) & (F.col("members") >= 2))
    return common.withColumn("is_latest", F.col("period_year") == F.max("period_year").over(Window.partitionBy("peer_group"))).select("peer_group", "period_year", "members", "is_latest")


def sample_positions(points: DataFrame, group: list[str], metric: str) -> DataFrame:
    """AG10: each member against its group's exact median, and whether it is among all those at either end."""
    stats = points.where(F.col(metric).isNotNull()).groupBy(*group).agg(F.percentile(metric, 0.5).alias("median"), F.min(metric).alias("_low"), F.max(metric).alias("_high"), F.count("*").alias("sample"))
    rows = points.join(stats, group)
    value = F.col(metric)
    close = F.abs(value - F.col("median")) <= F.greatest(F.lit(1e-12), 1e-9 * F.greatest(F.abs(value), F.abs("median")))
    label = F.when(value.isNull(), "unavailable").when(close, "near").when(value > F.col("median"), "above").otherwise("below")
    return rows.withColumns({"position": label, "at_min": value == F.col("_low"), "at_max": value == F.col("_high")}).drop("_low", "_high")


def peer_coverage(profiles: DataFrame, least: int = 2) -> DataFrame:
    """AG8: members and sorted names of each group, how many are wanting, and whether it is ready."""
    rows = profiles.groupBy("peer_group").agg(F.count("*").alias("companies"), F.sort_array(F.collect_list("company_name")).alias("names"))
    return rows.withColumns({"needed": F.greatest(F.lit(0), least - F.col("companies")), "ready": F.col("companies") >= least})


def peer_scope(selections: DataFrame, profiles: DataFrame) -> DataFrame:
    """AG8's scope: how many groups a selection spans, and their sorted names."""
    rows = selections.join(profiles, "company").groupBy("selection")
    return rows.agg(F.countDistinct("peer_group").alias("groups"), F.sort_array(F.collect_set("peer_group")).alias("group_names")).withColumn("same_group", F.col("groups") == 1)


IDENTITY = ["company_name", "published_date", "report_title", "source_url"]


def reconcile_facts(points: DataFrame, facts: DataFrame) -> DataFrame:
    """Points and facts of a company and period side by side, with differs: every identity field on which they do not agree, and both values.

    points and facts have company, period_year and the identity fields; _point and _fact
    tell which side is there. Nulls agree with nulls alone.
    """
    right = facts.select("company", "period_year", *(F.col(c).alias(f"_{c}") for c in IDENTITY), *(c for c in facts.columns if c not in ("company", "period_year", *IDENTITY)), F.lit(True).alias("_fact"))
    joined = points.withColumn("_point", F.lit(True)).join(right, ["company", "period_year"], "full_outer")
    both = F.col("_point") & F.col("_fact")
    pair = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("point_value"), F.col(f"_{c}").cast("string").alias("fact_value"))
    return joined.withColumn("differs", F.array_compact(F.array(*(F.when(both & ~F.col(c).eqNullSafe(F.col(f"_{c}")), pair(c)) for c in IDENTITY))))


def enrich(points: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Points with the ratios of audited facts that agree with them; what does not fit, with the reason; and a ledger with one row a differing field.

    facts: company, period_year, the identity fields, cost, inventory, prior_inventory,
    contract_liabilities, prior_contract_liabilities. Ratios rest on positive amounts and a cost below revenue.
    """
    rows = reconcile_facts(points, facts)
    amounts = ["revenue", "net_profit", "operating_cash_flow", "total_assets", "cost", "inventory", "prior_inventory", "contract_liabilities", "prior_contract_liabilities"]
    sound = F.lit(True)
    for c in amounts:
        sound &= F.coalesce(finite(F.col(c)) > 0, F.lit(False))
    reason = F.when(F.col("_fact").isNull(), "no_facts").when(F.col("_point").isNull(), "no_point").when(F.size("differs") > 0, "identity").when(~sound, "amounts").when(~(F.col("cost") < F.col("revenue")), "cost")
    marked = rows.withColumn("reason", reason)
    change = lambda now, before: F.col(now) / F.col(before) - 1
    ratios = {
        "gross_margin": (F.col("revenue") - F.col("cost")) / F.col("revenue"), "inventory_to_assets": F.col("inventory") / F.col("total_assets"), "inventory_growth": change("inventory", "prior_inventory"), "contract_liabilities_to_revenue": F.col("contract_liabilities") / F.col("revenue"),
        "contract_liabilities_growth": change("contract_liabilities", "prior_contract_liabilities"), "cash_conversion": F.col("operating_cash_flow") / F.col("net_profit"),
    }
    good = marked.where("reason is null").withColumns(ratios).drop("reason", "differs", "_point", "_fact", *(f"_{c}" for c in IDENTITY))
    return good, marked.where("reason is not null").select("company", "period_year", "reason"), rows.select("company", "period_year", F.inline("differs"))


def audit_identities(first: DataFrame, second: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys missing on either side, and rows that disagree in a compared column."""
    right = second.select(*keys, *(F.col(c).alias(f"_{c}") for c in compared), F.lit(True).alias("_there"))
    rows = first.withColumn("_here", F.lit(True)).join(right, keys, "full_outer")
    differs = F.array_compact(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in compared)))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_here").isNull(), "extra").when(F.size("_differs") > 0, F.concat(F.lit("mismatch:"), F.array_join("_differs", "+"))).otherwise("ok")
    return rows.withColumn("_differs", differs).select(*keys, status.alias("status"))
