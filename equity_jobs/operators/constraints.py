"""Denial constraints as data, and every row that breaks one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Holds:
    """What every row must fulfil; a null counts as broken. value: what to show of a row that does not."""

    name: str
    test: Column
    value: Column | None = None


@dataclass(frozen=True)
class Unique:
    """Columns that no two rows may share."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Depends:
    """given decides fixed: rows that agree in the former must agree in the latter. Null is a value like others."""

    name: str
    given: tuple[str, ...]
    fixed: str


VIOLATION = "array<struct<rule:string,value:string,partner:string>>"


def shown(*columns: str) -> Column:
    """Columns as one text, nulls as -."""
    return F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))


def checked(rows: DataFrame, key: list[str], rules: list[Holds | Unique | Depends]) -> DataFrame:
    """rows with violations: rule, value and partner (the key of a row that it clashes with), in the order of the rules.

    Rules on one row need no exchange. For the others, groups are aggregated first, so a
    group of most rows is one row a task; only groups that clash are joined back. The
    partner of a row is the group's first row or, for the first itself, its last, by value
    and then key.
    """
    base = rows.withColumn("_key", shown(*key))
    given = {n: r.columns if isinstance(r, Unique) else r.given for n, r in enumerate(rules) if not isinstance(r, Holds)}
    text = {n: F.lit("") if isinstance(r, Unique) else F.coalesce(F.col(r.fixed).cast("string"), F.lit("-")) for n, r in enumerate(rules) if not isinstance(r, Holds)}
    out = base
    for g, columns in enumerate(dict.fromkeys(given.values())):  # rules on the same columns share their groups
        own = [n for n, c in given.items() if c == columns]
        ends = [f(F.struct(text[n].alias("v"), F.col("_key").alias("k"))).alias(f"_{name}_{n}") for n in own for name, f in (("first", F.min), ("last", F.max))]
        clash = {n: F.col(f"_n_{g}") > 1 if isinstance(rules[n], Unique) else F.col(f"_first_{n}")["v"] != F.col(f"_last_{n}")["v"] for n in own}
        groups = base.groupBy(*(F.col(c).alias(f"_given_{g}_{i}") for i, c in enumerate(columns))).agg(*ends, F.count("*").alias(f"_n_{g}"))
        groups = groups.select("*", *(c.alias(f"_clash_{n}") for n, c in clash.items())).where(" or ".join(f"_clash_{n}" for n in own)).drop(f"_n_{g}")
        same = F.lit(True)
        for i, c in enumerate(columns):
            same &= F.col(c).eqNullSafe(F.col(f"_given_{g}_{i}"))
        out = out.join(groups, same, "left").drop(*(f"_given_{g}_{i}" for i in range(len(columns))))
    entries = []
    for n, rule in enumerate(rules):
        if isinstance(rule, Holds):
            value = F.lit(None).cast("string") if rule.value is None else rule.value.cast("string")
            entries.append(F.when(~F.coalesce(rule.test, F.lit(False)), F.struct(F.lit(rule.name).alias("rule"), value.alias("value"), F.lit(None).cast("string").alias("partner"))))
            continue
        first, last = F.col(f"_first_{n}"), F.col(f"_last_{n}")
        at_first = F.col("_key") == first["k"] if isinstance(rule, Unique) else text[n] == first["v"]
        value = shown(*given[n]) if isinstance(rule, Unique) else text[n]
        entries.append(F.when(F.col(f"_clash_{n}"), F.struct(F.lit(rule.name).alias("rule"), value.alias("value"), F.when(at_first, last["k"]).otherwise(first["k"]).alias("partner"))))
    made = [f"_{c}_{n}" for n in given for c in ("first", "last", "clash")]
    return out.withColumn("violations", F.array_compact(F.array(*entries)) if entries else F.array().cast(VIOLATION)).drop("_key", *made)


def broken(violations: str = "violations") -> Column:
    """The names of the rules that a row of checked() breaks."""
    return F.col(violations)["rule"]


def ledger(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a violation of checked(): the row's key, rule, value and partner."""
    return rows.select(*key, F.inline("violations"))


def coverage(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status, missing or unexpected, where rows and the expected keys differ, both ways."""
    have, want = rows.select(*keys).distinct(), expected.select(*keys).distinct()
    return want.join(have, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(have.join(want, keys, "left_anti").withColumn("status", F.lit("unexpected")))
