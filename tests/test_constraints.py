"""The constraint checker against brute force."""

import random

from pyspark.sql import functions as F

from equity_jobs.operators.constraints import Depends, Holds, Unique, broken, checked, coverage, ledger

KIND = "id int, company int, name string, code string, amount double, violations string"


def test_violations_equal_brute_force(spark):
    draw = random.Random(12)
    rows = [(i, draw.choice([1, 2, 3, 4, None]), draw.choice(["a", "a", "a", "b", None]), draw.choice(["x", f"y{i}", f"z{i}", None]), draw.choice([1.0, -1.0, None]), "clash") for i in range(120)]
    rows += [(500, 9, "only", "u1", 1.0, "c"), (501, 9, "only", "u2", 1.0, "c")]
    table = spark.createDataFrame(rows, KIND).repartition(4).drop("violations")
    rules = [Holds("positive", F.col("amount") > 0, F.col("amount")), Unique("once", ("code",)), Depends("one_name", ("company",), "name"), Unique("pair", ("company", "code")), Depends("one_code", ("company",), "code")]
    out = checked(table, ["id"], rules)
    got = {r.id: [(v.rule, v.value, v.partner) for v in r.violations] for r in out.collect()}
    want = {r[0]: [] for r in rows}
    text = lambda v: "-" if v is None else str(v)
    at = {"company": 1, "name": 2, "code": 3}
    for r in rows:
        if not (r[4] is not None and r[4] > 0):
            want[r[0]].append(("positive", None if r[4] is None else str(r[4]), None))
        for rule in rules[1:]:
            columns = rule.columns if isinstance(rule, Unique) else rule.given
            group = [o for o in rows if all(o[at[c]] == r[at[c]] for c in columns)]
            value = (lambda o: "") if isinstance(rule, Unique) else (lambda o, rule=rule: text(o[at[rule.fixed]]))
            ends = sorted((value(o), str(o[0])) for o in group)
            clash = len(group) > 1 if isinstance(rule, Unique) else ends[0][0] != ends[-1][0]
            if clash:
                first = str(r[0]) == ends[0][1] if isinstance(rule, Unique) else value(r) == ends[0][0]
                shown = "/".join(text(r[at[c]]) for c in columns) if isinstance(rule, Unique) else value(r)
                want[r[0]].append((rule.name, shown, ends[-1][1] if first else ends[0][1]))
    assert got == want
    assert {(r.id, r.rule) for r in ledger(out, ["id"]).collect()} == {(i, v[0]) for i, vs in want.items() for v in vs}
    assert {r.id: r.b for r in out.select("id", broken().alias("b")).collect()} == {i: [v[0] for v in vs] for i, vs in want.items()}
    assert checked(table.limit(0), ["id"], rules).count() == 0 and all(r.violations == [] for r in checked(table, ["id"], []).collect())


def test_rules_on_the_same_columns_share_a_group(spark):
    table = spark.createDataFrame([(1, 1, "a", "x", 1.0)], KIND.rpartition(",")[0])
    plan = checked(table, ["id"], [Depends(c, ("company",), c) for c in ("name", "code", "amount")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.count("Join") == 1


def test_coverage_both_ways(spark):
    have = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (None, 1)], "a int, b int")
    want = spark.createDataFrame([(1, 1), (3, 3)], "a int, b int")
    assert {tuple(r) for r in coverage(have, want, ["a", "b"]).collect()} == {(3, 3, "missing"), (2, 2, "unexpected"), (None, 1, "unexpected")}
