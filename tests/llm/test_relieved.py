"""Rounds of small jobs leave the driver's heap no time to grow: it collects while they run."""

import time

import pytest

from equity_jobs.llm import common, mixing
from equity_jobs.llm.components import components


@pytest.fixture
def full(spark):
    """How many full collections the driver's JVM has made so far."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    return lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_the_driver_collects_while_the_body_runs_and_not_after(spark, full, monkeypatch):
    monkeypatch.setattr(common, "EVERY", 0.05)
    before = full()
    with pytest.raises(KeyError), common.relieved(spark):
        time.sleep(2)
        raise KeyError
    after = full()
    assert after >= before + 2
    time.sleep(0.5)
    assert full() == after


def test_training_collects_within_a_fit(spark, full, monkeypatch):
    monkeypatch.setattr(common, "EVERY", 0.05)
    docs = spark.createDataFrame([(i, f"word{i % 7} common {'often' if i % 2 else 'seldom'}") for i in range(60)], "doc_id int, text string")
    domains = spark.createDataFrame([(i, ["high", "low"][i % 2]) for i in range(60)], "doc_id int, domain string")
    before = full()
    assert mixing.train(docs, domains, seen=2).domains == ["low", "high"]
    assert full() >= before + 3  # one before the fit of the only model


def test_components_collect_each_round(spark, full):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    before = full()
    assert {r.root for r in components(chain).collect()} == {0}
    assert full() >= before + 2
