"""Secrets longer than any prefix."""

import numpy as np

from equity_jobs.llm import secret_scan


def test_long_tokens_are_judged_whole(spark, monkeypatch):
    draw = np.random.default_rng(2)
    hexes = ["".join(draw.choice(list("0123456789abcdef"), 300)) for _ in range(40)]
    automaton = secret_scan.infer([secret_scan.classes(v) for v in hexes])
    assert np.mean([secret_scan.is_secret(automaton, v) for v in hexes]) >= 0.9
    assert not secret_scan.is_secret(automaton, hexes[0] + "Zebra-Quilt" * 40)
    scanned = secret_scan.scan(spark.createDataFrame([(1, f"token={hexes[0]}")], "doc_id bigint, text string"))
    learned = []
    monkeypatch.setattr(secret_scan, "infer", lambda values, others, alpha: learned.extend(values))
    secret_scan.learn(scanned)
    assert learned == [secret_scan.classes(hexes[0])] and hexes[0] not in str(scanned.collect()) and len(secret_scan.classes(hexes[0] + "Z")) == 301


def test_candidates_are_all_tokens_that_base_spans_leave_open():
    run = "0123456789abcdef"
    text = f"prefix_{run}Xyz {run} token={run}{run} abcdefghijklm 123456-789012 short1 AKIA{'A' * 16}tail"
    base = secret_scan.base_spans(text)
    assert [v for *_, v in secret_scan.candidates(text, base)] == [f"prefix_{run}Xyz", "abcdefghijklm", "123456-789012", f"AKIA{'A' * 16}tail"]


def test_redaction_takes_the_union_of_spans(spark):
    run = "0123456789abcdef"
    values = [f"prefix_{run}Xyz"] * 20
    docs = spark.createDataFrame([(1, f"see prefix_{run}Xyz there", 0)], "doc_id bigint, text string, n_chars bigint")
    got = secret_scan.redact(docs, secret_scan.infer([secret_scan.classes(v) for v in values])).first()
    assert got.text == "see [SECRET] there" and got.n_chars == 18
