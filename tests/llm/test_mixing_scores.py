"""Posteriors from the texts' bytes equal spark.ml's own transform; steps of the rates compile nothing."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equity_jobs.llm import mixing

ODD = [
    None, "", " ", "  two  spaces ", "...", "Common, OFTEN-seldom#word3|x", "ÀÉ Straße ΣΑΣ İstanbul", "a\tb\nc\u000bd\u000ce\rf", "a b　c\u001cd\u0085e",
    "$$$ ## %% && ** ||", "common " * 250, "日本語 テキスト、common。seldom", " often ", "x" * 5000 + " 😀 often",
]


def test_posteriors_equal_the_models_transform(spark):
    texts = [f"common {'often' if i % 2 else 'seldom'} straße {'σας' if i % 3 else '#$'} word{i % 7}, istanbul" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts + ODD)), "doc_id int, text string")
    domains = spark.createDataFrame([(i, ["high", "low", "toxic"][i % 3 if i % 5 else i % 2]) for i in range(60)], "doc_id int, domain string")
    classifier = mixing.train(docs, domains, seen=2)
    scored = classifier.model.transform(mixing._shaped(docs)).select("doc_id", *(F.get(vector_to_array(f"_q{i}"), 1) for i in range(2))).collect()
    want = {i: (a, (1 - a) * b, (1 - a) * (1 - b)) for i, a, b in scored}
    rows = classifier.posteriors(docs)
    assert "UDF" not in rows._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in rows.collect()}
    assert rows.schema["doc_id"].dataType.simpleString() == "int" and len(got) == len(want)
    assert max(np.abs(np.array(got[i].p) - want[i]).max() for i in want) < 1e-12
    tokens = docs.select("doc_id", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))).collect()
    assert {i: got[i].tokens for i in got} == dict(tokens)


def test_steps_of_the_rates_compile_nothing_anew(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([1, 1, 1], 200)
    members = spark.createDataFrame([(float(rng.integers(1, 50)), x.tolist()) for x in p], "tokens double, p array<double>")
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME
    mixing.fit_rates(members, [0.5, 0.3, 0.2])
    before = compiled().getCount()
    mixing.fit_rates(members, [0.7, 0.2, 0.1])
    assert compiled().getCount() == before
