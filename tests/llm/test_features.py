"""The mixing classifier's features are the words that enough labelled documents hold."""

from pyspark.sql import Row

from equity_jobs.llm import mixing


def features_of(classifier):
    return classifier.model.stages[0].vocabulary


def test_features_are_the_words_that_enough_documents_hold(spark):
    texts = [f"common {'often' if i % 2 else 'seldom'} word{i}" for i in range(40)]
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(texts)])
    domains = spark.createDataFrame([Row(doc_id=i, domain="high" if i % 2 else "low") for i in range(40)])
    assert set(features_of(mixing.train(docs, domains, seen=5))) == {"", "common", "often", "seldom"}
    assert set(features_of(mixing.train(docs, domains, seen=30))) == {"", "common"}
    assert len(features_of(mixing.train(docs, domains, seen=1, features=10))) == 10
