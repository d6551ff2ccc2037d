"""The metric bonus without a cross join."""

from equity_jobs.operators import text


def test_bonus_pairs_no_questions_with_documents(spark):
    questions = spark.createDataFrame([(1, "is that so"), (2, "no")], "query_id bigint, text string")
    docs = spark.createDataFrame([(7, "this with"), (8, "this"), (9, "this with")], "doc_id bigint, text string")
    lexical = spark.createDataFrame([(1, 7, 2.0), (1, 8, 2.0), (2, 7, 1.0)], "query_id bigint, doc_id bigint, lexical double").selectExpr("*", "array('x') as matched")
    scored = text.hybrid_scores(lexical, None, ["doc_id"], text.statement_bonus(questions, docs, ["doc_id"], ["that"], [["this", "with"], ["never"]]))
    assert {(r.query_id, r.doc_id): r.score for r in scored.collect()} == {(1, 7): 1.25, (1, 8): 1.0, (2, 7): 1.0}
    assert "_k" not in scored._jdf.queryExecution().analyzed().toString()
