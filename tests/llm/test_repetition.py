"""The mixing classifier's repetition feature."""

from equity_jobs.llm import mixing


def test_repetition_counts_the_whole_text(spark):
    clean = [f"w{i}" for i in range(1000)]
    texts = [clean, ["x"] * 400 + clean, clean[:450] + ["x"] * 100 + clean[450:], ["x"] * 50, [""]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.r for r in table.select("i", mixing.repetition(table["text"]).alias("r")).collect()}
    assert [round(got[i], 3) for i in range(5)] == [0.0, round(4 * 99 / 1400, 3), round(98 / 1100, 3), 0.98, 0.0]
