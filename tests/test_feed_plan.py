"""The feed's landed folder."""

from equity_jobs.plans import reports
from equity_jobs.streaming import feed


def test_feed_lands_in_its_own_partitions(spark, monkeypatch, tmp_path):
    rows = spark.range(90).repartition(5).selectExpr("id as instrument_id", "id as announcement_id", "'t' as title", "date'2020-01-01' as published_date", "'u' as url")
    monkeypatch.setattr(reports, "shared_dir", lambda *_: str(tmp_path))
    monkeypatch.setattr(reports, "view", lambda *_: rows)
    monkeypatch.setattr(feed, "run_feed", lambda *_: (_ for _ in ()).throw(StopIteration))
    try:
        reports.ss1(spark, "")
    except (StopIteration, RuntimeError):
        pass
    assert len(list(tmp_path.glob("landed/*.parquet"))) > 2
