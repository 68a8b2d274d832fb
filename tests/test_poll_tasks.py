"""A micro-batch of one landed file is worked on by all cores."""

from pyspark.sql import functions as F

from storyloom.streaming.poll import ITEMS, PollCycle


def test_items_of_one_file_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    rows = [(i, 1, f"g{i}", f"https://a.example/{i}", f"t{i}", None, f"<p>text {i}</p>", None, None) for i in range(64)]
    items = spark.createDataFrame(rows, ITEMS).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    items.coalesce(1).write.parquet(str(tmp_path / "landed"))
    seen = []
    monkeypatch.setattr(PollCycle, "store_articles", lambda self, got, batch, now: seen.append(got))
    for step in ("place", "match"):
        monkeypatch.setattr(PollCycle, step, lambda self, *_: None)
    PollCycle(spark, str(tmp_path / "store"), None).run(spark.read.schema(ITEMS).parquet(str(tmp_path / "landed")), 0)
    assert sorted(r.ord for r in seen[0].collect()) == list(range(64))
    parts = seen[0].groupBy(F.input_file_name()).count().collect()
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in parts) <= 64 // 2
