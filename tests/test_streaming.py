from datetime import datetime

from inkspan.streaming import errors


def test_events_come_once(spark, tmp_path):
    ts = datetime(2024, 1, 1, 10)
    rows = [("a", 1, ts, "download", "m", False), ("a", 1, ts, "download", "m", False), ("b", 2, ts, "download", "m", True)]
    spark.createDataFrame(rows, errors.EVENTS).write.parquet(str(tmp_path / "in"))
    counts = errors.errors_per_window(errors.error_events(spark, str(tmp_path / "in")))
    query = counts.writeStream.outputMode("update").format("memory").queryName("error_counts").start()
    query.processAllAvailable()
    query.stop()
    (row,) = spark.sql("select stage, errors, retries from error_counts").collect()
    assert tuple(row) == ("download", 1, 1)
