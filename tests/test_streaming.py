import datetime

from pixelplan.streaming import downloads


def test_outcomes_are_counted_by_window(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, 200, at(0)), (2, 1, 200, at(4)), (3, 2, 404, at(4)), (4, 2, 200, at(7)), (5, 2, 200, at(40))]
    spark.createDataFrame(rows, downloads.OUTCOME).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = downloads.follow(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("outcomes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        stream.processAllAvailable()
        got = sorted((r.start.minute, r.status, r.tiles) for r in spark.table("outcomes").collect())
    finally:
        stream.stop()
    assert got == [(0, 200, 2), (0, 404, 1), (5, 200, 1)]
