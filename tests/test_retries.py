"""Download tries as a stream against a plain loop."""

import random
import time

from pixelplan.streaming import retries


def loop(answers):
    """What became of a tile, and how many answers were asked for."""
    used, waited = 0, 0.0
    left = iter(answers)
    for _ in range(retries.TRIES):
        for k in range(retries.SESSION + 1):
            status, image = next(left, ("none left", None))
            if status == "none left":
                return None
            used += 1
            if status not in retries.AGAIN:
                break
            if k < retries.SESSION:
                waited += [0.0, 1.0, 2.0, 4.0, 8.0][k]
        if status == 200 and image:
            return "tile", used, waited
        if status is not None and status not in retries.AGAIN:
            return "missing", used, waited
        waited += 1.0
    return "missing", used, waited


def test_stream_equals_the_loop(spark, tmp_path):
    r = random.Random(6)
    tiles = {t: [(r.choice([429, 429, 503, 500, None, 200, 404]) if t % 3 else r.choice([429, 502]), r.random() < 0.7) for _ in range(r.choice([3, 18, 20]))] for t in range(80)}
    rows = [(t, n, *x) for t, own in tiles.items() for n, x in enumerate(own)]
    r.shuffle(rows)
    rows += rows[:40]
    for k in range(2):
        spark.createDataFrame(rows[k::2], retries.ANSWERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(retries.ANSWERS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    retries.replayed(retries.outcomes(stream, timeout=3600).writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "state")))
    got = {x.tile: (x.outcome, x.answers, x.waited) for x in spark.table("settled").collect()}
    assert got == {t: loop(own) for t, own in tiles.items() if loop(own)} and spark.table("settled").count() == len(got)


def test_missing_answers_are_exceptions_after_a_while(spark, tmp_path):
    spark.createDataFrame([(1, 0, 429, None), (2, 0, 200, True)], retries.ANSWERS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(retries.ANSWERS).parquet(str(tmp_path / "in"))
    query = retries.outcomes(stream, timeout=0.1).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            if spark.table("late").count() == 2:
                break
            time.sleep(1)
        assert {x.tile: (x.outcome, x.answers) for x in spark.table("late").collect()} == {2: ("tile", 1), 1: ("missing", 4)}
    finally:
        query.stop()
