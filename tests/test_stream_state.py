"""Episodes with event-time timers: out-of-order, joining and late rows, and several batches."""

from datetime import datetime, timedelta

from fieldspark.plans.streams import _with_timers
from fieldspark.streaming import streams

T0 = datetime(2024, 1, 1)


def _write(spark, path, n, rows):
    """One file of (series, minute, value), older files first."""
    import os
    import time

    data = [(k, T0 + timedelta(minutes=m), v) for k, m, v in rows]
    spark.createDataFrame(data, "series_id string, ts timestamp, y double").coalesce(1).write.parquet(f"{path}/part={n}")
    for f in os.listdir(f"{path}/part={n}"):
        os.utime(f"{path}/part={n}/{f}", (time.time() + n * 10 - 1000,) * 2)


def test_crossing_episodes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    _write(spark, src, 0, [("a", 0, 9.0), ("a", 16, 1.0), ("b", 5, None), ("b", 6, 8.0)])
    _write(spark, src, 1, [("a", 8, 2.0), ("b", 30, 0.0), ("c", 31, 9.0)])  # joins the two of a; b's second episode
    _write(spark, src, 2, [("a", 60, 7.0), ("c", 62, 3.0)])
    _write(spark, src, 3, [("a", 1, 0.0), ("c", 63, 1.0), ("z", 200, 0.0)])  # a's row is behind the watermark
    _write(spark, src, 4, [("z", 400, 0.0)])
    stream = _with_timers(spark).readStream.schema("series_id string, ts timestamp, y double").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = streams.crossing_episodes(stream, 5.0, 600, "15 minutes")
    q = got.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    us = lambda m: None if m is None else int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + m * 60_000_000
    want = {("a", us(0), us(16), us(8)), ("b", us(5), us(6), None), ("b", us(30), us(30), us(30)), ("c", us(31), us(31), None), ("a", us(60), us(60), None), ("c", us(62), us(63), us(62)), ("z", us(200), us(200), us(200))}
    assert sorted(map(str, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(str, want))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
