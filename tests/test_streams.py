"""Streams over small folders."""

import datetime as dt

from fiberlake.streaming import streams

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def events(spark, path, minutes):
    rows = [(k, START + dt.timedelta(minutes=m), "x", 1.0) for k, m in minutes]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    events(spark, path, [(1, 0), (1, 5), (1, 30), (2, 3), (9, 5000)])
    got = sorted((r.user_id, (r.end - r.start) // 60_000_000, r.n) for r in streams.sessions(spark, path, "10 minutes", "user_id").collect())
    assert got == [(1, 10, 1), (1, 15, 2), (2, 10, 1)]  # the last one may still grow


def test_work_for_new_files(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    for minutes in ([(1, 0), (2, 1)], [(3, 2)]):
        events(spark, path, minutes)
        streams.for_new(spark, path, lambda batch, number: seen.append(sorted(r.user_id for r in batch.collect())), str(tmp_path / "state"))
    assert seen == [[1, 2], [3]]
