"""Streams give what batches give."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from rivulet.sources.files import table
from rivulet.streaming import counters, ingest, rolling

SF = "/root/testdata/sf0.001"
UTC = datetime.timezone.utc


def drained(query_frame, name, mode="complete"):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_frame.sparkSession.table(name)


@pytest.mark.parametrize("kind", ["tumbling", "sliding"])
def test_stream_equals_batch(spark, tmp_path, kind):
    batch = table(spark, SF, "events")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    measures = {"n": F.count(F.lit(1)), "cents": F.sum(F.floor(F.col("value") * 100 + 0.5))}
    f = (lambda df: counters.tumbling(df, "ts", ["event_type"], "1 hour", measures)) if kind == "tumbling" else (lambda df: counters.sliding(df, "ts", ["event_type"], "15 minutes", "5 minutes", measures, "60 days"))
    got = drained(f(stream), f"stream_{kind}")
    assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    schema = "ts timestamp, k string"
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m, tzinfo=UTC)
    for i, minutes in enumerate(([1, 2], [30], [3, 31], [59])):
        spark.createDataFrame([(at(m), "a") for m in minutes], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    for i in range(4):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in{i}")
        out = counters.tumbling(stream, "ts", ["k"], "10 minutes", {"n": F.count(F.lit(1))}, "5 minutes")
        assert out.isStreaming
    moved = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    rows = drained(counters.tumbling(moved, "ts", ["k"], "10 minutes", {"n": F.count(F.lit(1))}, "5 minutes"), "late_rows", "append").collect()
    assert {r.window_start.minute for r in rows} <= {0, 30}


def test_alert_logic(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(hours=i), f, t) for i, (f, t) in enumerate([(0, 10), (100, 200), (120, 200), (1, 200), (100, 149)])]
    counts = counters.gated(spark.createDataFrame(rows, "window_start timestamp, failed long, total long"), "failed", "total", 150, 0.5)
    assert [r.triggered for r in counts.orderBy("window_start").collect()] == [False, True, True, False, False]
    assert [r.window_start.hour for r in counters.on_change(counts, [], "window_start").orderBy("window_start").collect()] == [1, 3]
    days = spark.createDataFrame([(start, "a", 100), (start + datetime.timedelta(days=1), "a", 50), (start + datetime.timedelta(days=2), "a", 40)], "window_start timestamp, k string, n long")
    assert [(r.drop_percent, r.triggered) for r in counters.day_over_day(days, "n", ["k"]).orderBy("window_start").collect()] == [(50.0, True), (20.0, False)]
    limits = counters.day_limit(spark.createDataFrame([(15, 20), (15, 70)], "used long, life long"), "used", "life", 10)
    assert [(r.allowed, r.limited) for r in limits.collect()] == [(20, False), (10, True)]
    speed = spark.createDataFrame([(11, 0, 100), (10, 0, 100), (20, 5, 5)], "tokens_output long, timestamp_first_byte long, timestamp_last_byte long")
    assert [r.qualifies for r in counters.qualified(speed, 100.0).collect()] == [True]


def test_append_lake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    event = {"_datalake_key": "inference.event", "event_date": "2024-01-01", "model": "m"}
    (tmp_path / "in" / "a.txt").write_text(json.dumps({"events": [event, event | {"_datalake_key": "no.where"}]}))
    stream = spark.readStream.text(f"{tmp_path}/in")
    ingest.append_lake(stream, f"{tmp_path}/lake", f"{tmp_path}/bad", f"{tmp_path}/cp", ["inference.event"], every=None).awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/lake").collect()
    assert [(r.model, r.database, r.table, str(r.event_date)) for r in rows] == [("m", "inference", "event", "2024-01-01")]
    assert spark.read.json(f"{tmp_path}/bad").count() == 1


def test_coalesced_and_once(spark, tmp_path):
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema("k string, n int, v string").parquet(f"{tmp_path}/in")
    ingest.coalesced(stream, ["k"], "n", lambda df: got.extend(tuple(r) for r in df.collect()), f"{tmp_path}/cp", every=None).awaitTermination(120)
    assert sorted(got) == [("a", 2, "y"), ("b", 1, "z")]
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("e1", at), ("e1", at), ("e2", at)], "id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/ev")
    events = spark.readStream.schema("id string, ts timestamp").parquet(f"{tmp_path}/ev")
    assert sorted(r.id for r in drained(ingest.once(events, "id", "ts"), "once", "append").collect()) == ["e1", "e2"]


def test_schedule():
    now = datetime.datetime(2024, 3, 11, 1, 30, 45, tzinfo=UTC)  # a Monday
    assert ingest.lag_floor(now) == datetime.datetime(2024, 3, 11, 1, 25, tzinfo=UTC)
    assert ingest.incremental_start(now) == datetime.datetime(2024, 3, 4, tzinfo=UTC)
    assert ingest.full_start(now, datetime.datetime(2024, 2, 1, tzinfo=UTC)) == datetime.datetime(2024, 2, 1, tzinfo=UTC)
    assert ingest.full_start(now, datetime.datetime(2023, 1, 1, tzinfo=UTC)) == datetime.datetime(2024, 1, 15, tzinfo=UTC)
    assert ingest.is_full(now, None) and ingest.is_full(now, now - datetime.timedelta(hours=2)) and not ingest.is_full(now, now - datetime.timedelta(minutes=50))


def test_rolling_usage(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hour = 3_600_000
    try:
        spark.createDataFrame([("a", 0, 5), ("a", 4 * hour, 6), ("a", 10 * hour, 7), ("b", 0, 20)], "key string, ts_ms long, amount long").coalesce(1).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ts_ms long, amount long").parquet(f"{tmp_path}/in")
        got = drained(rolling.rolling_usage(stream, 5, 10), "rolling", "update").collect()
        assert sorted(tuple(r) for r in got) == [("a", 7, 10 * hour, False), ("b", 20, 0, True)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
