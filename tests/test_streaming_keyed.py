"""Durable subscriptions, projectors and keyed state, stopped and started again in the middle."""

import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.operators import sessions
from rivulet.plans.streams import rocks
from rivulet.streaming import counters, keyed, projectors, replay

UTC = datetime.timezone.utc


def put(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def drain(frame, path, checkpoint, tell=None):
    """All there is, appended; a new query on the same checkpoint. ``tell`` gets the rows of state after it."""
    query = frame.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(path)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    if tell is not None and query.lastProgress:
        tell.append(sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]))


def event(a, n, id=None, type="t", data="x"):
    return (a, n, id or f"{a}{n}", type, data)


def test_history_then_live_without_gap_or_repeat(spark, tmp_path):
    log, out, cp = tmp_path / "log", tmp_path / "out", tmp_path / "cp"
    after = {"a": 1, "b": -1, "none": -1}
    got = lambda: sorted((r.aggregate_id, r.seq) for r in spark.read.schema(replay.SCHEMA).parquet(str(out)).collect())
    put(spark, [event("a", n) for n in range(5)] + [event("b", 0), event("c", 0)], log, replay.SCHEMA)
    drain(replay.subscribe(spark, str(log), after), out, cp)
    assert got() == [("a", 2), ("a", 3), ("a", 4), ("b", 0)]
    drain(replay.subscribe(spark, str(log), after), out, cp)  # nothing new
    put(spark, [event("a", 6), event("a", 7), event("b", 1)], log, replay.SCHEMA)  # 5 is not there yet
    drain(replay.subscribe(spark, str(log), after), out, cp)
    assert got() == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1)]
    put(spark, [event("a", 5), event("a", 6), event("a", 8)], log, replay.SCHEMA)  # 6 again: a writer's second attempt
    drain(replay.subscribe(spark, str(log), after), out, cp)
    assert got() == [("a", n) for n in range(2, 9)] + [("b", 0), ("b", 1)]


def test_subscription_to_an_empty_log(spark, tmp_path):
    drain(replay.subscribe(spark, str(tmp_path / "nothing"), {"a": -1}), tmp_path / "out", tmp_path / "cp")
    assert spark.read.schema(replay.SCHEMA).parquet(str(tmp_path / "out")).count() == 0


def test_retraction_equals_batch(spark, tmp_path):
    schema = "session_id string, message_id string, seq long, tokens long, removed boolean"
    parts = [
        [("s", "m", 1, 10, False), ("s", "n", 2, 5, False), ("t", "m", 1, 7, False)],
        [("s", "m", 4, 30, False), ("t", "m", 2, None, False), ("s", "n", 3, 5, True)],
        [("s", "m", 3, 99, False), ("t", "k", 9, 2, None), ("s", "n", 1, 50, False)],  # late versions change nothing
    ]
    with rocks(spark):
        for part in parts:
            put(spark, part, tmp_path / "in", schema)
            drain(keyed.retracted(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path / "out", tmp_path / "cp")
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {r.session_id: r.n for r in rows.groupBy("session_id").agg(F.sum("delta").alias("n")).collect()}
    every = spark.createDataFrame([r for p in parts for r in p], schema).withColumn("tokens", F.when(F.coalesce("removed", F.lit(False)), 0).otherwise(F.coalesce("tokens", F.lit(0))))
    assert got == {r.session_id: r.tokens for r in sessions.usage_delta(every).collect()} == {"s": 30, "t": 2}
    assert {r.tokens for r in rows.filter("session_id = 's'").collect()} == {15, 30}


@pytest.mark.parametrize("kept", ["minute", "two minutes", "day"])
def test_counters_expire(spark, tmp_path, kept):
    at = lambda m, s=0: datetime.datetime(2024, 1, 1, 10, m, s, tzinfo=UTC)
    schema, state = "key string, ts timestamp", []
    parts = [[("a", at(0, s)) for s in range(5)] + [("b", at(0))], [("a", at(0, 30)), ("a", at(1))], [(None, at(0) + datetime.timedelta(days=3))]]
    with rocks(spark):
        for part in parts:
            put(spark, part, tmp_path / "in", schema)
            drain(keyed.expiring_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "key", "ts", kept, limit=6), tmp_path / "out", tmp_path / "cp", state)
    rows = spark.read.parquet(str(tmp_path / "out"))
    length = keyed.KEPT[kept][0]
    got = sorted((r.key, r.start_ms, r.n) for r in rows.filter("kind = 'final'").collect())
    want = {}
    for key, ts in [r for p in parts for r in p if r[0]]:
        slot = key, int(ts.timestamp() * 1000) // length * length
        want[slot] = want.get(slot, 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())
    assert [(r.key, r.n >= 6) for r in rows.filter("kind = 'limited'").collect()] == [("a", True)]
    assert state[1] > state[-1]  # what is left is the last, far event's


def test_only_the_slow_subscriber_overflows(spark, tmp_path):
    at = lambda ms: datetime.datetime(2024, 1, 1, tzinfo=UTC) + datetime.timedelta(milliseconds=ms)
    schema = "subscriber string, event_id string, ts timestamp"
    burst = [("slow", f"e{n:04}", at(n)) for n in range(260)]
    steady = [("steady", f"e{n:04}", at(10 * n)) for n in range(260)] + [("full", f"e{n:04}", at(n)) for n in range(256)]
    with rocks(spark):
        for part in (burst[:200] + steady[:100], burst[200:] + steady[100:], [("slow", "later", at(5000)), ("far", "x", at(10_000_000))]):
            put(spark, part, tmp_path / "in", schema)
            drain(keyed.bounded_buffers(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), tmp_path / "out", tmp_path / "cp")
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault((r.subscriber, r.outcome), set()).add(r.event_id)
    names = lambda n: {f"e{i:04}" for i in range(n)}
    assert got[("slow", "overflow")] == {"e0256"} and got[("slow", "delivered")] == names(256)
    assert got[("steady", "delivered")] == names(260) and got[("full", "delivered")] == names(256)
    assert {k for k, o in got if o == "overflow"} == {"slow"}


def test_a_failing_projector_repeats_alone(spark, tmp_path):
    rows = [event("a", n, type=("x", "y", "z")[n % 3]) for n in range(9)]
    put(spark, rows, tmp_path / "in", replay.SCHEMA)
    calls, broken = [], ["y"]

    def fold(name):
        def run(batch, number):
            calls.append((name, number, sorted(r.seq for r in batch.collect())))
            if name in broken:
                raise ValueError("broken")

        return run

    found = projectors.Projectors(str(tmp_path / "progress"))
    for name in "xyz":
        found.register(name, [name], fold(name))
    with pytest.raises(ValueError, match="already"):
        found.register("x", [], fold("x"))
    stream = spark.readStream.schema(replay.SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="batch 0: y: broken"):
        found.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert sorted(c[0] for c in calls) == ["x", "y", "z"]
    assert [found.finished(spark, n) for n in "xyz"] == [0, -1, 0]
    broken.clear()
    found.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert [c[0] for c in calls] == ["x", "y", "z", "y"] and calls[-1] == ("y", 0, [1, 4, 7])
    put(spark, [event("a", 9, type="x")], tmp_path / "in", replay.SCHEMA)
    found.start(stream, str(tmp_path / "cp")).awaitTermination()
    assert calls[4:] == [("x", 1, [9]), ("y", 1, []), ("z", 1, [])]


def test_day_over_day_equals_batch(spark, tmp_path):
    at = lambda d, h: datetime.datetime(2024, 1, d, h, tzinfo=UTC)
    schema = "window_start timestamp, kind string, n long"
    parts = [[(at(1, 3), "a", 10), (at(1, 4), "a", 0), (at(2, 5), "a", 4), (at(1, 3), "b", 5)], [(at(2, 3), "a", 5), (at(2, 4), "a", 9), (at(1, 5), "a", 9)], [(at(3, 3), "a", 4), (at(3, 5), "a", 1), (at(4, 3), "b", 1)]]
    with rocks(spark):
        for part in parts:
            put(spark, part, tmp_path / "in", schema)
            drain(counters.day_over_day_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "n", F.col("kind"), kept_ms=6 * 3_600_000), tmp_path / "out", tmp_path / "cp")
    got = sorted((r.key, r.start_ms, r.value, r.before, r.drop_percent, r.triggered) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = counters.day_over_day(spark.createDataFrame([r for p in parts for r in p], schema), "n", ["kind"])
    want = sorted((r.kind, int(r.window_start.replace(tzinfo=UTC).timestamp() * 1000) if r.window_start.tzinfo is None else int(r.window_start.timestamp() * 1000), float(r.n), float(r.before), r.drop_percent, r.triggered) for r in batch.collect())
    assert got == want and len(got) == 5 and {g[-1] for g in got} == {True, False}
