"""The event log's streams, run in parts, give what batches give."""

import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.operators import eventlog, joins
from rivulet.sources import sinks
from rivulet.streaming import counters, ingest, log

UTC = datetime.timezone.utc
SCHEMA = "aggregate_id string, seq long, id string, type string, data string"


@pytest.fixture(autouse=True)
def folder(tmp_path):
    (tmp_path / "in").mkdir()


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def put(spark, rows, path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(frame, path, checkpoint):
    """All there is, written; the query is a new one each time, on the same checkpoint."""
    frame.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).option("path", str(path)).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def test_judged_over_restarts(rocks, tmp_path):
    stream = rocks.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    first = [("a", 0, "e0", "t", "x"), ("a", 1, "e1", "t", "y"), ("b", 1, "f1", "t", "x"), ("a", 1, "e1", "t", "y")]
    second = [("a", 1, "e1", "t", "y"), ("a", 0, "e0", "t", "other"), ("a", 2, "e2", "t", "z"), ("b", 0, "f0", "t", "x"), ("b", 1, "f1", "t", "x"), ("a", 4, "e4", "t", "z")]
    verdicts = []
    for rows in (first, second):
        put(rocks, rows, tmp_path / "in")
        run(log.judged(stream), tmp_path / "out", tmp_path / "cp")
        verdicts.append(sorted((r.id, r.verdict) for r in rocks.read.parquet(f"{tmp_path}/out").collect()))
    assert verdicts[0] == [("e0", "append"), ("e1", "append"), ("e1", "replay"), ("f1", "gap")]
    rest = list(verdicts[1])
    for v in verdicts[0]:
        rest.remove(v)
    assert rest == [("e0", "divergent"), ("e1", "replay"), ("e2", "append"), ("e4", "gap"), ("f0", "append"), ("f1", "append")]


def test_another_owners_events_are_foreign_over_restarts(rocks, tmp_path):
    schema = SCHEMA + ", owner_id string"
    stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
    parts = [[("a", 0, "e0", "t", "x", None), ("b", 0, "f0", "t", "x", "me")], [("a", 1, "e1", "t", "x", "you"), ("b", 1, "f1", "t", "x", "you"), ("b", 0, "f0", "t", "x", None)], [("b", 1, "f1", "t", "x", "me"), ("a", 2, "e2", "t", "x", "me"), ("a", 0, "e0", "t", "x", "you")]]
    seen = []
    for rows in parts:
        put(rocks, rows, tmp_path / "in", schema)
        run(log.judged(stream), tmp_path / "out", tmp_path / "cp")
        now = sorted((r.id, r.verdict) for r in rocks.read.parquet(f"{tmp_path}/out").collect())
        new = list(now)
        for v in seen:
            new.remove(v)
        parts[parts.index(rows)], seen = new, now
    assert parts == [[("e0", "append"), ("f0", "append")], [("e1", "append"), ("f0", "foreign"), ("f1", "foreign")], [("e0", "replay"), ("e2", "foreign"), ("f1", "append")]]


def test_projection_equals_batch_over_restarts_and_replays(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    fields = {"name": F.when(F.col("type") == "named", F.col("data")), "size": F.when(F.col("type") == "sized", F.col("data"))}
    parts = [
        [("a", 0, "e0", "named", "x"), ("b", 0, "f0", "sized", "1")],
        [("a", 1, "e1", "sized", "5"), ("b", 1, "f1", "gone", ""), ("c", 0, "g0", "other", "")],
        [("a", 0, "e0", "named", "x"), ("b", 0, "f0", "sized", "1")],
        [("a", 2, "e2", "named", "y")],
    ]
    for i in range(0, 4, 2):
        for rows in parts[i : i + 2]:
            put(spark, rows, tmp_path / "in")
        log.project(stream, f"{tmp_path}/table", "aggregate_id", fields, f"{tmp_path}/cp", buckets=2, every=None).awaitTermination(120)
    # The same events under a new checkpoint change nothing.
    log.project(stream, f"{tmp_path}/table", "aggregate_id", fields, f"{tmp_path}/cp2", buckets=2, every=None).awaitTermination(120)
    got = log.projection(spark, f"{tmp_path}/table", "aggregate_id", ["gone"])
    want = eventlog.project(spark.read.parquet(f"{tmp_path}/in"), "aggregate_id", ["gone"], fields)
    key = lambda df: sorted(map(str, df.select("aggregate_id", "seq", "name", "size").collect()))
    assert key(got) == key(want) and got.count() == 2


def test_changes_equal_batch(rocks, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(hours=i), on) for k, states in (("a", "0110010"), ("b", "1100")) for i, on in enumerate(x == "1" for x in states)]
    schema = "k string, window_start timestamp, triggered boolean"
    stream = rocks.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for part in ([r for r in rows if r[1].hour < 2], [r for r in rows if r[1].hour >= 2]):
        put(rocks, part, tmp_path / "in", schema)
        run(counters.changes(stream, F.col("k"), "window_start"), tmp_path / "out", tmp_path / "cp")
    got = rocks.read.parquet(f"{tmp_path}/out")
    want = counters.on_change(rocks.createDataFrame(rows, schema), ["k"], "window_start")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_refresh(spark, tmp_path):
    events = [(datetime.datetime(2024, 3, d), v) for d, v in ((4, 1), (5, 2), (11, 4))]
    seen = []

    def compute(start, end):
        seen.append((start, end))
        rows = spark.createDataFrame(events, "t timestamp, n long").filter((F.col("t") >= F.lit(start)) & (F.col("t") < F.lit(end)))
        return rows.groupBy(F.lit("day").alias("grain"), F.date_format("t", "yyyy-MM-dd").alias("period_key")).agg(F.sum("n").alias("n"))

    keys, data = ["grain", "period_key"], datetime.datetime(2024, 1, 1, tzinfo=UTC)
    now = datetime.datetime(2024, 3, 12, 5, tzinfo=UTC)
    for last in (None, now - datetime.timedelta(hours=1)):
        ingest.refresh(f"{tmp_path}/t", now, last, data, compute, keys)
        events.append((datetime.datetime(2024, 3, 11, 1), 10))  # late
        events.append((datetime.datetime(2024, 3, 4, 1), 100))  # in a week that is closed
    assert [s.day for s, _ in seen] == [16, 11]
    assert sorted((str(r.period_key), r.n) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("2024-03-04", 1), ("2024-03-05", 2), ("2024-03-11", 14)]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "event_date string, n int")
    for name in ("q-0", "q-1", "q-1"):
        sinks.append_once(rows, f"{tmp_path}/t", name)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_update_from_takes_one_source_row(spark):
    target = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    source = spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string")
    assert sorted(map(tuple, joins.update_from(target, source, ["k"], ["v"]).collect())) == [(1, "a"), (2, "y")]
