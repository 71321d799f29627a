"""Readers and writers on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from rivulet.sources import files, lake, sinks


def test_wire_events_and_routes(spark):
    body = json.dumps({"events": [{"_datalake_key": "inference.event", "model": "m", "status": "200", "duration": 1.5, "is_stream": "true", "tokens_input": "x", "ip": "2001:db8::1"}, {"_datalake_key": "nowhere.x", "model": 5}]})
    rows = lake.wire_events(spark.createDataFrame([(body,)], "value string"))
    a, b = sorted(rows.collect(), key=lambda r: r.lake_key)
    assert (a.model, a.status, a.duration, a.is_stream, a.tokens_input, a.ip_prefix) == ("m", 200, 1.5, True, None, "2001:db8:0:0::/64") and b.model == "5"
    good, bad = lake.quarantined(rows, ["inference.event"])
    assert [(r.database, r.table) for r in good.collect()] == [("inference", "event")] and bad.count() == 1
    with pytest.raises(Exception, match="no route"):
        lake.routed(rows, ["inference.event"]).collect()


def test_metric_lines_and_scope(spark):
    lines = spark.createDataFrame([('_metric:{"a":"1"}',), ("other",), ('x _metric:{"a":"2"}',)], "value string")
    assert [r.fields for r in lake.metric_lines(lines).collect()] == [{"a": "1"}]
    paths = spark.createDataFrame([("/v1/a",), ("/v1",), ("/v1x",), ("/m",), ("/m/x",)], "p string")
    assert sorted(r.p for r in lake.scoped(paths, "p", {"/v1": True, "/m": False}).collect()) == ["/m", "/v1", "/v1/a"]


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"path":"a","n":1}\nnot json\n{"path":"b","n":2}\n')
    assert sorted(r.path for r in files.json_lines(spark, str(tmp_path / "log.jsonl"), "path string, n int").collect()) == ["a", "b"]
    (tmp_path / "o" / "x").mkdir(parents=True)
    for k in ("x/1", "x/2", "y"):
        (tmp_path / "o" / k).write_text(k)
    assert [(r.key, r.content) for r in files.objects(spark, str(tmp_path / "o"), "x/", after="x/1").collect()] == [("x/2", "x/2")]
    (tmp_path / "t.md").write_text("# head\n\n| Date | N |\n| --- | ---: |\n| 2024-01-01 | 5 |\n| 2024-01-02 | 7 |\n")
    rows = files.markdown_table(spark, str(tmp_path / "t.md"), ["date", "n"])
    assert rows.agg(F.max_by("n", "line_no")).first()[0] == "7" and rows.count() == 2
    pages = spark.createDataFrame([('<script id="data" type="x">{"name":"n"}</script>',), ("<p>",)], "html string")
    assert [r.data and r.data.name for r in files.script_json(pages, "html", "data", "name string").collect()] == ["n", None]
    assert {r.line for r in files.text_lines(spark, str(tmp_path), "*.md").collect()} >= {"# head"}
    assert files.json_document(spark, str(tmp_path / "log.jsonl")).count() >= 1
    assert files.with_default(pages, "n", 0).columns == ["html", "n"]


def test_upsert_touches_only_its_periods(spark, tmp_path):
    path = f"file://{tmp_path}/stat"
    schema = "model string, n long, grain string, period_key string"
    sinks.upsert(spark.createDataFrame([("a", 1, "day", "1"), ("b", 2, "day", "1"), ("a", 3, "day", "2")], schema), path, ["grain", "period_key", "model"])
    before = {p.name for p in (tmp_path / "stat").rglob("*.parquet") if "period_key=2" in str(p)}
    sinks.upsert(spark.createDataFrame([("a", 10, "day", "1"), ("c", 5, "day", "1")], schema), path, ["grain", "period_key", "model"])
    rows = spark.read.schema(schema).parquet(path)
    assert sorted((r.model, r.n, r.period_key) for r in rows.collect()) == [("a", 3, "2"), ("a", 10, "1"), ("b", 2, "1"), ("c", 5, "1")]
    assert {p.name for p in (tmp_path / "stat").rglob("*.parquet") if "period_key=2" in str(p)} == before
    gone = sinks.retired(rows, {"model": ["A"]}, F.col("period_key") == "1")
    assert sorted((r.model, r.period_key) for r in gone.collect()) == [("a", "2"), ("b", "1"), ("c", "1")]


def test_other_writes(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1)], "k string, n long"), spark.createDataFrame([("a", 5), ("b", 6), ("b", 6)], "k string, n long")
    assert [tuple(r) for r in sinks.insert_ignore(old, new, ["k"]).collect()] == [("b", 6)]
    assert sorted(tuple(r) for r in sinks.added(old, new, ["k"], ["n"]).collect()) == [("a", 6), ("b", 12)]
    assert sorted(tuple(r) for r in sinks.merged(old, new, ["k"]).collect()) == [("a", 5), ("b", 6)]
    tricky = spark.createDataFrame([('say "hi", you', None)], "t string, u string")
    sinks.csv(tricky, f"{tmp_path}/c")
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c").first().t == 'say "hi", you'
    sinks.json(tricky, f"{tmp_path}/j", ("t", "u"))
    assert spark.read.json(f"{tmp_path}/j").first().asDict() == {"t": "[redacted]"}
    sinks.append(spark.createDataFrame([("2024-01-01", 1)], "event_date string, n int"), f"{tmp_path}/lake")
    sinks.append(spark.createDataFrame([("2024-01-02", 2)], "event_date string, n int"), f"{tmp_path}/lake")
    assert spark.read.parquet(f"{tmp_path}/lake").count() == 2
    once = sinks.migrate(old, {"m": ("int", 0)})
    assert sinks.migrate(once, {"m": ("int", 9)}).first().m == 0
