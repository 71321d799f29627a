import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.functions import text
from rivulet.operators import analytics, catalog, findings, graph


def test_levels_and_risk(spark):
    rows = [("1", "security_pattern", "critical"), ("2", "complexity_issue", "medium"), ("3", "complexity_issue", "low"), ("4", "dead_code", "medium"), ("5", "circular_dependency", "high"), ("6", "other", "critical"), ("7", "dead_code", "info"), ("8", "dead_code", "info")]
    frame = spark.createDataFrame(rows, "id string, type string, severity string")
    calm = spark.createDataFrame([("a", ["high_coupling"])], "path string, reasons array<string>")
    got = {r.category: r for r in findings.category_levels(frame, calm).collect()}
    assert {k: r.level for k, r in got.items()} == {"security": "critical", "architecture": "high", "reliability": "low", "maintainability": "low", "performance": "none"}
    assert got["maintainability"].top_ids == ["2", "4", "3"] and got["maintainability"].findings == 5
    god = spark.createDataFrame([("a", ["god_object"])], "path string, reasons array<string>")
    raised = findings.category_levels(frame, god)
    assert {r.category: r.level for r in raised.collect()}["architecture"] == "critical"
    assert findings.overall_risk(raised).first()[0] == pytest.approx(0.35 + 0.25 + 0.05 + 0.075, abs=0.006)


def test_chains_relevance_triggers(spark):
    pairs = spark.createDataFrame([("r", "b", 2, 1.0), ("r", "a", 1, 0.9), ("r", "c", 2, 0.7)], "root_id string, related_id string, path_length int, confidence double")
    heads, steps = findings.chains(pairs)
    assert [(r.finding_id, r.step) for r in steps.orderBy("step").collect()] == [("a", 1), ("b", 2), ("c", 3)] and heads.first().confidence == 0.8667
    spots = spark.createDataFrame([("x.py", 0.9, ["god_object"], "critical"), ("Y.py", 0.4, ["high_coupling"], "high"), ("z.py", 0.1, [], "low")], "path string, score double, reasons array<string>, risk_level string")
    assert [(r.path, round(r.relevance, 3)) for r in findings.relevance(spots, ["y.PY"], "refactor").collect()] == [("Y.py", 0.7), ("x.py", 0.65), ("z.py", 0.05)]
    entry = spark.createDataFrame([("main.py",)], "file string")
    cyc = spark.createDataFrame([("c.py", "circular_dependency"), ("d.py", "dead_code")], "file string, type string")
    assert sorted(r.file for r in findings.triggers(spots, entry, cyc).collect()) == ["Y.py", "c.py", "main.py", "x.py"]
    impacts = spark.createDataFrame([("t", "r1", 1, False), ("t", "r2", 2, False), ("i", "r1", 3, True), ("r2", "q", 1, False)], "trigger string, file string, depth int, is_interface boolean")
    routes = spark.createDataFrame([("r1",), ("r2",)], "file string")
    handlers = spark.createDataFrame([("r1", "get")], "file string, name string")
    assert sorted(tuple(r) for r in findings.api_impacts(impacts, routes, handlers).collect()) == [("i", "r1::get", "breaking"), ("r2", "r2", "breaking"), ("t", "r1::get", "non_breaking"), ("t", "r2", "unknown")]


def test_module_coverage(spark):
    files = spark.createDataFrame([("m", f"m{i}") for i in range(4)] + [("n", "n0"), ("n", "n1")], "module string, file string")
    hit = lambda *f: {r.module: r.impact_level for r in graph.coverage(spark.createDataFrame([(x,) for x in f], "file string"), files, "module").collect()}
    assert hit("m0", "n0", "n1") == {"m": "minimal", "n": "full"} and hit("m0", "m1", "n0") == {"m": "partial", "n": "partial"}


def test_models(spark):
    at = datetime.date
    rows = [("1", "a-latest", "A", "f", at(2024, 1, 1)), ("2", "a-1", "A1", "f", at(2024, 1, 1)), ("3", "b-latest", "B", "g", at(2024, 2, 1)), ("4", "c-preview", "C", "h", at(2024, 1, 1)), ("5", "dd", "D", "g", at(2024, 1, 1))]
    frame = spark.createDataFrame(rows, "id string, slug string, name string, family string, release_date date").withColumn("last_updated", F.lit(None).cast("date"))
    assert sorted(r.id for r in catalog.without_aliases(frame).collect()) == ["2", "3", "4", "5"]
    assert [r.id for r in frame.orderBy(*catalog.family_order(["g"])).collect()] == ["3", "5", "2", "1", "4"]
    texts = spark.createDataFrame([(["text"], ["text"], "x-pro"), (["text"], ["text"], "x-vision-pro"), (["image"], ["text"], "y"), (None, ["text"], "z")], "i array<string>, o array<string>, s string")
    assert [r.v for r in texts.select(catalog.is_text_model(F.col("i"), F.col("o"), F.col("s")).alias("v")).collect()] == [True, False, False, False]


def test_names_and_samples(spark):
    row = spark.range(1).select(text.hash31(F.lit("abc")).alias("h"), text.hue(F.lit("abc")).alias("u")).first()
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    n, want = 96354, ""
    while n:
        n, want = n // 36, digits[n % 36] + want
    assert row.h == want and 0 <= row.u < 360
    rows = spark.createDataFrame([("a", 5), ("a", 9), ("b", 7), ("c", 1), (None, 99), ("d", 7)], "id string, updated int")
    assert [(r.id, r.updated) for r in analytics.recent(rows, "id", "updated", 2, 1).collect()] == [("b", 7), ("d", 7)]
    assert analytics.sample(rows, 3, 1).count() == 3
