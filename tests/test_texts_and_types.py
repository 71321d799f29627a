"""Edit distances, blocks, near names, JSON members, point lookups and typed functions."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet.functions import blocks, jsons, text, typed
from rivulet.operators import search
from rivulet.sources import lookup


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (c != d))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abcé", max_size=14), st.text("abcé", max_size=90))
def test_distance(a, b):
    assert blocks.distance(a, b) == blocks.distance(b, a) == plain_distance(a, b)


def test_distance_of_long_lines():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    b = list(a)
    for at in rng.sample(range(30_000), 50):
        b[at] = "X"
    assert blocks.distance(a, "".join(b)) == 50


def test_found_block():
    content = "\n".join(["head", "  start", "one line", "other line", "end", "x", "start", "one lime", "other lines", "end "])
    assert blocks.found_block(content, "start\none lime\nother lines\nend") == (6, 9, 1.0)
    assert blocks.found_block(content, "start\none line\nother line\nend\n")[:2] == (1, 4)
    assert blocks.found_block(content, "start\nnothing like\nit at all\nend") is None
    assert blocks.found_block(content, "start\nend") is None and blocks.found_block(content, "gone\none\nend") is None
    assert blocks.found_block("a\n\nb", "a\n\nb") is None  # two empty inner lines count nothing
    assert blocks.found_block("a\nx\nb", "a\nb\n") == (0, 2, 1.0)  # no inner lines
    assert blocks.found_block("a\n1\n2\n3\n4\n5\nb", "a\n1\n2\nb") is None  # too long by more than a quarter


def test_blocks_of_columns(spark):
    rows = spark.createDataFrame([("s\nab\ncd\ne", "s\nab\ncx\ne"), (None, "a\nb\nc"), ("a", None), ("", "")], "a string, b string")
    got = rows.select(blocks.find_block("a", "b").alias("f"), blocks.block_similarity("a", "b").alias("s")).collect()
    assert [(r.f.start_line, r.f.end_line, r.f.similarity) for r in got] == [(0, 3, 0.75), (None,) * 3, (None,) * 3, (None,) * 3]
    assert [r.s for r in got] == [0.875, None, None, 1.0]


def best_score(query, name):
    """All alignments, one after another."""
    name, query = name.lower(), query.lower()
    best = None

    def go(at, last, left, total):
        nonlocal best
        if not left:
            best = total if best is None else max(best, total)
            return
        for k in range(at, len(name)):
            if name[k] == left[0]:
                go(k + 1, k, left[1:], total + 1 + (k == last + 1 and last >= 0) + (k == 0 or not name[k - 1].isalnum()))

    go(0, -1, query, 0)
    return 0.0 if not query else None if best is None else best / (3 * len(query))


def test_fuzzy_scores(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 4))), "".join(rng.choice("abcAB_/é ") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    rows += [("", ""), ("a", "")]
    got = spark.createDataFrame(rows, "q string, t string").select("q", "t", text.fuzzy_score(F.col("q"), F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == (None if best_score(r.q, r.t) is None else pytest.approx(best_score(r.q, r.t))), (r.q, r.t)
    assert spark.range(1).select(text.fuzzy_score(F.lit("a"), F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("most", [1, 2])
def test_near_names(spark, most):
    rng = random.Random(7)
    names = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(120)} | {"abcdefgh", "abXdefgh", "bcdefghi", "abcdefg"}
    frame = spark.createDataFrame([(n,) for n in [*names, None, "ab", "ab"]], "name string")
    got = {(r.a, r.b, r.distance) for r in search.near_names(frame, "name", most).collect()}
    names |= {"ab"}
    assert got == {(a, b, d) for a in names for b in names if a < b and (d := plain_distance(a, b)) <= most}


def test_json_members(spark):
    texts = ['{"a": 1.10, "b": {"z": 1e5, "a": 2}, "c": [1, 2]}', '{"a":1,"b":2,"a":3}', "{}", "[1]", "not", None, '{"a":"x,}\\"y"}', '{"a":1} x', '{"a":1,}']
    own = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    rows = own.select(jsons.json_remove(F.col("t"), "a").alias("r"), jsons.json_set(F.col("t"), "a", F.lit("new")).alias("s"), jsons.json_set(F.col("t"), "d", F.lit(None).cast("string")).alias("n")).collect()
    assert [r.r for r in rows] == ['{"b":{"z": 1e5, "a": 2},"c":[1, 2]}', '{"b":2}', "{}", None, None, None, "{}", None, None]
    assert [r.s for r in rows][:3] == ['{"a":"new","b":{"z": 1e5, "a": 2},"c":[1, 2]}', '{"a":"new","b":2}', '{"a":"new"}']
    assert rows[0].n.endswith(',"d":null}') and rows[2].n == '{"d":null}' and rows[3].n is None
    assert json.loads(rows[6].s) == {"a": "new"}


def files_read(frame):
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numFiles").value()


def test_lookup(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("k"), F.col("id").alias("v"))
    path = str(tmp_path / "t")
    lookup.write(rows, path, "k", buckets=64)
    every = len(list((tmp_path / "t").glob("*/*.parquet")))
    found = lookup.lookup(spark, path, "k", [7, 4999, 123456, None, 7], 64)
    assert sorted((r.k, r.v) for r in found.collect()) == sorted((k, k + 5000 * i) for k in (7, 4999) for i in range(4))
    assert files_read(found) <= 3 * every / 64 + 1 and files_read(spark.read.parquet(path)) == every
    assert found.columns == ["k", "v"]
    assert lookup.lookup(spark, path, "k", [], 64).count() == 0
    with pytest.raises(ValueError, match="join"):
        lookup.lookup(spark, path, "k", list(range(20_000)), 64)


def test_typed_functions(spark):
    def pairs(row):
        for w in (row["text"] or "").split():
            yield {"id": row["id"], "word": w}

    typed.register(spark, "words_of", "id bigint, text string", "id bigint, word string", pairs)
    spark.createDataFrame([(1, "a b", 0), (2, None, 0)], "id long, text string, other int").createOrReplaceTempView("typed_rows")
    assert sorted(map(tuple, spark.sql("SELECT * FROM words_of(TABLE(typed_rows))").collect())) == [(1, "a"), (1, "b")]
    for query, what in (("SELECT id, 1 AS text FROM typed_rows", "text as string, not int"), ("SELECT id FROM typed_rows", "column text of type string")):
        with pytest.raises(Exception, match=what):  # when it is analysed
            spark.sql(f"SELECT * FROM words_of(TABLE({query}))")
    with pytest.raises(Exception, match="takes a table"):
        spark.sql("SELECT * FROM words_of(1)")
    typed.register(spark, "wrong", "id bigint", "id bigint", lambda row: [{"no": 1}])
    with pytest.raises(Exception, match="declared columns"):
        spark.sql("SELECT * FROM wrong(TABLE(SELECT id FROM typed_rows))").collect()


def test_typed_function_with_a_key(spark):
    def start():
        seen = [0]

        def run(row):
            seen[0] += row["n"]
            yield {"k": row["k"], "total": seen[0]}

        return run

    typed.register(spark, "running", "k string, n bigint", "k string, total bigint", lambda row: [], ("k",), start)
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n long").createOrReplaceTempView("keyed_rows")
    rows = spark.sql("SELECT k, max(total) AS m FROM running(TABLE(SELECT * FROM keyed_rows)) GROUP BY k").collect()
    assert sorted(map(tuple, rows)) == [("a", 3), ("b", 5)]


def test_json_schema_types():
    schema = {"type": "object", "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}, "at": {"type": "object", "properties": {"x": {"type": "number"}}}, "any": {}}}
    assert typed.json_schema_columns(schema) == "`id` bigint, `tags` array<string>, `at` struct<`x`: double>, `any` string"
