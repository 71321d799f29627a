"""Operators on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from rivulet.operators import analytics, catalog, eventlog, graph, joins, paging, rollup, search, sessions, usage
from rivulet.sources import lake

RULES = rollup.Rules(retired_models=("old-alias",), retired_providers=("house",), free_models=("tiny",))


@pytest.mark.parametrize(
    ("model", "provider_model", "provider", "want_model", "want_provider"),
    [
        ("deepseek-v4-flash-free", "", "not-public", "deepseek-v4-flash", "deepseek"),
        ("mimo-v2.5-free:global", "", "", "mimo-v2.5", "xiaomi"),
        ("old-alias", "claude-sonnet-4-5", "house", "claude-sonnet-4-5", "anthropic"),
        ("old-alias", "gpt-5-free", "house", "gpt-5", "openai"),
        ("old-alias", "", "house", "unknown", "unknown"),
        ("unknown", "", "custom-provider", "unknown", "custom-provider"),
        ("alpha-gpt-next", "", "openai", "alpha-gpt-next", None),
        ("OLD-ALIAS-free", "Kimi-K2", None, "Kimi-K2", "moonshot"),
    ],
)
def test_normalisation(spark, model, provider_model, provider, want_model, want_provider):
    row = spark.createDataFrame([(model, provider_model, provider)], "m string, pm string, p string").select(RULES.model(F.col("m"), F.col("pm")).alias("m"), RULES.provider(F.col("m"), F.col("pm"), F.col("p")).alias("p")).first()
    assert (row.m, row.p) == (want_model, want_provider)


def event(**fields):
    base = {"event_timestamp": "2027-01-01T00:00:00Z", "event_date": "2027-01-01", "event_type": "completions", "model": "gpt-5", "source": "lite", "session": "s1", "user_id": "u1", "status": "200", "cf_country": "de", "duration": "10", "tokens_input": "5", "tokens_output": "20", "timestamp_first_byte": "1000", "timestamp_last_byte": "1100"}
    return base | fields


def test_lake_rollup(spark):
    raw = [
        event(), event(session="s2", user_id="", workspace="w", status="400", cf_country=None), event(model=""), event(source="web"), event(event_type="other"), event(event_timestamp="2027-01-02T00:00:00Z", event_date="2027-01-02"),
        event(timestamp_last_byte="1099", tokens_cache_read="7", tokens_reasoning="100", cost_total="3", cost_total_microcents=None), event(model="alpha-gpt-next"), event(status="199", cf_country="d", cost_total_microcents="9", cost_total="3"),
    ]
    rows = spark.createDataFrame([(r,) for r in raw], "m map<string,string>")
    rows = lake.typed_fields(rows, "m")
    norm = rollup.normalized(rows, "2027-01-01T00:00:00Z", "2027-01-02T00:00:00Z", RULES)
    assert norm.count() == 4
    tps = sorted((r.output_tps is None, r.output_tps) for r in norm.collect())
    assert tps[0] == (False, 200.0) and tps[-1] == (True, None)
    out = {(r.grain, r.dimension, r.country): r for r in rollup.grouped(norm, "all", exact=True).collect()}
    week = out["week", "provider", None]
    assert week.period_key == "2026-W53" and week.requests == 4 and week.sessions == 2 and week.unique_users == 2 and week.tier == "Go" and week.provider == "openai"
    assert week.success_count == 2 and week.error_count == 1 and week.total_tokens == 4 * 25 + 7 and week.reasoning_tokens == 100
    assert week.total_cost_microcents == 3_000_000 + 9
    assert out["day", "geo", "ZZ"].requests == 1 and out["day", "geo", "DE"].requests == 2 and out["day", "geo", "D"].requests == 1
    assert {k[1] for k in out} == {"provider", "model", "geo", "geo_model"}


def test_merge_rules(spark):
    rows = spark.createDataFrame([("d", "Go", 10, 2, 1.0, 5.0), ("d", "Free", 30, 3, 2.0, 6.0), ("e", "Go", 1, 1, None, 9.0)], "k string, tier string, requests long, sessions long, avg_ms double, p50_ms double")
    how = {"added": ("requests", "sessions"), "averaged": ("avg_ms",), "percentiles": ("p50_ms",)}
    got = {(r.k, r.tier): r for r in rollup.with_all_tier(rows, ["k", "tier"], **how).collect()}
    assert len(got) == 5 and got["d", "all"].requests == 40 and got["d", "all"].sessions == 5 and got["d", "all"].avg_ms == 1.75 and got["d", "all"].p50_ms is None
    assert got["e", "all"].p50_ms == 9.0 and got["e", "all"].avg_ms is None
    assert rollup.merged(rows, ["k"], **how).agg(F.sum("requests")).first()[0] == 41


def test_ranks_and_shares(spark):
    rows = spark.createDataFrame([("p", "a", 5), ("p", "b", 5), ("p", "c", 10), ("q", "a", 0)], "period string, name string, n long")
    got = {(r.period, r.name): r for r in rollup.ranked(rows, ["period"], {"n": "n"}, ["name"]).collect()}
    assert [got["p", x].rank_by_n for x in "abc"] == [2, 3, 1] and got["p", "c"].n_share == 0.5 and got["q", "a"].n_share is None
    assert sum(got["p", x].n_share for x in "abc") == 1


def test_percentiles_gaps_and_cut(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "v int").withColumn("g", F.lit(1))
    got = sorted((r.v, r.p) for r in rows.withColumn("p", analytics.midrank_percentile("v", ["g"])).collect() if r.v)
    assert got == [(1, 0.0), (2, 50.0), (2, 50.0), (4, 100.0)]
    log = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("b", 1)], "k string, seq long")
    assert sorted((r.k, r.seq, r.expected) for r in analytics.gaps(log, "k", "seq").collect()) == [("a", 3, 2), ("b", 1, 0)]
    texts = spark.createDataFrame([("s", 1, "a" * 40), ("s", 2, "b" * 40), ("s", 3, "c" * 8)], "k string, seq int, t string")
    got = {r.seq: (r.kept, r.is_cut) for r in analytics.newest_within(texts, "k", "seq", "t", (F.char_length("t") / 4).cast("int"), 7).collect()}
    assert got == {3: ("c" * 8, False), 2: ("b" * 20, True)}


def test_joins(spark):
    look = spark.createDataFrame([("k2", "two"), ("own", "self")], "k string, v string")
    left = spark.createDataFrame([(1, "k1", "k2"), (2, "own", "k2"), (3, None, None)], "id int, a string, b string")
    found = joins.fallback(left, look, [F.col("a"), F.col("b")], "k", "v", F.lit("none"), "found")
    assert {r.id: r.found for r in found.collect()} == {1: "two", 2: "self", 3: "none"}
    facts = spark.sql("select date'2024-01-01' d, 'x' m, 1L n union all select date'2024-01-03', 'y', 2L")
    assert sorted((str(r.d), r.m, r.n) for r in joins.calendar_fill(facts, "d", ["m"], ["n"]).collect())[:3] == [("2024-01-01", "x", 1), ("2024-01-01", "y", 0), ("2024-01-02", "x", 0)]
    rows = spark.createDataFrame([(1, None, True), (2, None, False), (3, 1, False), (4, 2, False), (5, 2, True)], "id int, parent int, flag boolean")
    assert sorted(r.id for r in joins.retained(rows, "id", "parent", F.col("id") == 1, F.col("flag")).collect()) == [1, 3, 5]
    points = spark.createDataFrame([(i, v) for i, v in enumerate((0, 19, 20, 41, 61, 61))], "id int, v int").withColumn("g", F.lit(0))
    assert sorted((r.a_id, r.b_id) for r in joins.band(points, ["g"], "v", 20, "id").collect()) == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]


def test_pages(spark):
    rows = spark.createDataFrame([(t, i) for i, t in enumerate((5, 3, 5, 1, 4))], "t int, id int")
    keys = [("t", True), ("id", True)]
    first = paging.page(rows, keys, 2).collect()
    assert [(r.t, r.id, r.has_more) for r in first] == [(5, 2, True), (5, 0, True)]
    second = paging.page(rows, keys, 3, [5, 0]).collect()
    assert [(r.t, r.id) for r in second] == [(4, 4), (3, 1), (1, 3)] and not second[0].has_more
    back = paging.page(rows, keys, 2, [3, 1], back=True).collect()
    assert [(r.t, r.id) for r in back] == [(5, 0), (4, 4)] and back[0].has_more
    cursor = paging.encode_cursor(t=5, id=0)
    assert paging.decode_cursor(cursor) == {"t": 5, "id": 0} and paging.decode_cursor(rows.filter("id = 0").select(paging.cursor_column("t", "id")).first()[0]) == {"t": 5, "id": 0}
    with pytest.raises(ValueError):
        paging.decode_cursor("!!!")


def test_usage_status(spark):
    def status(f):
        return tuple(spark.range(1).select(f.alias("s")).first().s)

    now = F.lit("2024-03-13 12:00:00").cast("timestamp")
    at = lambda x: F.lit(x).cast("timestamp")
    usd = lambda x: F.lit(x * 100_000_000)
    assert status(usage.rolling_status(usd(5), at("2024-03-13 11:00:00"), F.lit(10), 5, now)) == ("ok", 4 * 3600, 50)
    assert status(usage.rolling_status(usd(10), at("2024-03-13 11:00:00"), F.lit(10), 5, now)) == ("rate-limited", 4 * 3600, 100)
    assert status(usage.rolling_status(usd(99), at("2024-03-13 06:59:59"), F.lit(10), 5, now)) == ("ok", 5 * 3600, 0)
    assert status(usage.weekly_status(usd(3), at("2024-03-11 00:00:00"), F.lit(9), now)) == ("ok", 4 * 86400 + 12 * 3600, 33)
    assert status(usage.weekly_status(usd(30), at("2024-03-10 23:59:59"), F.lit(9), now))[2] == 0
    assert status(usage.monthly_status(usd(9), at("2024-03-01"), at("2024-01-31 00:00:00"), F.lit(9), now)) == ("rate-limited", (18 - 1) * 86400 + 12 * 3600, 100)


def test_event_log(spark):
    schema = "id string, aggregate_id string, seq long, type string, data string"
    log = spark.createDataFrame([("e0", "a", 0, "made", "1"), ("e1", "a", 1, "set", "2"), ("f0", "b", 0, "made", "1")], schema)
    batch = [("e1", "a", 1, "set", "2"), ("e2", "a", 2, "set", "3"), ("e3", "a", 3, "gone", ""), ("f0", "b", 0, "made", "x"), ("f9", "b", 2, "set", "4"), ("g0", "c", 0, "made", "5")]
    got = {r.id: r.verdict for r in eventlog.incoming(log, spark.createDataFrame(batch, schema)).collect()}
    assert got == {"e1": "replay", "e2": "append", "e3": "append", "f0": "divergent", "f9": "gap", "g0": "append"}
    good = eventlog.append(log, spark.createDataFrame(batch[:3] + batch[5:], schema))
    assert good.count() == 6
    with pytest.raises(Exception, match="refused event f0"):
        eventlog.append(log, spark.createDataFrame(batch, schema)).collect()
    owners = spark.createDataFrame([("a", "me"), ("c", "you")], "aggregate_id string, owner_id string")
    mine = spark.createDataFrame([(*r, "me") for r in batch], schema + ", owner_id string")
    assert {r.id: r.verdict for r in eventlog.incoming(log, mine, owners).collect()}["g0"] == "foreign"
    rows = eventlog.project(good, "aggregate_id", ["gone"], {"value": F.when(F.col("type").isin("made", "set"), F.col("data"))})
    assert {r.aggregate_id: (r.seq, r.value) for r in rows.collect()} == {"b": (0, "1"), "c": (0, "5")}
    page = eventlog.read_after(good, "a", 0, 2).collect()
    assert [r.seq for r in page] == [1, 2] and page[0].has_more and not eventlog.read_after(good, "a", 1, 2).first().has_more


def test_sessions(spark):
    messages = spark.createDataFrame([("m1", "s1", '{"role":"assistant","cost":0.5,"providerID":"p","modelID":"m","tokens":{"input":10,"output":5,"cache":{"read":3}}}'), ("m2", "s1", '{"role":"user"}'), ("m3", "s2", '{"role":"assistant","tokens":{"input":2}}')], "id string, session_id string, data string")
    facts = sessions.message_facts(messages)
    t = sessions.totals(facts).first()
    assert (t.sessions, t.messages, t.tokens, t.mean_tokens, t.median_tokens, t.cost) == (2, 3, 20, 10, 10, 0.5)
    parts = spark.createDataFrame([('{"type":"tool","tool":"bash"}',), ('{"type":"text"}',), ('{"type":"tool","tool":"bash"}',)], "data string")
    assert [tuple(r) for r in sessions.tool_counts(parts).collect()] == [("bash", 2)]
    rows = spark.createDataFrame([("s", 0, "user", 2), ("s", 1, "compaction", 2), ("s", 2, "system", 2), ("s", 3, "user", 2), ("s", 4, "system", 2)], "session_id string, seq int, type string, baseline int")
    assert sorted(r.seq for r in sessions.context_slice(rows, "baseline").collect()) == [1, 3, 4]
    items = spark.createDataFrame([("part", '{"id":"p","v":1}', 1), ("part", '{"id":"p","v":2}', 2), ("model", '["x"]', 1)], "type string, data string, batch int")
    assert sorted(r.data for r in sessions.share_state(items).collect()) == ['["x"]', '{"id":"p","v":2}']
    deltas = spark.createDataFrame([("s", "m", 1, 10), ("s", "m", 2, 4), ("s", "n", 3, 5)], "session_id string, message_id string, seq int, tokens long")
    assert sessions.usage_delta(deltas).first().tokens == 9


def test_graph(spark):
    chain = [(f"n{i}", f"n{i + 1}", "import") for i in range(7)] + [("n1", "x", "call"), ("x", "n2", "call"), ("loop", "loop", "call"), ("a", "b", "call"), ("b", "a", "call")]
    edges = spark.createDataFrame(chain, "`from` string, to string, kind string")
    names = sorted({x for e in chain for x in e[:2]} | {"alone"})
    nodes = spark.createDataFrame([(n, "function", f"f_{n}", n == "n0") for n in names], "id string, kind string, file string, is_entry_point boolean").withColumn("is_exported", F.lit(False))
    hit = {r.file: (r.depth, r.confidence) for r in graph.impact(nodes, edges, spark.createDataFrame([("f_n7",)], "file string")).collect()}
    assert hit == {"f_n6": (1, 1.0), "f_n5": (2, 0.9), "f_n4": (3, 0.75), "f_n3": (4, 0.6), "f_n2": (5, 0.45)}
    paths = {r.node: r.path for r in graph.shortest_paths(graph.adjacency(edges), spark.createDataFrame([("n0",)], "origin string"), 9).collect()}
    assert paths["n2"] == ["n0", "n1", "n2"] and len(paths["n7"]) == 8
    assert {(r.node, r.depth) for r in graph.on_cycles(graph.adjacency(edges), 4).collect()} == {("loop", 1), ("a", 2), ("b", 2)}
    fan = {r.file: (r.fan_in, r.fan_out) for r in graph.fan(nodes, edges).collect()}
    assert fan["f_n1"] == (1, 2) and "f_loop" not in fan
    assert {r.id for r in graph.dead_code(nodes, edges).collect()} == {"alone"}
    extra = edges.unionByName(spark.createDataFrame([("a", "missing", "call")], edges.schema))
    assert [r.to for r in graph.dangling(nodes, extra).collect()] == ["missing"]
    small = edges.withColumn("graph", F.lit(1))
    assert sorted(r.cycle for r in graph.cycle_paths(small).collect()) == [["a", "b", "a"], ["loop", "loop"]]
    order = {r.node: (r.position, r.is_cyclic) for r in graph.topological(small).collect()}
    assert order["n0"][0] < order["n1"][0] < order["x"][0] < order["n2"][0] and order["a"][1] and order["loop"][1] and not order["n7"][1]


def test_findings(spark):
    edges = spark.createDataFrame([("a", "b", "call"), ("b", "c", "call")], "`from` string, to string, kind string")
    findings = spark.createDataFrame([("f1", "a", "x", None), ("f2", "c", "y", 1.0)], "id string, node string, type string, hotspot double")
    ok = spark.createDataFrame([("x", "y")], "root_type string, related_type string")
    assert [(r.root_id, r.related_id, r.path_length, r.confidence) for r in graph.root_causes(findings, edges, ok).collect()] == [("f1", "f2", 2, 1.0)]
    rows = spark.createDataFrame([("1", "f", "t", "high", 10), ("2", "f", "t", "low", 25), ("3", "f", "t", "high", 90), ("4", "g", "t", "low", 1), ("5", "h", "t", "high", 1)], "id string, file string, type string, severity string, line_start int")
    steps = spark.createDataFrame([("c1", "4", 4, "high"), ("c1", "5", 1, "low"), ("c2", "5", 2, "low")], "chain_id string, finding_id string, step int, root_severity string")
    got = {r.id: r.noise_reason for r in graph.noise(rows, steps).collect()}
    assert got == {"1": None, "2": "duplicate of 1: line range", "3": "duplicate of 1: severity", "4": "derived at depth 4", "5": "in 2 chains"}
    score = spark.range(1).select(graph.risk_score(F.lit(None).cast("double"), F.lit(25), F.lit(1), F.lit(2), F.lit(0), F.lit(0), F.lit(2)).alias("s")).first().s
    assert score == pytest.approx(0.2 + 0.125 + 0.1 + 0.01)
    coupling = spark.createDataFrame([("big", 6, 0), ("test", 9, 9), ("low", 5, 8)], "file string, fan_in long, fan_out long")
    nodes = spark.createDataFrame([(f, "function") for f in ("big", "test", "low") for _ in range(6)], "file string, kind string")
    assert [r.file for r in graph.god_objects(nodes, coupling, spark.createDataFrame([("test", "test")], "file string, role string")).collect()] == ["big"]


def test_search(spark):
    texts = spark.createDataFrame([(1, "one\ntwo foo\nfoo"), (2, "bar")], "id int, t string")
    assert [(r.id, r.line_no) for r in search.grep(texts, "id", "t", "fo+").collect()] == [(1, 2), (1, 3)]
    paths = spark.createDataFrame([(p,) for p in ("src/a.py", "src/x/b.py", "b.py", "node_modules/c.py", "src/a.ts")], "p string")
    assert sorted(r.p for r in search.glob(paths, "p", ["**/*.py"], ("node_modules",)).collect()) == ["b.py", "src/a.py", "src/x/b.py"]
    assert [r.p for r in search.fuzzy_top(paths, "p", "sapy", 1).collect()] == ["src/a.py"]
    code = spark.createDataFrame([(1, "a\nb = eval(x)\n"), (2, "eval(x) # safe: checked")], "id int, t string")
    got = search.pattern_hits(code, "id", "t", {"eval": (r"eval\(", "safe")}).collect()
    assert [(r.id, r.rule, r.line_no, r.match) for r in got] == [(1, "eval", 2, "eval(")]


def test_catalog(spark):
    doc = '{"models":[{"id":"a","name":"Model A","cost":{"input":1.5,"output":"bad"},"modalities":{"input":["text","image"]},"benchmarks":[{"name":"τ²-Bench","score":50},{"name":"tau2 bench","score":70}]},{"id":"b","name":"B","benchmarks":[{"name":"Tau2-bench","score":10}]}]}'
    models = catalog.models(spark.createDataFrame([(doc,)], "document string"))
    a = models.filter("id = 'a'").first()
    assert (a.slug, a.cost_input, a.cost_output, a.inputs) == ("model-a", 1.5, None, ["text", "image"])
    assert sorted((r.id, r.benchmark, r.score, r.percentile) for r in catalog.best_scores(models).collect()) == [("a", "tau2 bench", 70.0, 100.0), ("b", "tau2 bench", 10.0, 0.0)]
    sub = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), '{"tasks":[{"id":"t1","score":0.5},{"id":"t2","score":1}]}')], "id int, time_created timestamp, d string")
    assert catalog.pivoted(sub, "d", ["t1", "t2"]).select("t1", "t2").first() == (0.5, 1.0)
