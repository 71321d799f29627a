"""Queries over the lake path, writers, sessions, catalogues, findings, pages and scalar helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, jsons, numbers, userlib
from ..operators import analytics, catalog, eventlog, findings, graph, joins, paging, rollup, search, sessions
from ..session import scratch
from ..sources import files, lake, sinks
from ..sources.files import table
from ..streaming import counters
from .events import BY_SETS, SET_KEYS

_CENT = "CAST(floor(value * 100 + 0.5) AS BIGINT)"
RULES = rollup.Rules(retired_models=("big-pickle",), retired_providers=("retired",))


def _cents(c):
    return F.floor(c * 100 + 0.5).cast("long")


def _pick(key, *names):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(key, F.lit(len(names))) + 1).cast("int"))


def _pick_sql(key, *names):
    return f"(ARRAY[{', '.join('NULL' if n is None else repr(n) for n in names)}])[{key} % {len(names)} + 1]"


MODELS = ("claude-a-free", "gpt-b", "big-pickle", "alpha-gpt-next", "own-model:global")
BACKENDS = ("claude-x", "", "gemini-y-free")
MAKERS = ("retired", "OpenAI", "acme")


def wire(spark, sf_dir):
    """The events as an ingest service receives them: JSON bodies of ``{"events": [...]}``, numbers as texts in part."""
    u, e = F.col("user_id"), F.col("event_id")
    one = F.to_json(F.struct(
        F.lit("inference.event").alias("_datalake_key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("event_timestamp"), dates.day_key(F.col("ts")).alias("event_date"),
        F.when(F.pmod(e, F.lit(17)) == 0, "other").otherwise("completions").alias("event_type"), _pick(u, *MODELS).alias("model"), _pick(e, *BACKENDS).alias("provider_model"), _pick(u, *MAKERS).alias("provider"),
        _pick(e, "lite", "lite", "web").alias("source"), _pick(u, "us", "", "DE").alias("cf_country"), F.concat(F.lit("s"), F.pmod(e, F.lit(97)).cast("string")).alias("session"),
        u.cast("string").alias("user_id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("duration"), F.floor(F.col("value") * 10).cast("string").alias("time_to_first_byte"),
        F.lit(1000).alias("timestamp_first_byte"), (F.lit(1000) + F.pmod(e, F.lit(300))).alias("timestamp_last_byte"), F.pmod(e, F.lit(50)).alias("tokens_input"), F.pmod(e, F.lit(90)).alias("tokens_output"),
        _cents(F.col("value")).alias("cost_total"),
    ))
    return table(spark, sf_dir, "events").select(F.concat(F.lit('{"events":['), one, F.lit("]}")).alias("value"))


def lake_rollup(spark, sf_dir):
    """Wire events to ranked rollups: route, append to the lake by date, normalise by rules, group by day, collapse to all tiers, rank."""
    path = scratch(spark, "lake")
    sinks.append(lake.routed(lake.wire_events(wire(spark, sf_dir)), ["inference.event"]).drop("lake_key", "database", "table"), path)
    own = rollup.normalized(lake.events(spark, path), "2024-01-03T00:00:00.000Z", "2024-01-20T12:00:00.000Z", RULES, source=None)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    daily = own.groupBy(dates.day_key(F.col("event_time")).alias("period_key"), "tier", "provider", "model").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("session").alias("sessions"), total("tokens_total").alias("total_tokens"), total("cost_total_microcents").alias("cost"),
        F.count("output_tps").alias("timed"), F.count_if(F.col("status") >= 400).alias("errors"), F.max("country").alias("country"),
    )
    out = rollup.with_all_tier(daily.drop("country"), ["period_key", "tier", "provider", "model"], added=("requests", "sessions", "total_tokens", "cost", "timed", "errors"), averaged=(), percentiles=())
    return rollup.ranked(out, ["period_key", "tier"], {"tokens": "total_tokens"}, ["provider", "model"])


_AUTHOR = lambda m: "CASE " + " ".join(f"WHEN strpos({m}, '{k}') > 0 THEN '{v}'" for k, v in rollup.AUTHORS) + " ELSE 'unknown' END"
_STRIP = lambda m: f"coalesce(nullif(regexp_replace(regexp_replace({m}, ':global$', ''), '-free$', ''), ''), 'unknown')"
LAKE = f"""
WITH w AS (SELECT *, {_pick_sql('user_id', *MODELS)} AS m, {_pick_sql('event_id', *BACKENDS)} AS pm, {_pick_sql('user_id', *MAKERS)} AS p, strftime(ts, '%Y-%m-%d') AS day FROM events
 WHERE event_id % 17 <> 0 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20 12:00:00'),
a AS (SELECT *, CASE WHEN m = 'big-pickle' THEN {_STRIP('pm')} ELSE {_STRIP('m')} END AS model,
 CASE WHEN event_id % 3 < 2 THEN 'Go' WHEN regexp_matches(m, '-free(:global)?$') THEN 'Free' ELSE 'Paid' END AS tier FROM w),
b AS (SELECT *, {_AUTHOR('lower(model)')} AS by_model, {_AUTHOR(f"lower({_STRIP('pm')})")} AS by_backend FROM a WHERE model <> 'alpha-gpt-next'),
n AS (SELECT *, coalesce(nullif(by_backend, 'unknown'), nullif(by_model, 'unknown'), CASE WHEN p <> 'retired' THEN p END, by_model) AS provider FROM b),
d AS (SELECT day AS period_key, tier, provider, model, count(*) AS requests, count(DISTINCT event_id % 97) AS sessions, CAST(sum(event_id % 50 + event_id % 90) AS BIGINT) AS total_tokens,
 CAST(sum({_CENT} * 1000000) AS BIGINT) AS cost, count(*) FILTER (event_id % 300 >= 100) AS timed, count(*) FILTER (event_type = 'error') AS errors FROM n GROUP BY ALL),
u AS (SELECT * FROM d UNION ALL SELECT period_key, 'all', provider, model, CAST(sum(requests) AS BIGINT), CAST(sum(sessions) AS BIGINT), CAST(sum(total_tokens) AS BIGINT), CAST(sum(cost) AS BIGINT), CAST(sum(timed) AS BIGINT), CAST(sum(errors) AS BIGINT) FROM d GROUP BY 1, 3, 4)
SELECT *, CAST(row_number() OVER (PARTITION BY period_key, tier ORDER BY total_tokens DESC, provider, model) AS INTEGER) AS rank_by_tokens,
 CASE WHEN sum(total_tokens) OVER (PARTITION BY period_key, tier) > 0 THEN floor(total_tokens / sum(total_tokens) OVER (PARTITION BY period_key, tier) * 1000000 + 0.5) / 1000000 END AS tokens_share FROM u
"""


def lake_stats_rollup(spark, sf_dir):
    """Wire events to the eight-set rollup: route, append to the lake by date, normalise by rules, all grains and dimensions."""
    path = scratch(spark, "lake")
    sinks.append(lake.routed(lake.wire_events(wire(spark, sf_dir)), ["inference.event"]).drop("lake_key", "database", "table"), path)
    own = rollup.normalized(lake.events(spark, path), "2024-01-03T00:00:00.000Z", "2024-01-20T12:00:00.000Z", RULES, source=None)
    out = rollup.grouped(own, "all").drop(*rollup.PERCENTILES)
    return out.withColumns({k: numbers.half_up(F.col(k), 6) for k in rollup.AVERAGED})


LAKE_STATS = f"""
{LAKE[: LAKE.index("d AS (SELECT day")].rstrip().rstrip(",")},
q AS (SELECT *, upper(coalesce(nullif({_pick_sql('user_id', "us", "", "DE")}, ''), 'ZZ')) AS country, strftime(ts, '%G-W%V') AS week_key, day AS day_key, CASE WHEN event_id % 300 >= 100 THEN (event_id % 90) / (event_id % 300) * 1000 END AS tps FROM n)
SELECT {SET_KEYS}, 'all' AS dataset,
 CASE WHEN grouping(model) = 0 AND grouping(country) = 1 THEN coalesce(max(nullif(pm, '')), '') END AS provider_model, CASE WHEN grouping(country) = 0 THEN '' END AS continent,
 count(DISTINCT event_id % 97) AS sessions, count(*) AS requests, count(DISTINCT user_id) AS unique_users,
 CAST(sum(event_id % 50) AS BIGINT) AS input_tokens, CAST(sum(event_id % 90) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, CAST(0 AS BIGINT) AS cache_read_tokens, CAST(sum(event_id % 50 + event_id % 90) AS BIGINT) AS total_tokens,
 CAST(0 AS BIGINT) AS input_cost_microcents, CAST(0 AS BIGINT) AS output_cost_microcents, CAST(sum({_CENT} * 1000000) AS BIGINT) AS total_cost_microcents,
 floor(avg(value) * 1000000 + 0.5) / 1000000 AS avg_duration_ms, floor(avg(floor(value * 10)) * 1000000 + 0.5) / 1000000 AS avg_ttfb_ms, floor(avg(tps) * 1000000 + 0.5) / 1000000 AS avg_output_tps,
 count(*) FILTER (event_type <> 'error') AS success_count, count(*) FILTER (event_type = 'error') AS error_count, count(*) AS sample_count
FROM q {BY_SETS}
"""


def upsert_periods(spark, sf_dir):
    """Daily counts written, then the errors' days again with other values: touched periods are rewritten, keys replaced, others kept."""
    rows = table(spark, sf_dir, "events").groupBy(F.lit("day").alias("grain"), dates.day_key(F.col("ts")).alias("period_key"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "upsert")
    sinks.upsert(rows, path, ["grain", "period_key", "event_type"])
    sinks.upsert(rows.filter("event_type = 'error'").withColumn("n", F.col("n") + 1000), path, ["grain", "period_key", "event_type"])
    return spark.read.schema(rows.schema).parquet(path)


UPSERT = "SELECT grain, period_key, event_type, n + CASE WHEN event_type = 'error' THEN 1000 ELSE 0 END AS n FROM (SELECT 'day' AS grain, strftime(ts, '%Y-%m-%d') AS period_key, event_type, count(*) AS n FROM events GROUP BY ALL)"


def insert_ignored_and_added(spark, sf_dir):
    """Customers of even segments exist; all are inserted unless there, and counters of the existing ones are added to."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(1).cast("long").alias("n"))
    old = rows.filter("c_custkey % 2 = 0").withColumn("n", F.lit(10).cast("long"))
    return sinks.insert_ignore(old, rows, ["c_custkey"]).unionByName(sinks.added(old, rows.filter("c_custkey % 3 = 0"), ["c_custkey"], ["n"]))


IGNORED = "WITH o AS (SELECT c_custkey, 10 AS n FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 2 <> 0 UNION ALL SELECT c_custkey, CAST(sum(n) AS BIGINT) FROM (SELECT * FROM o UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1"


def retired_dimensions(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return sinks.retired(rows, {"s_name": ["supplier#000000001", "SUPPLIER#000000009"]}, F.col("s_nationkey") > 3)


RETIRED = "SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE NOT (s_nationkey > 3 AND coalesce(lower(s_name) IN ('supplier#000000001', 'supplier#000000009'), false))"


def csv_written_and_read(spark, sf_dir):
    """Cells with commas, quotes and line breaks through CSV and back."""
    path = scratch(spark, "csv")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", '), "p_type").alias("label"))
    sinks.csv(rows, path)
    return spark.read.schema("p_partkey long, label string").option("header", True).option("escape", '"').csv(path)


CSV = """SELECT p_partkey, '"' || p_name || '", ' || p_type AS label FROM part"""


def json_written_masked_and_read(spark, sf_dir):
    path = scratch(spark, "json")
    sinks.json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, masked=("c_name",))
    return files.json_lines(spark, path, "c_custkey long, c_name string, c_mktsegment string")


JSON = "SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[redacted]' END AS c_name, c_mktsegment FROM customer"


def malformed_lines_and_objects(spark, sf_dir):
    """JSON lines of which some are broken, listed as objects between two keys and read: broken lines are left out."""
    path = scratch(spark, "lines")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("n_nationkey", "n_name")))
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("key"), line.alias("value"))
    rows.repartition(1).write.partitionBy("key").text(path)
    seen = files.objects(spark, path, "key=k", after="key=k00~", before="key=k03").select(F.split_part("key", F.lit("/"), F.lit(1)).alias("key")).distinct()
    found = spark.read.schema("n_nationkey long, n_name string, key string").option("mode", "DROPMALFORMED").json(path)
    return found.join(seen.select(F.split_part("key", F.lit("="), F.lit(2)).alias("key")), "key").select("key", "n_nationkey", "n_name")


LINES = "SELECT 'k' || lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS key, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey IN (1, 2)"


def markdown_rows(spark, sf_dir):
    path = scratch(spark, "markdown")
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"))
    text_ = table(spark, sf_dir, "nation").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l"))))["l"], "\n").alias("t"))  # 25 rows
    text_.select(F.concat(F.lit("# Nations\n\n| key | name |\n| --- | :-- |\n"), "t").alias("value")).write.text(path)
    return files.markdown_table(spark, path, ["key", "name"]).select("key", "name")


MARKDOWN = "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation"


def database_statements(spark, sf_dir):
    """Statements on a table by the writers: a column added, inserts with each conflict rule, update, update from, delete, a CTE with a scalar subquery."""
    source = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    with_uses = lambda n: source.withColumn("uses", F.lit(n).cast("long"))
    rows = sinks.migrate(source.filter("s_suppkey <= 60"), {"uses": ("long", 0)})
    rows = rows.unionByName(sinks.insert_ignore(rows, with_uses(5), ["s_suppkey"]))
    rows = sinks.merged(rows, with_uses(7).filter("s_suppkey % 10 = 0"), ["s_suppkey"])
    rows = rows.withColumn("uses", F.when(F.col("s_nationkey") < 5, F.col("uses") + 1).otherwise(F.col("uses")))
    busier = table(spark, sf_dir, "nation").selectExpr("n_nationkey as s_nationkey", "1000L + n_regionkey as uses").filter("s_nationkey = 7")
    rows = joins.update_from(rows, busier, ["s_nationkey"], ["uses"]).filter("NOT s_suppkey % 11 = 0")
    path = scratch(spark, "suppliers")
    rows.write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("rivulet_suppliers")
    return spark.sql("WITH busy AS (SELECT * FROM rivulet_suppliers WHERE uses >= 0) SELECT s_suppkey, s_nationkey, uses, (SELECT count(*) FROM rivulet_suppliers) AS total FROM busy")


DATABASE = """
WITH a AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 10 = 0 THEN 7 WHEN s_suppkey <= 60 THEN 0 ELSE 5 END AS uses FROM supplier),
b AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey = 7 THEN 1000 + (SELECT n_regionkey FROM nation WHERE n_nationkey = 7) ELSE uses + CASE WHEN s_nationkey < 5 THEN 1 ELSE 0 END END AS uses FROM a WHERE s_suppkey % 11 <> 0)
SELECT s_suppkey, s_nationkey, CAST(uses AS BIGINT) AS uses, (SELECT count(*) FROM b) AS total FROM b
"""


def json_set_and_removed(spark, sf_dir):
    changed = jsons.json_set(jsons.json_remove(F.col("props"), "k"), "plan", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(changed, "$.plan").alias("plan"), F.get_json_object(changed, "$.k").alias("k"), F.get_json_object(jsons.json_set(F.col("props"), "k", F.lit(5)), "$.k").alias("five"))


JSON_SET = "SELECT event_id, event_type AS plan, CAST(NULL AS VARCHAR) AS k, '5' AS five FROM events"


def like_user_text(spark, sf_dir):
    """Text of a user in a LIKE pattern as it is: its % and _ act as wildcards."""
    return table(spark, sf_dir, "part").filter(F.col("p_name").like("%e_ %")).select("p_partkey", "p_name")


LIKE = "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_ %'"


def not_equal_or_null(spark, sf_dir):
    """Rows whose plan is not one value, absent plans among them; grouped, with HAVING."""
    plan = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    rows = table(spark, sf_dir, "orders").withColumn("plan", plan).filter(F.col("plan").isNull() | (F.col("plan") != "5-LOW"))
    return rows.groupBy("plan", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).filter("n > 5")


NOT_EQUAL = "SELECT plan, o_orderstatus, count(*) AS n FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS plan, o_orderstatus FROM orders) WHERE plan IS NULL OR plan <> '5-LOW' GROUP BY ALL HAVING count(*) > 5"


def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").cube("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


CUBE = "SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(grouping(c_nationkey) * 2 + grouping(c_mktsegment) AS BIGINT) AS level FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)"


def joined_to_a_constant(spark, sf_dir):
    """A join whose condition binds one side to a literal."""
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").join(nation, (F.col("n_nationkey") == 3) & (F.col("s_nationkey") == F.col("n_nationkey")), "left").select("s_suppkey", "n_name")


CONSTANT = "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = 3 AND s_nationkey = n_nationkey"


def nested_totals(spark, sf_dir):
    """Orders with their lines as an array: sums over the array, a lookup by nested id, and types of elements."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("type"), F.col("l_quantity").cast("long").alias("n"))).alias("lines"))  # lines of one order
    doc = lines.select("l_orderkey", F.from_json(F.to_json(F.struct("lines")), "lines array<struct<id:int,type:string,n:bigint>>").alias("d"))
    second = F.array_max(F.transform(F.filter("d.lines", lambda x: x["id"] == 2), lambda x: x["n"]))  # an order may have several of a number
    return doc.select("l_orderkey", F.aggregate("d.lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("total"), second.alias("second"), F.size(F.filter("d.lines", lambda x: x["type"] == "R")).alias("returned"))


NESTED = "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, CAST(max(CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS second, CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS returned FROM lineitem GROUP BY 1"


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("seq"), "role", F.char_length("text").cast("long").alias("chars"), "text")


def session_model_usage(spark, sf_dir):
    m = _messages(spark, sf_dir)
    data = F.to_json(F.struct("role", (F.col("chars") / 4).alias("cost"), _pick(F.col("seq"), "a", "b").alias("modelID"), F.lit("p").alias("providerID"), F.struct(F.col("chars").alias("input"), (F.col("chars") * 2).alias("output")).alias("tokens")))
    return sessions.model_usage(sessions.message_facts(m.withColumn("data", data)))


MODEL_USAGE = f"SELECT 'p/' || {_pick_sql('turn', 'a', 'b')} AS model, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS input, CAST(sum(length(text) * 2) AS BIGINT) AS output, sum(length(text) / 4) AS cost FROM conversations WHERE role = 'assistant' GROUP BY 1"


def session_tools(spark, sf_dir):
    m = _messages(spark, sf_dir)
    data = F.to_json(F.struct(_pick(F.col("seq"), "tool", "text", "tool").alias("type"), _pick(F.col("chars"), "bash", "read", "edit").alias("tool")))
    return sessions.tool_counts(m.select(data.alias("data")))


TOOLS = f"SELECT {_pick_sql('length(text)', 'bash', 'read', 'edit')} AS tool, count(*) AS count FROM conversations WHERE turn % 3 <> 1 GROUP BY 1"


def context_and_pending(spark, sf_dir):
    """What a model sees since the last compaction, late system rows included, and the first pending inbox entries."""
    m = _messages(spark, sf_dir).withColumn("type", F.when(F.col("chars") % 7 == 0, "compaction").when(F.col("chars") % 7 == 1, "system").otherwise("user")).withColumn("base", F.lit(2).cast("long"))
    seen = sessions.context_slice(m, "base").select("session_id", "seq", F.lit("context").alias("part"))
    inbox = m.select("session_id", "seq", F.when(F.col("chars") % 2 == 0, F.col("seq")).alias("promoted_seq"), _pick(F.col("seq"), "prompt", "note").alias("kind"))
    return seen.unionByName(sessions.pending(inbox, F.lit(4), "prompt").select("session_id", "seq", F.lit("pending").alias("part")))


CONTEXT = """
WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, length(text) AS chars, CASE WHEN length(text) % 7 = 0 THEN 'compaction' WHEN length(text) % 7 = 1 THEN 'system' ELSE 'user' END AS type FROM conversations),
s AS (SELECT *, coalesce(max(CASE WHEN type = 'compaction' THEN seq END) OVER (PARTITION BY session_id), -1) AS start FROM m)
SELECT session_id, seq, 'context' AS part FROM s WHERE (type <> 'system' AND seq >= start) OR (type = 'system' AND seq > 2)
UNION ALL SELECT session_id, seq, 'pending' FROM m WHERE chars % 2 <> 0 AND seq % 2 = 0 AND seq <= 4
"""


def shared_state(spark, sf_dir):
    """Items shared in batches: the last version of each by type and id."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.to_json(F.struct(F.pmod("event_id", F.lit(50)).cast("string").alias("id"), "event_id")).alias("data"), F.col("event_id").alias("batch"))
    return sessions.share_state(rows).select("type", "item_id", "batch")


SHARED = "SELECT event_type AS type, CAST(event_id % 50 AS VARCHAR) AS item_id, max(event_id) AS batch FROM events GROUP BY ALL"


def cursor_page(spark, sf_dir):
    """An offset page whose rows carry their cursor, which is decoded again."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = paging.offset_page(rows, [("o_custkey", True), ("o_orderkey", False)], 3, 25).withColumn("cursor", paging.cursor_column("o_custkey", "o_orderkey"))
    plain = F.unbase64(F.translate(F.rpad("cursor", (F.ceil(F.length("cursor") / 4) * 4).cast("int"), F.lit("=")), "-_", "+/")).cast("string")
    return own.select("o_orderkey", "o_custkey", plain.alias("decoded"))


CURSOR = """SELECT o_orderkey, o_custkey, '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}' AS decoded FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25 OFFSET 75"""


def _findings(spark, sf_dir):
    u = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.lpad(u.cast("string"), 8, "0").alias("id"), _pick(u, *findings.CATEGORIES).alias("type"), _pick(F.col("user_id"), "low", "medium", "high", "info", "medium").alias("severity"), F.concat(F.lit("f"), F.pmod("user_id", F.lit(40)).cast("string")).alias("file"),
    )


_FINDINGS = f"f AS (SELECT lpad(CAST(event_id AS VARCHAR), 8, '0') AS id, {_pick_sql('event_id', *findings.CATEGORIES)} AS type, {_pick_sql('user_id', 'low', 'medium', 'high', 'info', 'medium')} AS severity, 'f' || (user_id % 40) AS file FROM events)"


def finding_levels(spark, sf_dir):
    """Levels by category with the three worst findings, and the overall risk beside each."""
    spots = table(spark, sf_dir, "region").select(F.array(F.lit("god_object")).alias("reasons"))
    levels = findings.category_levels(_findings(spark, sf_dir), spots)
    out = levels.join(findings.overall_risk(levels))  # the risk: one row
    return out.select("category", "level", "findings", F.array_join("top_ids", ",").alias("top_ids"), "overall_risk")


_KINDS = " UNION ALL ".join(f"SELECT '{t}' AS type, '{c}' AS category" for t, cs in findings.CATEGORIES.items() for c in cs)
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
LEVELS = f"""
WITH {_FINDINGS}, k AS ({_KINDS}), o AS (SELECT id, severity, category FROM f JOIN k USING (type)),
c AS (SELECT category, count(*) AS findings, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 4 WHEN count(*) FILTER (severity = 'high') > count(*) FILTER (severity = 'medium') THEN 3
 WHEN count(*) FILTER (severity = 'medium') > count(*) FILTER (severity IN ('low', 'info')) THEN 2 ELSE 1 END AS place FROM o GROUP BY 1),
t AS (SELECT category, string_agg(id, ',' ORDER BY no) AS top_ids FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_RANK} DESC, id) AS no FROM o) WHERE no <= 3 GROUP BY 1),
w AS ({' UNION ALL '.join(f"SELECT '{c}' AS category, {x} AS weight" for c, x in findings.WEIGHTS.items())}),
l AS (SELECT category, weight, coalesce(findings, 0) AS findings, coalesce(top_ids, '') AS top_ids, least(4, coalesce(place, 0) + CASE WHEN category IN ('architecture', 'maintainability') THEN 1 ELSE 0 END) AS place FROM w LEFT JOIN c USING (category) LEFT JOIN t USING (category))
SELECT category, (ARRAY['none', 'low', 'medium', 'high', 'critical'])[place + 1] AS level, findings, top_ids, (SELECT floor(sum(place * 0.25 * weight) * 100 + 0.5 + 1e-9) / 100 FROM l) AS overall_risk FROM l
"""


def finding_triggers(spark, sf_dir):
    """Risky files, entry points and files on cycles; then the files' relevance to an objective."""
    spots = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), _pick(F.col("s_suppkey"), "low", "high", "critical", "medium").alias("risk_level"), F.array(_pick(F.col("s_suppkey"), "high_coupling", "god_object")).alias("reasons"), (F.pmod("s_suppkey", F.lit(10)) / 10).alias("score"))
    entry = table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"))
    watched = findings.triggers(spots, entry, _findings(spark, sf_dir)).withColumnRenamed("file", "path")
    return findings.relevance(spots.drop("risk_level"), ["F7", "f8"], "bug_fix").join(watched, "path").select("path", numbers.half_up(F.col("relevance"), 4).alias("relevance"))


TRIGGERS = f"""
WITH {_FINDINGS}, h AS (SELECT s_suppkey AS k, 'f' || s_suppkey AS path FROM supplier),
t AS (SELECT path FROM h WHERE k % 4 IN (1, 2) UNION SELECT 'f' || n_nationkey FROM nation UNION SELECT file FROM f WHERE type = 'circular_dependency')
SELECT path, floor(least(1.0, CASE WHEN path IN ('f7', 'f8') THEN 0.3 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.2 ELSE 0 END + (k % 10) / 10 * 0.5) * 10000 + 0.5) / 10000 AS relevance FROM h JOIN t USING (path)
"""


def catalogue_scores(spark, sf_dir):
    """Catalogue documents read tolerantly; best scores by benchmark with percentiles, features and kinds of the models."""
    p = F.col("p_partkey")
    one = F.to_json(F.struct(F.concat(F.lit("m"), p.cast("string")).alias("id"), F.col("p_name").alias("name"), F.struct(F.when(p % 3 == 0, F.lit("free").cast("string")).otherwise("1").alias("bad")).alias("cost"),
        F.struct(F.array(F.lit("text"), _pick(p, "image", "text")).alias("input"), F.array(F.lit("text")).alias("output")).alias("modalities"),
        F.array(F.struct(F.lit("Tau² Bench").alias("name"), (p % 10).cast("double").alias("score"), F.lit("h").alias("harness")), F.struct(F.lit("τ2--bench").alias("name"), (p % 7).cast("double").alias("score"), F.lit("h").alias("harness"))).alias("benchmarks")))
    models = catalog.models(table(spark, sf_dir, "part").select(F.concat(F.lit('{"models":['), one, F.lit("]}")).alias("document")))
    kinds = models.select("id", catalog.feature_count(F.col("inputs"), F.col("outputs")).alias("features"), catalog.is_text_model(F.col("inputs"), F.col("outputs"), F.col("slug")).alias("is_text"), F.col("cost_input").alias("cost"))
    best = catalog.best_scores(models).withColumn("percentile", numbers.half_up(F.col("percentile"), 6))
    return kinds.join(best, "id")


CATALOGUE = """
WITH m AS (SELECT 'm' || p_partkey AS id, CAST(2 - p_partkey % 2 * 1 AS INTEGER) AS f, p_partkey, greatest(p_partkey % 10, p_partkey % 7) AS score FROM part),
r AS (SELECT *, rank() OVER (ORDER BY score) - 1 AS below, count(*) OVER (PARTITION BY score) AS equal, count(*) OVER () AS n FROM m)
SELECT id, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS features, true AS is_text, CAST(NULL AS DOUBLE) AS cost, 'tau2 bench' AS benchmark, CAST(score AS DOUBLE) AS score, floor((below + (equal - 1) / 2) / (n - 1) * 100 * 1000000 + 0.5) / 1000000 AS percentile FROM r
"""


def submission_pivot(spark, sf_dir):
    """The newest hundred submissions' JSON as a row each with a column for each task's score."""
    o = F.col("o_orderkey")
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("a").alias("id"), (o % 5).cast("double").alias("score")), F.struct(F.lit("b").alias("id"), (o % 3).cast("double").alias("score"))).alias("tasks")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time_created"), doc.alias("document"))
    return catalog.pivoted(rows, "document", ["a", "b"])


PIVOT = "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS time_created, CAST(o_orderkey % 5 AS DOUBLE) AS a, CAST(o_orderkey % 3 AS DOUBLE) AS b FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey LIMIT 100"


def aliases_removed(spark, sf_dir):
    """Models less the aliases of others of their family and date, in the order in which a picker shows them."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), p.cast("string"), _pick(p, "", "-latest", "-preview")).alias("slug"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"), F.lpad((p % 40).cast("string"), 2, "0").alias("release_date"), F.lit(None).cast("string").alias("last_updated"))
    return catalog.without_aliases(rows).orderBy(*catalog.family_order(["brand-11", "brand-23"])).select("slug", "family", "release_date")


ALIASES = f"WITH m AS (SELECT 'm' || p_partkey || {_pick_sql('p_partkey', '', '-latest', '-preview')} AS slug, p_brand AS family, lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') AS release_date FROM part) SELECT * FROM m WHERE NOT slug LIKE '%-latest' OR NOT EXISTS (SELECT 1 FROM m AS o WHERE NOT o.slug LIKE '%-latest' AND o.family = m.family AND o.release_date = m.release_date)"


def globbed_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://[^/]*/", "").alias("path"))
    return search.glob(rows, "path", ["**/*1*", "en/?2*"], ("fr",))


GLOB = "WITH p AS (SELECT page_id, regexp_replace(url, '^https?://[^/]*/', '') AS path FROM pages) SELECT * FROM p WHERE (regexp_matches(path, '^(?:.*/)?[^/]*1[^/]*$') OR regexp_matches(path, '^en/[^/]2[^/]*$')) AND NOT contains('/' || path || '/', '/fr/')"


def pattern_findings(spark, sf_dir):
    """First hits of patterns in documents with their lines, less those that are followed by what makes them safe."""
    hits = search.pattern_hits(table(spark, sf_dir, "documents"), "doc_id", "text", {"mail": ("[a-z0-9.]+@[a-z]+", None), "key": ("(?i)(api|secret)[_-]?key", "example")})
    return hits.select("doc_id", "rule", "line_no", "match", F.size(search.submatches(F.col("match"), "[a-z]", 3)).alias("letters"))


PATTERNS = """
WITH d AS (SELECT doc_id, text, regexp_extract(text, '[a-z0-9.]+@[a-z]+') AS m, regexp_extract(text, '(?i)(api|secret)[_-]?key') AS k FROM documents),
h AS (SELECT doc_id, text, 'mail' AS rule, m AS match FROM d WHERE m <> '' UNION ALL SELECT doc_id, text, 'key', k FROM d WHERE k <> '' AND NOT contains(substr(text, strpos(text, k), 300), 'example'))
SELECT doc_id, rule, CAST(length(substr(text, 1, strpos(text, match) - 1)) - length(replace(substr(text, 1, strpos(text, match) - 1), chr(10), '')) + 1 AS INTEGER) AS line_no, match, CAST(least(3, len(regexp_extract_all(match, '[a-z]'))) AS INTEGER) AS letters FROM h
"""


def boosted_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.char_length("p_name").alias("score"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") / 10).alias("frecency"))
    out = rows.withColumn("boosted", numbers.half_up(search.boosted(F.col("score"), F.col("frecency"), F.col("p_partkey") % 5 == 0), 4))
    return analytics.top_per_group(out.withColumn("g", F.col("p_partkey") % 7), ["g"], 5, F.col("boosted").desc(), "p_partkey").select("p_partkey", "boosted")


BOOSTED = "WITH b AS (SELECT p_partkey, floor(length(p_name) * (1 + CASE WHEN p_partkey % 2 = 0 THEN p_size / 10 ELSE 0 END) * CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END * 10000 + 0.5) / 10000 AS boosted FROM part) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY boosted DESC, p_partkey) <= 5"


def date_helpers(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", dates.minute_key(t).alias("minute"), dates.seconds_to_next_day(t).cast("long").alias("left"), dates.iso_week_start(dates.iso_week_number(t)).cast("string").alias("monday"), F.size(dates.days_of_month(t)).alias("days"), dates.zone_offset(t, "Asia/Tokyo").alias("zone"))


DATES = "SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS minute, CAST(86400 - floor(epoch(ts)) % 86400 AS BIGINT) AS left, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday, CAST(day(last_day(ts)) AS INTEGER) AS days, CAST(540 AS INTEGER) AS zone FROM events"


def money_helpers(spark, sf_dir):
    c = _cents(F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.cents_to_micro(c).alias("micro"), numbers.micro_to_cents(numbers.cents_to_micro(c)).alias("cents"), numbers.processing_fee(c, 0.029, 30).alias("fee"), numbers.compact(F.abs(c)).alias("compact"), numbers.percent_used(c, F.lit(500000)).alias("used"))


MONEY = """
WITH c AS (SELECT c_custkey, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS c FROM customer)
SELECT c_custkey, c * 1000000 AS micro, c AS cents, CAST(floor((c + 30) / (1 - 0.029::DOUBLE) + 0.5) AS BIGINT) - c AS fee, CASE WHEN abs(c) >= 1000000 THEN format('{:.1f}M', abs(c) / 1000000) WHEN abs(c) >= 1000 THEN format('{:.1f}K', abs(c) / 1000) ELSE CAST(abs(c) AS VARCHAR) END AS compact, CAST(floor(least(100.0, c / 500000 * 100)) AS INTEGER) AS used FROM c
"""


def array_edits(spark, sf_dir):
    """Arrays spliced, filled and copied within, as their mutating forms would leave them."""
    a = F.split("p_name", " ")
    show = lambda c: F.array_join(c, ",")
    return table(spark, sf_dir, "part").select("p_partkey", show(userlib.splice(a, 1, 1, F.lit("x"), F.lit("y"))).alias("spliced"), show(userlib.fill(a, F.lit("z"), 1)).alias("filled"), userlib.radix(F.col("p_partkey"), 36).alias("radix"), userlib.parse_int(F.concat("p_size", F.lit("px"))).cast("long").alias("parsed"), userlib.to_fixed(F.col("p_retailprice"), 1).alias("fixed"))


ARRAYS = """
WITH a AS (SELECT p_partkey, p_size, p_retailprice, string_split(p_name, ' ') AS a FROM part)
SELECT p_partkey, array_to_string(a[1:1] || ['x', 'y'] || a[3:], ',') AS spliced, array_to_string(list_transform(a, lambda x, i: CASE WHEN i > 1 THEN 'z' ELSE x END), ',') AS filled, lower(to_base(p_partkey, 36)) AS radix, CAST(p_size AS BIGINT) AS parsed, format('{:.1f}', floor(p_retailprice * 10 + 0.5) / 10) AS fixed FROM a
"""


def kept_parents_and_children(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") - F.col("c_custkey") % 4).alias("parent"), "c_nationkey", "c_acctbal")
    return joins.retained(rows, "c_custkey", "parent", F.col("c_nationkey") < 10, F.col("c_acctbal") > 5000).select("c_custkey", "parent")


RETAINED = "WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey - c_custkey % 4 END AS parent, c_nationkey, c_acctbal FROM customer), k AS (SELECT c_custkey FROM r WHERE parent IS NULL AND c_nationkey < 10) SELECT c_custkey, parent FROM r WHERE CASE WHEN parent IS NULL THEN c_nationkey < 10 ELSE parent IN (SELECT c_custkey FROM k) OR c_acctbal > 5000 END"


def recent_and_first(spark, sf_dir):
    """The newest thousand users after a cutoff, each by its first row."""
    rows = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    return analytics.recent(rows, "user_id", "at", 1000, "2024-01-05")


RECENT = "SELECT user_id, min(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS at FROM events WHERE ts > TIMESTAMP '2024-01-05' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000"


def normalized_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return analytics.max_normalized(rows, "n", "share").withColumn("share", numbers.half_up(F.col("share"), 6))


NORMALIZED = "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, floor(n / (SELECT max(n) FROM n) * 1000000 + 0.5) / 1000000 AS share FROM n"


def speed_goals(spark, sf_dir):
    """Requests that tell of speed, classified by a goal and counted by day; day limits with their lifetime bonus."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("ts", "user_id", F.lit(0).alias("timestamp_first_byte"), (e % 400).alias("timestamp_last_byte"), (e % 60).alias("tokens_output"))
    days = counters.qualified(rows, 100.0).groupBy("user_id", dates.day_key(F.col("ts")).alias("day")).agg(F.count_if("qualifies").alias("fast"), F.count(F.lit(1)).alias("used"))
    life = days.groupBy("user_id").agg(F.sum("used").alias("lifetime"))
    return counters.day_limit(days.join(life, "user_id"), "used", "lifetime", 2)


SPEED = "WITH q AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 60 * 1.0 / (event_id % 400) >= 100 AS f, (event_id % 60) / (event_id % 400) * 1000 >= 100.0 AS fast FROM events WHERE event_id % 60 > 10 AND event_id % 400 > 0), d AS (SELECT user_id, day, count(*) FILTER (fast) AS fast, count(*) AS used FROM q GROUP BY 1, 2) SELECT *, CAST(sum(used) OVER (PARTITION BY user_id) AS BIGINT) AS lifetime, CAST(CASE WHEN sum(used) OVER (PARTITION BY user_id) < 14 THEN 4 ELSE 2 END AS INTEGER) AS allowed, used >= CASE WHEN sum(used) OVER (PARTITION BY user_id) < 14 THEN 4 ELSE 2 END AS limited FROM d"


def event_ownership(spark, sf_dir):
    """Each user's whole log replayed against its first half and its owners, the second half twice in the batch."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    seq, half = (F.row_number().over(order) - 1).cast("long"), F.floor(F.count(F.lit(1)).over(Window.partitionBy("user_id")) / 2)
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("aggregate_id"), seq.alias("seq"), F.lit("t").alias("type"), F.col("props").alias("data"), half.alias("half"))
    batch = rows.drop("half").withColumn("owner_id", F.lit("me"))
    owners = rows.select("aggregate_id").distinct().withColumn("owner_id", F.when(F.col("aggregate_id").endswith("3"), "you").otherwise("me"))
    log = rows.filter("seq < half").drop("half")
    again = rows.filter("seq >= half").drop("half").withColumn("owner_id", F.lit("me"))
    return eventlog.incoming(log, batch.unionByName(again), owners).groupBy("aggregate_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"))


OWNERSHIP = """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS aggregate_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, floor(count(*) OVER (PARTITION BY user_id) / 2) AS half FROM events),
v AS (SELECT aggregate_id, seq, CASE WHEN aggregate_id LIKE '%3' THEN 'foreign' WHEN seq < half THEN 'replay' ELSE 'append' END AS verdict FROM r UNION ALL SELECT aggregate_id, seq, CASE WHEN aggregate_id LIKE '%3' THEN 'foreign' ELSE 'replay' END FROM r WHERE seq >= half)
SELECT aggregate_id, verdict, count(*) AS n, max(seq) AS last FROM v GROUP BY 1, 2
"""


def dead_and_dangling(spark, sf_dir):
    """Symbols that nothing refers to, edges whose target is missing, and god objects of the files."""
    parts = table(spark, sf_dir, "part")
    nodes = parts.select(F.col("p_partkey").cast("string").alias("id"), _pick(F.col("p_partkey"), "function", "class", "variable").alias("kind"), F.lit("f").alias("file"), (F.col("p_partkey") % 5 == 0).alias("is_exported"), (F.col("p_partkey") % 7 == 0).alias("is_entry_point"))
    edges = parts.select((F.col("p_partkey") * 2).cast("string").alias("to"), F.col("p_partkey").cast("string").alias("from"), F.lit("call").alias("kind"))
    dead = graph.dead_code(nodes, edges).select("id", F.lit("dead").alias("what"))
    return dead.unionByName(graph.dangling(nodes, edges).select(F.col("to").alias("id"), F.lit("dangling").alias("what")))


DEAD = """
WITH e AS (SELECT p_partkey * 2 AS t FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS id, 'dead' AS what FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey NOT IN (SELECT t FROM e)
UNION ALL SELECT CAST(t AS VARCHAR), 'dangling' FROM e WHERE t NOT IN (SELECT p_partkey FROM part)
"""


QUERIES = {
    "lake_rollup": (lake_rollup, LAKE), "lake_stats_rollup": (lake_stats_rollup, LAKE_STATS), "upsert_periods": (upsert_periods, UPSERT), "insert_ignored_and_added": (insert_ignored_and_added, IGNORED), "retired_dimensions": (retired_dimensions, RETIRED),
    "csv_written_and_read": (csv_written_and_read, CSV), "json_written_masked_and_read": (json_written_masked_and_read, JSON), "malformed_lines_and_objects": (malformed_lines_and_objects, LINES), "markdown_rows": (markdown_rows, MARKDOWN),
    "database_statements": (database_statements, DATABASE), "json_set_and_removed": (json_set_and_removed, JSON_SET), "like_user_text": (like_user_text, LIKE), "not_equal_or_null": (not_equal_or_null, NOT_EQUAL), "cube_counts": (cube_counts, CUBE),
    "joined_to_a_constant": (joined_to_a_constant, CONSTANT), "nested_totals": (nested_totals, NESTED), "session_model_usage": (session_model_usage, MODEL_USAGE), "session_tools": (session_tools, TOOLS), "context_and_pending": (context_and_pending, CONTEXT),
    "shared_state": (shared_state, SHARED), "cursor_page": (cursor_page, CURSOR), "finding_levels": (finding_levels, LEVELS), "finding_triggers": (finding_triggers, TRIGGERS), "catalogue_scores": (catalogue_scores, CATALOGUE), "submission_pivot": (submission_pivot, PIVOT),
    "aliases_removed": (aliases_removed, ALIASES), "globbed_paths": (globbed_paths, GLOB), "pattern_findings": (pattern_findings, PATTERNS), "boosted_names": (boosted_names, BOOSTED), "date_helpers": (date_helpers, DATES), "money_helpers": (money_helpers, MONEY),
    "dead_and_dangling": (dead_and_dangling, DEAD), "array_edits": (array_edits, ARRAYS), "kept_parents_and_children": (kept_parents_and_children, RETAINED), "recent_and_first": (recent_and_first, RECENT), "normalized_totals": (normalized_totals, NORMALIZED), "speed_goals": (speed_goals, SPEED), "event_ownership": (event_ownership, OWNERSHIP),
}
