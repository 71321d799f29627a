"""Queries over what a change reaches: impact, causes, noise, coverage; and over readers, logs, texts and samples."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..functions.userlib import LIBRARY as L
from ..operators import analytics, eventlog, findings, graph
from ..session import scratch
from ..sources import lake
from ..sources.files import table
from ..streaming import ingest
from .events import _LOG, _log
from .records import _pick, _pick_sql
from .relational import _GRAPH, _graph


def impact_files(spark, sf_dir):
    """What depends, over up to five steps, on three files of the graph of parts and suppliers; each node is a file."""
    edges = _graph(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct().withColumn("file", F.col("id"))
    return graph.impact(nodes, edges, spark.createDataFrame([("p0",), ("s3",), ("p21",)], "file string"))


IMPACT = f"""
WITH RECURSIVE {_GRAPH}, w(origin, node, depth) AS (SELECT o, o, 0 FROM (VALUES ('p0'), ('s3'), ('p21')) v(o) UNION SELECT origin, a, depth + 1 FROM w JOIN e ON b = node WHERE depth < 5),
m AS (SELECT origin AS trigger, node AS file, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2)
SELECT trigger, file, depth, (ARRAY{list(graph.DEPTH_CONFIDENCE)})[depth] AS confidence FROM m WHERE depth > 0 AND trigger <> file
"""


def _caused(spark, sf_dir):
    k = F.col("s_suppkey")
    own = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), k.cast("string")).alias("id"), F.concat(F.lit("s"), k.cast("string")).alias("node"), _pick(k, "leak", "cycle", "slow").alias("type"), (F.pmod(k, F.lit(10)) / 10).alias("hotspot"))
    fits = spark.createDataFrame([("leak", "slow"), ("cycle", "cycle")], "root_type string, related_type string")
    return graph.root_causes(own, _graph(spark, sf_dir), fits)


_CAUSED = f"""
{_GRAPH}, w(origin, node, depth) AS (SELECT DISTINCT b, b, 0 FROM e WHERE b LIKE 's%' UNION SELECT origin, e.b, depth + 1 FROM w JOIN e ON e.a = node WHERE depth < 6),
f AS (SELECT 'f' || s_suppkey AS id, 's' || s_suppkey AS node, {_pick_sql('s_suppkey', 'leak', 'cycle', 'slow')} AS type, (s_suppkey % 10) / 10e0 AS hotspot FROM supplier),
m AS (SELECT origin, node, CAST(min(depth) FILTER (depth > 0) AS INTEGER) AS path_length FROM w WHERE origin <> node GROUP BY 1, 2),
c AS (SELECT r.id AS root_id, o.id AS related_id, path_length, least(1e0, 1e0 - path_length * 1e-1 + CASE WHEN (r.type, o.type) IN (('leak', 'slow'), ('cycle', 'cycle')) THEN 2e-1 ELSE 0e0 END + r.hotspot * 1e-1) AS confidence FROM m JOIN f r ON r.node = origin JOIN f o ON o.node = m.node)
"""


def root_cause_pairs(spark, sf_dir):
    return _caused(spark, sf_dir).withColumn("confidence", numbers.half_up(F.col("confidence"), 6))


PAIRS = f"WITH RECURSIVE {_CAUSED} SELECT root_id, related_id, path_length, floor(confidence * 1000000 + 0.5) / 1000000 AS confidence FROM c WHERE confidence >= 6e-1"


def cause_chains(spark, sf_dir):
    """Each cause with the mean confidence of its pairs, and its last step."""
    heads, steps = findings.chains(_caused(spark, sf_dir))
    last = steps.groupBy("root_id").agg(F.max("step").alias("steps"), F.max_by("finding_id", "step").alias("last"))
    return heads.join(last, "root_id").select("root_id", "related", "steps", "last", numbers.half_up(F.col("confidence"), 2).alias("confidence"))


CHAINS = f"""
WITH RECURSIVE {_CAUSED}, s AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY path_length, related_id) AS step FROM c WHERE confidence >= 6e-1)
SELECT root_id, count(DISTINCT related_id) AS related, CAST(max(step) AS INTEGER) AS steps, arg_max(related_id, step) AS last, floor(floor(avg(confidence) * 10000 + 0.5) / 10000 * 100 + 0.5) / 100 AS confidence FROM s GROUP BY 1
"""


def noise_reasons(spark, sf_dir):
    """Orders as findings (customer as file, priority as type), their lines as steps of their suppliers' chains."""
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("type"), _pick(k, *graph.SEVERITY).alias("severity"), F.pmod(k, F.lit(61)).alias("line_start"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("chain_id"), F.col("l_orderkey").alias("finding_id"), F.col("l_linenumber").alias("step"), _pick(F.col("l_suppkey"), *graph.SEVERITY).alias("root_severity"))
    return graph.noise(own, steps).select("id", "noise_suppressed", "noise_reason")


_PLACE = lambda c: f"list_position({list(graph.SEVERITY)}, {c})"
NOISE = f"""
WITH f AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderpriority AS type, {_pick_sql('o_orderkey', *graph.SEVERITY)} AS severity, o_orderkey % 61 AS line FROM orders),
d AS (SELECT *, row_number() OVER w AS no, first_value(id) OVER w AS first_id, first_value(line) OVER w AS first_line FROM f WINDOW w AS (PARTITION BY file, type ORDER BY {_PLACE('severity')} DESC, id)),
c AS (SELECT l_orderkey AS id, min(l_linenumber) AS depth, arg_max({_pick_sql('l_suppkey', *graph.SEVERITY)}, l_suppkey) AS root, count(DISTINCT l_suppkey) AS chains FROM lineitem GROUP BY 1),
r AS (SELECT d.id, CASE WHEN no > 1 THEN 'duplicate of ' || first_id || CASE WHEN abs(line - first_line) <= 20 THEN ': line range' ELSE ': severity' END
 WHEN depth > 3 AND {_PLACE('severity')} <= {_PLACE('root')} THEN 'derived at depth ' || depth WHEN chains >= 2 THEN 'in ' || chains || ' chains' END AS noise_reason FROM d LEFT JOIN c USING (id))
SELECT id, noise_reason IS NOT NULL AS noise_suppressed, noise_reason FROM r
"""


def module_coverage(spark, sf_dir):
    """Suppliers in debt as the affected files of their nations."""
    files = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("module"), "s_acctbal")
    return graph.coverage(files.filter("s_acctbal < 1000").select("file"), files.drop("s_acctbal"), "module")


COVERAGE = """
SELECT s_nationkey AS module, count(*) FILTER (s_acctbal < 1000) AS affected_files, count(*) AS total_files,
 CASE WHEN count(*) FILTER (s_acctbal < 1000) = count(*) THEN 'full' WHEN count(*) FILTER (s_acctbal < 1000) = 1 AND count(*) > 3 THEN 'minimal' ELSE 'partial' END AS impact_level
FROM supplier GROUP BY 1 HAVING count(*) FILTER (s_acctbal < 1000) > 0
"""


def god_files(spark, sf_dir):
    """Brands as files, their parts as symbols, suppliers and orders of their lines as ways in and out."""
    parts = table(spark, sf_dir, "part")
    nodes = parts.select(F.col("p_brand").alias("file"), _pick(F.col("p_partkey"), "function", "method", "class", "variable").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    ways = lines.groupBy(F.col("p_brand").alias("file")).agg(F.count_distinct("l_suppkey").alias("fan_in"), F.count_distinct("l_orderkey").alias("fan_out"))
    roles = parts.select(F.col("p_brand").alias("file"), F.when(F.col("p_brand").endswith("5"), "test").otherwise("source").alias("role")).distinct()
    return graph.god_objects(nodes, ways, roles)


GODS = f"""
WITH n AS (SELECT p_brand AS file, count(*) AS symbols FROM part WHERE {_pick_sql('p_partkey', 'function', 'method', 'class', 'variable')} <> 'variable' GROUP BY 1 HAVING count(*) > 5),
w AS (SELECT p_brand AS file, count(DISTINCT l_suppkey) AS fan_in, count(DISTINCT l_orderkey) AS fan_out FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT file, symbols, fan_in, fan_out FROM n JOIN w USING (file) WHERE (fan_in > 5 OR fan_out > 8) AND file NOT LIKE '%5'
"""


def endpoint_impacts(spark, sf_dir):
    """Suppliers as triggers, the parts that they reach as files, some of which are routes."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("depth"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    impacts = lines.select(name("s", "l_suppkey").alias("trigger"), name("p", "l_partkey").alias("file"), "depth", (F.col("l_suppkey") % 7 == 0).alias("is_interface"))
    parts = table(spark, sf_dir, "part")
    routes = parts.filter("p_partkey % 3 = 0").select(name("p", "p_partkey").alias("file")).unionByName(table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(name("s", "s_suppkey").alias("file")))
    handlers = parts.filter("p_partkey % 2 = 0").select(name("p", "p_partkey").alias("file"), F.col("p_name").alias("name"))
    return findings.api_impacts(impacts, routes, handlers)


ENDPOINTS = """
WITH i AS (SELECT l_suppkey AS s, 'p' || l_partkey AS file, l_partkey AS p, min(l_linenumber) AS depth FROM lineitem GROUP BY ALL),
o AS (SELECT s, 's' || s AS file, NULL AS p, 0 AS depth FROM (SELECT DISTINCT s FROM i) UNION ALL SELECT s, file, p, depth FROM i)
SELECT 's' || s AS trigger, CASE WHEN p % 2 = 0 THEN file || '::' || p_name ELSE file END AS endpoint, CASE WHEN depth = 0 OR s % 7 = 0 THEN 'breaking' WHEN depth = 1 THEN 'non_breaking' ELSE 'unknown' END AS impact_level
FROM o LEFT JOIN part ON p_partkey = p WHERE (p IS NULL AND s % 2 = 0) OR p_partkey % 3 = 0
"""


def compacted_log(spark, sf_dir):
    return eventlog.compacted(_log(spark, sf_dir), ["aggregate_id", "type"]).select("aggregate_id", "type", "seq", "id")


COMPACTED = f"WITH {_LOG} SELECT aggregate_id, type, max(seq) AS seq, arg_max(id, seq) AS id FROM l GROUP BY 1, 2"


def metric_log_lines(spark, sf_dir):
    """Log lines, of which some carry a metric and some of these are broken."""
    e = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")))
    line = F.when(e % 3 == 0, F.concat(F.lit("_metric:"), body)).when(e % 3 == 1, F.concat(F.lit("said _metric:"), body)).otherwise("_metric:{broken")
    rows = lake.metric_lines(table(spark, sf_dir, "events").select(line.alias("value")))
    return rows.filter("fields['kind'] IS NOT NULL").groupBy(F.col("fields")["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("fields")["user"]).alias("users"))


METRICS = "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_id % 3 = 0 GROUP BY 1"


def scoped_and_quarantined(spark, sf_dir):
    """Requests in scope by path; of those, how many have a route and how many go aside."""
    e = F.col("event_id")
    path = F.when(e % 4 == 0, "/v1/chat").when(e % 4 == 1, "/v1/chat/more").when(e % 4 == 2, "/v1/models/x").otherwise("/v2/models")
    rows = table(spark, sf_dir, "events").select(path.alias("path"), _pick(F.col("user_id"), "inference.event", "other.event", "broken").alias("lake_key"))
    own = lake.scoped(rows, "path", {"/v1/chat": False, "/v1/models": True})
    good, bad = lake.quarantined(own, ["inference.event"])
    tag = lambda df, name: df.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.lit(name).alias("kept"), "n")
    return tag(good, "routed").unionByName(tag(bad, "aside"))


SCOPED = "SELECT CASE event_id % 4 WHEN 0 THEN '/v1/chat' ELSE '/v1/models/x' END AS path, CASE WHEN user_id % 3 = 0 THEN 'routed' ELSE 'aside' END AS kept, count(*) AS n FROM events WHERE event_id % 4 IN (0, 2) GROUP BY 1, 2"


def sample_bounds(spark, sf_dir):
    """A random sample's size, and whether all its rows are the table's, each once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    own = analytics.sample(orders, 200).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))
    known = own.join(orders.withColumn("known", F.lit(True)), "o_orderkey", "left")
    return known.agg(F.sum("times").alias("n"), F.bool_and((F.col("times") == 1) & F.coalesce("known", F.lit(False))).alias("are_rows"))


SAMPLE = "SELECT least(200, count(*)) AS n, true AS are_rows FROM orders"


def text_layouts(spark, sf_dir):
    """Texts in the forms in which differences of layout alone vanish, and their short hashes."""
    own = F.replace(F.col("text"), F.lit(". "), F.lit(".\n    "))
    md5 = lambda c: F.md5(c.cast("binary"))
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", own.alias("t"), F.substring("text", 1, 60).alias("head"))
    return rows.select("doc_id", md5(text.squeezed(F.col("t"))).alias("squeezed"), md5(text.line_trimmed(F.col("t"))).alias("trimmed"), md5(text.unescaped(F.replace(F.col("t"), F.lit("\n"), F.lit("\\n")))).alias("unescaped"), text.hash31(F.col("head")).alias("hash"), text.hue(F.col("head")).alias("hue"))


TEXTS = r"""
WITH d AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || '    ') AS t, list_transform(string_split(substr(text, 1, 60), ''), lambda x: unicode(x)::BIGINT) AS c, length(substr(text, 1, 60)) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS squeezed, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), chr(10))) AS trimmed, md5(t) AS unescaped,
 CASE WHEN n = 0 THEN '0' ELSE lower(to_base(list_reduce(list_prepend(0::BIGINT, c), lambda a, x: (a * 31 + x) % 4294967296), 36)) END AS hash,
 CAST(CASE WHEN n = 0 THEN 0 ELSE abs(list_reduce(list_prepend(0::BIGINT, c), lambda a, x: ((x + a * 31 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)) % 360 END AS INTEGER) AS hue FROM d
"""


def approx_percentile_ranks(spark, sf_dir):
    """Whether the approximate percentiles' ranks among their type's events are within 1 %."""
    rows = table(spark, sf_dir, "events").select("event_type", "value")
    own = rows.groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95], 10000).alias("p"))
    met = rows.join(own, "event_type").groupBy("event_type")
    near = lambda i, q: ((F.count_if(F.col("value") < F.col("p")[i]) / F.count("value") - 0.01 <= q) & (F.count_if(F.col("value") <= F.col("p")[i]) / F.count("value") + 0.01 >= q))
    return met.agg(near(0, 0.5).alias("p50_ok"), near(1, 0.95).alias("p95_ok"))


APPROX = "SELECT event_type, true AS p50_ok, true AS p95_ok FROM events GROUP BY 1"


def refreshed_rollup(spark, sf_dir):
    """The hourly job: a full pass, then one that does the open week again; daily counts up to five minutes before the second."""
    path, start = scratch(spark, "refreshed"), datetime(2024, 1, 1)
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")

    def compute(begin, end):
        own = rows.filter((F.col("ts") >= F.lit(begin.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")) & (F.col("ts") < F.lit(end.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")))
        return own.groupBy(F.lit("day").alias("grain"), dates.day_key(F.col("ts")).alias("period_key"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    last = None
    for now in (datetime(2024, 1, 17, 10, 2), datetime(2024, 1, 17, 11, 2)):
        ingest.refresh(path, now, last, start, compute, ["grain", "period_key", "event_type"])
        last = now
    return spark.read.parquet(path).select(F.col("period_key").cast("string").alias("day"), "event_type", "n")


REFRESHED = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-17 10:57:00' GROUP BY 1, 2"


def object_ops(spark, sf_dir):
    """Objects, sets and JSON of the user library."""
    m = F.create_map(F.lit("a"), F.col("o_orderkey") % 5, F.lit("b"), F.col("o_custkey") % 5)
    s = F.array(F.col("o_orderkey") % 3, F.col("o_custkey") % 3, F.lit(7).cast("long"))
    text_ = L["json.stringify"](F.struct((F.col("o_orderkey") % 5).alias("x"), F.lit("y").alias("z")))
    joined = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", joined(L["object.keys"](m)).alias("keys"), joined(L["object.values"](m)).alias("vals"), L["object.hasOwn"](m, F.lit("b")).alias("has"), joined(L["object.values"](L["object.assign"](m, F.create_map(F.lit("a"), F.lit(9).cast("long"))))).alias("assigned"),
        F.size(L["set.add"](s, F.lit(7).cast("long"))).alias("added"), L["set.has"](s, F.lit(0).cast("long")).alias("zero"), joined(F.array_sort(L["set.union"](s, F.array(F.lit(1).cast("long"), F.lit(8).cast("long"))))).alias("both"), joined(F.array_sort(L["set.difference"](s, F.array(F.lit(0).cast("long"))))).alias("less"),
        text_.alias("json"), L["json.get"](text_, "$.x").alias("x"),
    )


OBJECTS = """
WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b, list_distinct([o_orderkey % 3, o_custkey % 3, 7]) AS s FROM orders)
SELECT o_orderkey, 'a,b' AS keys, a || ',' || b AS vals, true AS has, b || ',9' AS assigned, CAST(len(s) AS INTEGER) AS added, list_contains(s, 0) AS zero,
 array_to_string(list_sort(list_distinct(list_concat(s, [1, 8]))), ',') AS both, array_to_string(list_sort(list_filter(s, lambda x: x <> 0)), ',') AS less, '{"x":' || a || ',"z":"y"}' AS json, CAST(a AS VARCHAR) AS x FROM o
"""


def regexp_and_date_ops(spark, sf_dir):
    """Regular expressions, static functions of texts and dates of the user library."""
    c, d = F.col("o_orderpriority"), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", L["regexp.test"](c, "^[1-3]-").alias("urgent"), L["regexp.exec"](c, "^(\\d)-(.*)$", 2).alias("word"), L["string.padStart"](c, 20, "*").alias("padded"), L["string.charAt"](c, 2).alias("third"), L["string.repeat"](L["string.charAt"](c, 0), F.lit(3)).alias("thrice"), L["string.codePointAt"](c, 0).alias("code"),
        L["date.getUTCFullYear"](d).alias("year"), L["date.getUTCMonth"](d).alias("month"), L["date.getUTCDay"](d).alias("weekday"), L["date.getTime"](d).alias("ms"), L["date.toISOString"](d).alias("iso"), L["date.parse"](L["date.toISOString"](d)).alias("parsed"),
    )


REGEXP_DATES = r"""
SELECT o_orderkey, regexp_matches(o_orderpriority, '^[1-3]-') AS urgent, regexp_extract(o_orderpriority, '^(\d)-(.*)$', 2) AS word, CASE WHEN length(o_orderpriority) >= 20 THEN o_orderpriority ELSE lpad(o_orderpriority, 20, '*') END AS padded, substr(o_orderpriority, 3, 1) AS third, repeat(substr(o_orderpriority, 1, 1), 3) AS thrice, unicode(o_orderpriority) AS code,
 CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) - 1 AS INTEGER) AS month, CAST(dayofweek(o_orderdate) AS INTEGER) AS weekday, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms, strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS parsed FROM orders
"""


QUERIES = {
    "impact_files": (impact_files, IMPACT), "root_cause_pairs": (root_cause_pairs, PAIRS), "cause_chains": (cause_chains, CHAINS), "noise_reasons": (noise_reasons, NOISE), "module_coverage": (module_coverage, COVERAGE), "god_files": (god_files, GODS), "endpoint_impacts": (endpoint_impacts, ENDPOINTS),
    "compacted_log": (compacted_log, COMPACTED), "metric_log_lines": (metric_log_lines, METRICS), "scoped_and_quarantined": (scoped_and_quarantined, SCOPED), "sample_bounds": (sample_bounds, SAMPLE), "text_layouts": (text_layouts, TEXTS), "approx_percentile_ranks": (approx_percentile_ranks, APPROX),
    "refreshed_rollup": (refreshed_rollup, REFRESHED), "object_ops": (object_ops, OBJECTS), "regexp_and_date_ops": (regexp_and_date_ops, REGEXP_DATES),
}
