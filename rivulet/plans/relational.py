"""Queries over orders, parts and their like: rollups, ranks, joins, sets, pages, dates, graph, text, the scalar library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, coerce, dates, numbers, text, typed
from ..functions.userlib import LIBRARY as L
from ..operators import analytics, cycles, graph, joins, paging, rollup, search
from ..operators import usage as usage_ops
from ..session import scratch
from ..sources import lookup
from ..sources.files import script_json, table

_CENTS = "CAST(floor({} * 100 + 0.5) AS BIGINT)"


def cents(c: str):
    return F.floor(F.col(c) * 100 + 0.5).cast("long")


_HALF = lambda e, n: f"floor({e} * {10**n} + 0.5) / {10**n}"


def weighted_average_merge(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_suppkey").agg(F.count(F.lit(1)).alias("requests"), numbers.half_up(F.avg("l_quantity"), 2).alias("avg_quantity"))
    return rollup.merged(lines, ["l_returnflag", "l_linestatus"], added=("requests",), averaged=("avg_quantity",), percentiles=())


WEIGHTED = f"WITH a AS (SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS requests, {_HALF('avg(l_quantity)', 2)} AS avg_quantity FROM lineitem GROUP BY 1, 2, 3) SELECT l_returnflag, l_linestatus, CAST(sum(requests) AS BIGINT) AS requests, {_HALF('(CAST(sum(CAST(avg_quantity * requests AS DECIMAL(28,8))) AS DOUBLE) / sum(requests))', 2)} AS avg_quantity FROM a GROUP BY 1, 2"


def rank_market_share(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("cents"), dates.iso_week_id(F.col("o_orderdate")).alias("week"))
    by = orders.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").groupBy("week", "c_nationkey").agg(F.sum("cents").alias("cents"), F.count(F.lit(1)).alias("orders"))
    named = by.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey").drop("c_nationkey")
    return rollup.ranked(named, ["week"], {"spend": "cents", "count": "orders"}, ["n_name"])


RANKS = f"""
WITH b AS (SELECT strftime(o_orderdate, '%G-W%V') AS week, n_name, CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) AS cents, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY week ORDER BY cents DESC, n_name) AS INTEGER) AS rank_by_spend, {_HALF('(cents / sum(cents) OVER (PARTITION BY week))', 6)} AS spend_share,
 CAST(row_number() OVER (PARTITION BY week ORDER BY orders DESC, n_name) AS INTEGER) AS rank_by_count, {_HALF('(orders / sum(orders) OVER (PARTITION BY week))', 6)} AS count_share FROM b
"""

_RULES = (("widget", "acme"), ("gear", "cogs"), ("bolt", "fasteners"), ("red", "paint"))


def provider_rules(spark, sf_dir):
    rules = rollup.Rules(authors=_RULES, excluded=("blue ring",), suffixes=("-free", ":global"))
    named = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.col("p_name"), F.when(F.pmod("p_partkey", F.lit(3)) == 0, "-free:global").when(F.pmod("p_partkey", F.lit(3)) == 1, "-free").otherwise("")).alias("model"), "p_brand")
    return named.select("p_partkey", rules.name(F.col("model")).alias("name"), rules.author(F.col("model")).alias("author"), rules.provider(F.col("model"), F.lit(""), F.col("p_brand")).alias("provider"), rules.tier(F.lit("web"), F.col("model")).alias("tier"))


_CASE = "CASE " + " ".join(f"WHEN contains(lower(p_name), '{k}') THEN '{v}'" for k, v in _RULES) + " ELSE 'unknown' END"
PROVIDERS = f"SELECT p_partkey, p_name AS name, CASE WHEN lower(p_name) <> 'blue ring' THEN {_CASE} END AS author, CASE WHEN lower(p_name) <> 'blue ring' THEN CASE WHEN {_CASE} <> 'unknown' THEN {_CASE} ELSE p_brand END END AS provider, CASE WHEN p_partkey % 3 < 2 THEN 'Free' ELSE 'Paid' END AS tier FROM part"


def _usage(spark, sf_dir) -> DataFrame:
    """Order lines as usage rows: customer as workspace, brand as model, return flag as plan."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", cents("l_extendedprice").alias("cost"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("workspace_id"), F.col("o_orderdate").alias("time_created"), F.col("o_orderpriority").alias("key_id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("model"))
    plan = F.when(F.col("l_returnflag") == "A", '{"plan":"sub"}').when(F.col("l_returnflag") == "R", '{"plan":"lite"}')
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey").select("workspace_id", "time_created", "model", "key_id", "cost", plan.alias("enrichment"), *[F.lit(n).cast("int").alias(f"{k}_tokens") for k, n in (("input", 1), ("output", 2), ("reasoning", None), ("cache_read", None), ("cache_write_5m", None), ("cache_write_1h", None))])


_USAGE = f"u AS (SELECT o_custkey AS workspace_id, o_orderdate AS time_created, p_brand AS model, o_orderpriority AS key_id, {_CENTS.format('l_extendedprice')} AS cost, CASE l_returnflag WHEN 'A' THEN 'sub' WHEN 'R' THEN 'lite' END AS plan FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"


def usage_plans_daily(spark, sf_dir):
    return usage_ops.daily(_usage(spark, sf_dir), F.lit("2001-01-01").cast("timestamp_ntz"), 400)


USAGE_DAILY = f"WITH {_USAGE} SELECT CASE WHEN grouping(d) = 1 THEN 'TOTAL' ELSE d END AS date, count(*) AS requests, CAST(sum(3) AS BIGINT) AS tokens, CAST(coalesce(sum(cost) FILTER (plan = 'sub'), 0) AS BIGINT) AS sub_cost, CAST(coalesce(sum(cost) FILTER (plan = 'lite'), 0) AS BIGINT) AS lite_cost, CAST(coalesce(sum(cost) FILTER (plan IS NULL), 0) AS BIGINT) AS api_cost, count(*) FILTER (plan = 'byok') AS byok_requests FROM (SELECT *, strftime(time_created, '%Y-%m-%d') AS d FROM u WHERE time_created >= TIMESTAMP '2001-01-01' - INTERVAL 400 DAYS) GROUP BY ROLLUP (d)"


def weekly_pivot_top3(spark, sf_dir):
    return usage_ops.top_models(_usage(spark, sf_dir), 3)


TOP3 = f"WITH {_USAGE}, b AS (SELECT workspace_id, model, CAST(sum(cost) AS BIGINT) AS cost FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY cost DESC, model) AS rank, sum(cost) OVER (PARTITION BY workspace_id) AS total FROM b) SELECT workspace_id, CAST(rank AS INTEGER) AS rank, model, cost, {_HALF('(cost / total * 100)', 1)} AS percent FROM r WHERE rank <= 3"


def weekly_spend(spark, sf_dir):
    subscribers = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("workspace_id"))
    return usage_ops.weekly_spend(_usage(spark, sf_dir), subscribers)


WEEKLY = f"WITH {_USAGE} SELECT workspace_id, CAST(strftime(time_created, '%G%V') AS INTEGER) AS week, CAST(sum(cost) AS BIGINT) AS cost FROM u WHERE (plan IS NULL OR plan <> 'sub') AND workspace_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2"


def weekly_pivot(spark, sf_dir):
    days = _usage(spark, sf_dir).withColumn("year", F.year("time_created"))
    return days.groupBy("key_id").pivot("year", list(range(1995, 2003))).agg(F.sum("cost")).na.fill(0).toDF("key_id", *[f"y{y}" for y in range(1995, 2003)])


PIVOT = f"WITH {_USAGE} SELECT key_id, " + ", ".join(f"CAST(coalesce(sum(cost) FILTER (year(time_created) = {y}), 0) AS BIGINT) AS y{y}" for y in range(1995, 2003)) + " FROM u GROUP BY 1"


def tz_daily_cost(spark, sf_dir):
    return usage_ops.cost_graph(_usage(spark, sf_dir), "+05:30")


TZ = f"WITH {_USAGE} SELECT strftime(time_created + INTERVAL 330 MINUTES, '%Y-%m-%d') AS date, model, key_id, CAST(sum(cost) AS BIGINT) AS cost FROM u GROUP BY 1, 2, 3"


def calendar_fill(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
    return joins.calendar_fill(facts, "day", ["o_orderpriority"], ["n", "cents"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


CALENDAR = f"WITH f AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n, CAST(sum({_CENTS.format('o_totalprice')}) AS BIGINT) AS cents FROM orders GROUP BY 1, 2), g AS (SELECT p.o_orderpriority, CAST(unnest(generate_series((SELECT min(day) FROM f), (SELECT max(day) FROM f), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT o_orderpriority FROM f) p) SELECT g.o_orderpriority, strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(cents, 0) AS cents FROM g LEFT JOIN f USING (o_orderpriority, day)"


def join_inner(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_name") == "ASIA")).select("c_custkey", "n_name", "r_name")


def join_left_on_filter(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    joined = joins.left_where(c, o, F.col("c_custkey") == F.col("o_custkey"), F.col("o_orderstatus") == "F")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("finished"))


def join_right(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("n_name", "s_suppkey")


def join_full(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.when(F.col("c_acctbal") > 9000, 1)).alias("rich")).filter("rich > 5")
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers")).filter("suppliers > 3")
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "rich", "suppliers")


def join_semi(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def join_anti(spark, sf_dir):
    """Customers without a dear order."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 400000), "left_anti").select("c_custkey", "c_name")


def semi_or_predicate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi_or(table(spark, sf_dir, "customer"), orders, "c_custkey", F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment")


def correlated_scalar(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(cents("o_totalprice")).alias("top"), F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(own, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "top", F.coalesce("n", F.lit(0)).alias("n"))


def fallback_key_join(spark, sf_dir):
    look = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_name").alias("v")).unionByName(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("k")).agg(F.max("p_name").alias("v")))
    left = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("Brand#none")).alias("first"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("second"), "p_name")
    return joins.fallback(left, look, [F.col("first"), F.col("second")], "k", "v", F.col("p_name"), "found").select("p_partkey", "found")


def band_match(spark, sf_dir):
    return joins.band(table(spark, sf_dir, "supplier").withColumn("units", F.floor("s_acctbal").cast("long")), ["s_nationkey"], "units", 500, "s_suppkey").select("s_nationkey", "a_id", "b_id", "a_value", "b_value")


def update_from(spark, sf_dir):
    source = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment")).filter("c_custkey % 2 = 0")
    return joins.update_from(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), source, ["c_custkey"], ["c_mktsegment"])


def update_from_joined(spark, sf_dir):
    """Customers' segments from a full join of their orders and nations: the dearest order's priority, or the nation's name where there is no order."""
    orders = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_totalprice", "o_orderkey")
    places = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), "n_name")
    source = orders.join(places, F.col("c_custkey") == F.col("k"), "full").select(F.coalesce("c_custkey", "k").alias("c_custkey"), F.coalesce("o_orderpriority", "n_name").alias("c_mktsegment"), (-F.col("o_totalprice")).alias("cheap"), "o_orderkey")
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return joins.update_from(target, source, ["c_custkey"], ["c_mktsegment"], ["cheap", "o_orderkey"])


UPDATE_JOINED = """
WITH p AS (SELECT c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0), o AS (SELECT * FROM orders WHERE o_custkey % 2 = 0),
s AS (SELECT coalesce(o_custkey, k) AS c_custkey, coalesce(o_orderpriority, n_name) AS v FROM o FULL JOIN p ON o_custkey = k QUALIFY row_number() OVER (PARTITION BY coalesce(o_custkey, k) ORDER BY -o_totalprice, o_orderkey) = 1)
SELECT c_custkey, coalesce(v, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN s USING (c_custkey)
"""


_KEYS = [("o_totalprice", True), ("o_orderkey", True)]


def _page(spark, sf_dir, **how):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return paging.page(rows, _KEYS, 20, **how)


def keyset_page_first(spark, sf_dir):
    return _page(spark, sf_dir)


def keyset_page_next(spark, sf_dir):
    return _page(spark, sf_dir, cursor=[250000.0, 5000])


def keyset_page_prev(spark, sf_dir):
    return _page(spark, sf_dir, cursor=[250000.0, 5000], back=True)


def _page_sql(where: str, back: bool = False) -> str:
    order = "o_totalprice, o_orderkey" if back else "o_totalprice DESC, o_orderkey DESC"
    return f"WITH m AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE {where} ORDER BY {order} LIMIT 21) SELECT *, (SELECT count(*) > 20 FROM m) AS has_more FROM m ORDER BY {order} LIMIT 20"


def midrank_percentile(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").withColumn("percentile", numbers.half_up(analytics.midrank_percentile("p_size", ["p_brand"]), 4)).withColumn("reverse", numbers.half_up(analytics.midrank_percentile("p_size", ["p_brand"], False), 4))


MIDRANK = "WITH w AS (SELECT p_partkey, p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS below, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) - 1 AS above, count(*) OVER (PARTITION BY p_brand, p_size) AS eq, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, p_brand, p_size, " + f"CASE WHEN n > 1 THEN {_HALF('((below + (eq - 1) / 2) / (n - 1) * 100)', 4)} END AS percentile, CASE WHEN n > 1 THEN {_HALF('((above + (eq - 1) / 2) / (n - 1) * 100)', 4)} END AS reverse FROM w"


def _nations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_custkey").alias("v")).withColumn("batch", F.lit(1))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("v")).withColumn("batch", F.lit(2))
    return c, s


def set_union_last_wins(spark, sf_dir):
    c, s = _nations(spark, sf_dir)
    return analytics.latest(c.unionByName(s), ["k"], ["batch"])


def set_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.pmod("user_id", F.lit(10)).alias("bucket")).distinct()


def set_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    return c.distinct().join(table(spark, sf_dir, "supplier").filter("s_acctbal > 3000").select(F.col("s_nationkey").alias("k")), "k", "left_anti")


def set_intersection(spark, sf_dir):
    c, s = _nations(spark, sf_dir)
    return c.select("k").intersect(s.filter("v > 50").select("k"))


def monthly_bounds(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("now"), F.make_timestamp(F.lit(1999), F.pmod("o_orderkey", F.lit(12)) + 1, F.lit(1), F.lit(10), F.lit(30), F.lit(0)).alias("first"))
    anchor = F.to_timestamp(F.date_format(F.date_add("first", F.least(F.pmod("o_orderkey", F.lit(31)), F.dayofmonth(F.last_day("first")) - 1).cast("int")), "yyyy-MM-dd 10:30:00"))
    o = o.withColumn("anchor", anchor)
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return o.select("o_orderkey", show(dates.month_start(F.col("now"), F.col("anchor"))).alias("start"), show(dates.month_end(F.col("now"), F.col("anchor"))).alias("end"))


BOUNDS = """
WITH a AS (SELECT o_orderkey, o_orderdate AS now, make_timestamp(1999, o_orderkey % 12 + 1, 1, 10, 30, 0) AS first FROM orders),
b AS (SELECT o_orderkey, now, day(first + to_days(CAST(least(o_orderkey % 31, day(last_day(first)) - 1) AS INTEGER))) AS d, date_trunc('month', now) AS m FROM a),
c AS (SELECT *, m + to_days(CAST(least(d, day(last_day(m))) - 1 AS INTEGER)) + INTERVAL '10 hours 30 minutes' AS this, m - INTERVAL 1 MONTH AS pm, m + INTERVAL 1 MONTH AS nm FROM b)
SELECT o_orderkey, strftime(CASE WHEN this <= now THEN this ELSE pm + to_days(CAST(least(d, day(last_day(pm))) - 1 AS INTEGER)) + INTERVAL '10 hours 30 minutes' END, '%Y-%m-%d %H:%M:%S') AS start,
 strftime(CASE WHEN this <= now THEN nm + to_days(CAST(least(d, day(last_day(nm))) - 1 AS INTEGER)) + INTERVAL '10 hours 30 minutes' ELSE this END, '%Y-%m-%d %H:%M:%S') AS end FROM c
"""


def iso_week_ids(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_week_id(d).alias("week"), F.date_format(dates.week_start(d), "yyyy-MM-dd").alias("monday"), F.date_format(dates.iso_week_start(dates.iso_week_number(d)), "yyyy-MM-dd").alias("from_number"))


def usage_status(spark, sf_dir):
    """Weekly and rolling status of customers: balance as usage, the last order as the update."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated"))
    rows = table(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", (cents("c_acctbal") * 1_000_000).alias("used"), F.col("updated").cast("timestamp").alias("updated"))
    now = F.lit("2001-07-18 12:00:00").cast("timestamp")
    weekly, rolling = usage_ops.weekly_status(F.col("used"), F.col("updated"), F.lit(80), now), usage_ops.rolling_status(F.col("used"), F.col("updated"), F.lit(80), 2000, now)
    return rows.select("c_custkey", weekly.alias("w"), rolling.alias("r")).select("c_custkey", *[F.col(f"{k}.{f}").alias(f"{n}_{f}") for k, n in (("w", "week"), ("r", "rolling")) for f in ("status", "reset_in_sec", "usage_percent")])


def _status_sql(prefix: str, fresh: str, reset: str, idle: str) -> str:
    return f"CASE WHEN {fresh} AND used >= 8000000000 THEN 'rate-limited' ELSE 'ok' END AS {prefix}_status, CAST(CASE WHEN {fresh} THEN {reset} ELSE {idle} END AS BIGINT) AS {prefix}_reset_in_sec, CAST(CASE WHEN NOT {fresh} THEN 0 WHEN used >= 8000000000 THEN 100 ELSE floor(least(100, used / 8000000000 * 100)) END AS INTEGER) AS {prefix}_usage_percent"


STATUS = f"WITH l AS (SELECT o_custkey, max(o_orderdate) AS updated FROM orders GROUP BY 1), r AS (SELECT c_custkey, {_CENTS.format('c_acctbal')} * 1000000 AS used, updated FROM customer JOIN l ON c_custkey = o_custkey) SELECT c_custkey, {_status_sql('week', '''(updated >= TIMESTAMP '2001-07-16')''', '388800', '388800')}, {_status_sql('rolling', '''(updated >= TIMESTAMP '2001-07-18 12:00:00' - INTERVAL 2000 HOURS)''', '''ceil(epoch(updated + INTERVAL 2000 HOURS) - epoch(TIMESTAMP '2001-07-18 12:00:00'))''', '7200000')} FROM r"


def levenshtein_pairs(spark, sf_dir):
    """Names of parts within two edits of each other."""
    near = search.near_names(table(spark, sf_dir, "part"), "p_name")
    return near.select("a", "b", "distance", numbers.half_up(text.similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


def fuzzy_names(spark, sf_dir):
    """Parts whose names have the letters of a query in order, with the best alignment's score."""
    scored = table(spark, sf_dir, "part").select("p_partkey", numbers.half_up(text.fuzzy_score(F.lit("RiG"), F.col("p_name")), 6).alias("score"))
    return scored.filter("score IS NOT NULL")


FUZZY = """
WITH c AS (SELECT p_partkey, k, substr(low, k, 1) AS c, CASE WHEN k = 1 OR NOT regexp_matches(substr(low, k - 1, 1), '[\\p{L}\\p{N}]') THEN 1 ELSE 0 END AS word FROM (SELECT p_partkey, lower(p_name) AS low, unnest(range(1, length(p_name) + 1)) AS k FROM part)),
r AS (SELECT p_partkey, k, 1 + word AS s FROM c WHERE c = 'r'),
i AS (SELECT p_partkey, c.k, max(1 + word + s + CASE WHEN c.k = r.k + 1 THEN 1 ELSE 0 END) AS s FROM c JOIN r USING (p_partkey) WHERE c = 'i' AND r.k < c.k GROUP BY ALL),
g AS (SELECT p_partkey, c.k, max(1 + word + s + CASE WHEN c.k = i.k + 1 THEN 1 ELSE 0 END) AS s FROM c JOIN i USING (p_partkey) WHERE c = 'g' AND i.k < c.k GROUP BY ALL)
SELECT p_partkey, floor(max(s) / 9 * 1000000 + 0.5) / 1000000 AS score FROM g GROUP BY 1
"""


def edited_blocks(spark, sf_dir):
    """Each document's first five lines, letters of the inner ones changed, found again in it; nulls where something else repeats them better or there are fewer lines."""
    lines = F.split("text", "\n")
    inner = F.transform(F.slice(lines, 2, 3), lambda x: F.translate(x, "eo", "oi"))
    block = F.when(F.size(lines) >= 5, F.array_join(F.concat(F.slice(lines, 1, 1), inner, F.slice(lines, 5, 1)), "\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", blocks.find_block(F.col("text"), block).alias("f")).filter("f.start_line IS NOT NULL")
    return rows.select("doc_id", "f.start_line", "f.end_line", numbers.half_up(F.col("f.similarity"), 6).alias("similarity"))


_LIKENESS = "CASE WHEN greatest(length(l[i + {n}]), length(t[{m}])) = 0 THEN 0 ELSE 1 - levenshtein(l[i + {n}], t[{m}]) / greatest(length(l[i + {n}]), length(t[{m}])) END"
EDITED_BLOCKS = f"""
WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))) AS l FROM documents),
b AS (SELECT doc_id, l, [l[1], translate(l[2], 'eo', 'oi'), translate(l[3], 'eo', 'oi'), translate(l[4], 'eo', 'oi'), l[5]] AS t FROM d WHERE len(l) >= 5),
p AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM b), s AS (SELECT *, list_position(l[i + 2:], t[5]) AS p FROM p WHERE l[i] = t[1]),
c AS (SELECT *, i + 1 + p AS j FROM s WHERE p IS NOT NULL AND p BETWEEN 2 AND 4),
m AS (SELECT doc_id, i, j, ({_LIKENESS.format(n=1, m=2)} + {_LIKENESS.format(n=2, m=3)} + CASE WHEN j - i >= 4 THEN {_LIKENESS.format(n=3, m=4)} ELSE 0 END) / least(3, j - i - 1) AS sim FROM c)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS start_line, CAST(j - 1 AS INTEGER) AS end_line, floor(sim * 1000000 + 0.5) / 1000000 AS similarity FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, i) = 1 AND sim >= {blocks.LEAST_SIMILARITY}
"""


def orders_looked_up(spark, sf_dir):
    """The lines of the hundred dearest orders, by a point lookup in a table of lines."""
    path = scratch(spark, "lookup")
    lookup.write(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, "l_orderkey", 64)
    keys = [r[0] for r in table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey").collect()]
    return lookup.lookup(spark, path, "l_orderkey", keys, 64)


LOOKED_UP = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)"


def typed_line_counts(spark, sf_dir):
    """A function of declared types, registered and called in SQL: lines and words of each document that has text."""

    def run(row):
        if row["text"] is not None:
            yield {"id": row["doc_id"], "lines": row["text"].count("\n") + 1, "words": sum(1 for x in row["text"].split(" ") if x)}

    typed.register(spark, "rivulet_line_counts", "doc_id bigint, text string", "id bigint, lines int, words int", run)
    table(spark, sf_dir, "documents").createOrReplaceTempView("rivulet_documents")
    return spark.sql("SELECT * FROM rivulet_line_counts(TABLE(SELECT doc_id, text, lang FROM rivulet_documents))")


LINE_COUNTS = "SELECT doc_id AS id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS INTEGER) AS words FROM documents WHERE text IS NOT NULL"


def grep_lines(spark, sf_dir):
    return search.grep(table(spark, sf_dir, "documents"), "doc_id", "text", "(?i)licen[sc]e|password|api[_-]?key").withColumn("line", F.md5(F.col("line").cast("binary")))


GREP = "SELECT doc_id, CAST(no AS INTEGER) AS line_no, md5(substr(line, 1, 2000)) AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS no FROM documents) WHERE regexp_matches(line, '(?i)licen[sc]e|password|api[_-]?key')"


def slug_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_brand", "p_type")).alias("slug"))


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"), F.md5(text.truncate(F.col("text"), 100, "...").cast("binary")).alias("head"))


def wildcard_rules(spark, sf_dir):
    rules = [("*", "ask"), ("red *", "allow"), ("*bolt", "deny"), ("blue ?olt", "allow")]
    return table(spark, sf_dir, "part").select("p_partkey", text.last_rule(F.col("p_name"), rules, "none").alias("action"))


def page_scripts(spark, sf_dir):
    """Pages with their title, links and scripts counted, and the first structured-data script if any."""
    rows = script_json(table(spark, sf_dir, "pages"), "html", "data", "name string")
    return rows.select("page_id", F.size(F.regexp_extract_all("html", F.lit("(?i)<a\\s"), F.lit(0))).alias("links"), F.nullif(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.lit("")).alias("title"), F.col("data.name").alias("name"))


PAGES = "SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<a\\s')) AS INTEGER) AS links, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS title, CAST(NULL AS VARCHAR) AS name FROM pages"


def label_groups(spark, sf_dir):
    """The longest document of each language by label: a maximum by key, then a list by key."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "lang").agg(F.max("n_chars").alias("longest"))
    return rows.groupBy("quality").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "lang", F.col("longest").cast("string")))), ",").alias("longest"), F.count(F.lit(1)).alias("langs"))


def session_stats_median(spark, sf_dir):
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.char_length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"))
    return by.agg(F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.sum("chars").alias("chars"), F.median("chars").alias("median_chars"), F.max("asked").alias("most_asked"))


def newest_within_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    out = analytics.newest_within(rows, "conv_id", "turn", "text", text.token_estimate(F.col("text")), 100)
    return out.select("conv_id", "turn", F.md5(F.col("kept").cast("binary")).alias("kept"), "is_cut")


NEWEST = "WITH t AS (SELECT conv_id, turn, text, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS cost FROM conversations), w AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT conv_id, turn, md5(CASE WHEN before + cost <= 100 THEN text ELSE substr(text, CAST(greatest(1, length(text) - (100 - before) * 4 + 1) AS BIGINT)) END) AS kept, before + cost > 100 AS is_cut FROM w WHERE before < 100"


def _graph(spark, sf_dir):
    """Suppliers and parts as nodes; a part needs its suppliers, a supplier the part of its number: a graph with cycles."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    parts = lines.select(name("p", F.col("l_partkey")).alias("from"), name("s", F.col("l_suppkey")).alias("to"), F.lit("import").alias("kind"))
    back = lines.select(F.col("l_suppkey").alias("k")).distinct().select(name("s", F.col("k")).alias("from"), name("p", F.col("k") * 7 % 100).alias("to"), F.lit("call").alias("kind"))
    return parts.unionByName(back)


_GRAPH = "l AS (SELECT DISTINCT l_partkey, l_suppkey AS s FROM lineitem), e AS MATERIALIZED (SELECT 'p' || l_partkey AS a, 's' || s AS b FROM l UNION SELECT 's' || s, 'p' || (s * 7 % 100) FROM l)"


def fan_in_out(spark, sf_dir):
    edges = _graph(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("from", "to")).alias("id")).distinct().withColumn("file", F.substring("id", 1, 3))
    return graph.fan(nodes, edges)


FAN = f"WITH {_GRAPH}, f AS (SELECT substr(a, 1, 3) AS a, substr(b, 1, 3) AS b FROM e WHERE substr(a, 1, 3) <> substr(b, 1, 3)) SELECT file, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT a AS file, 0 AS i, 1 AS o FROM f UNION ALL SELECT b, 1, 0 FROM f) GROUP BY 1"


def bfs_depth5(spark, sf_dir):
    starts = spark.createDataFrame([("p1",), ("p2",), ("s3",)], "origin string")
    return graph.reach(graph.adjacency(_graph(spark, sf_dir)), starts, 5)


BFS = f"WITH RECURSIVE {_GRAPH}, w(origin, node, depth) AS (SELECT o, o, 0 FROM (VALUES ('p1'), ('p2'), ('s3')) v(o) UNION SELECT origin, b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 5) SELECT origin, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0"


def shortest_path(spark, sf_dir):
    starts = spark.createDataFrame([("p1",), ("s3",)], "origin string")
    found = graph.shortest_paths(graph.adjacency(_graph(spark, sf_dir)), starts, 6)
    return found.select("origin", "node", F.col("length").cast("int").alias("length"), F.array_join("path", ">").alias("path"))


SHORTEST = f"WITH RECURSIVE {_GRAPH}, w(origin, node, path) AS (SELECT o, o, [o] FROM (VALUES ('p1'), ('s3')) v(o) UNION SELECT origin, b, list_append(path, b) FROM w JOIN e ON a = node WHERE len(path) <= 6 AND NOT list_contains(path, b)) SELECT origin, node, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS path FROM w QUALIFY row_number() OVER (PARTITION BY origin, node ORDER BY len(path), path) = 1"


def cycle_nodes(spark, sf_dir):
    adj = graph.adjacency(_graph(spark, sf_dir))
    return graph.on_cycles(cycles.inside(adj, cycles.components(adj)), 8)


CYCLES = f"WITH RECURSIVE {_GRAPH}, i AS (SELECT a, b FROM e WHERE a IN (SELECT b FROM e)), w(origin, node, depth) AS (SELECT a, b, 1 FROM i UNION SELECT origin, i.b, depth + 1 FROM w JOIN i ON i.a = node WHERE depth < 8) SELECT origin AS node, CAST(min(depth) AS INTEGER) AS depth FROM w WHERE origin = node GROUP BY 1"


def strong_components(spark, sf_dir):
    return cycles.components(graph.adjacency(_graph(spark, sf_dir)))


COMPONENTS = f"WITH RECURSIVE {_GRAPH}, i AS (SELECT a, b FROM e WHERE a IN (SELECT b FROM e)), r(a, b) AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON i.a = r.b), c AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM c"


def _nation_graph(spark, sf_dir):
    """In each nation, from each part's number modulo 40 to that of each of its suppliers there."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    own = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    node = lambda key: F.concat_ws(":", F.col("s_nationkey").cast("string"), F.lpad((F.col(key) % 40).cast("string"), 2, "0"))
    return own.select(node("l_partkey").alias("src"), node("l_suppkey").alias("dst"))


def component_cycles(spark, sf_dir):
    edges = _nation_graph(spark, sf_dir)
    found = cycles.component_cycles(edges, cycles.components(edges))
    return found.select("component", "length", F.array_join("cycle", ">").alias("cycle"))


COMPONENT_CYCLES = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT s_nationkey || ':' || lpad(CAST(l_partkey % 40 AS VARCHAR), 2, '0') AS a, s_nationkey || ':' || lpad(CAST(l_suppkey % 40 AS VARCHAR), 2, '0') AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
i AS (SELECT a, b FROM e WHERE a IN (SELECT b FROM e)), r(a, b) AS (SELECT a, b FROM i UNION SELECT r.a, i.b FROM r JOIN i ON i.a = r.b),
c AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1),
w(component, node, path) AS (SELECT DISTINCT component, component, [component] FROM c UNION ALL SELECT w.component, i.b, list_append(path, i.b) FROM w JOIN i ON i.a = w.node JOIN c ON c.node = i.b AND c.component = w.component WHERE (len(path) = 1 OR w.node <> w.component) AND (i.b = w.component OR NOT list_contains(path, i.b)))
SELECT component, CAST(len(path) - 1 AS INTEGER) AS length, array_to_string(path, '>') AS cycle FROM w WHERE len(path) > 1 AND node = component QUALIFY row_number() OVER (PARTITION BY component ORDER BY len(path), list_reverse(path)) = 1
"""


def build_order(spark, sf_dir):
    """Orders wait for their parts, parts for their suppliers, those for nations, those for regions; ties by what they are called, then by kind."""
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    names = (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"), ("orders", "o", "o_orderkey", "o_orderpriority"))
    needs = (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("lineitem", "p", "l_partkey", "s", "l_suppkey"), ("lineitem", "o", "l_orderkey", "p", "l_partkey"))
    tasks = [table(spark, sf_dir, t).select(node(k, c).alias("node"), F.col(n).alias("file"), F.lit(t).alias("action")) for t, k, c, n in names]
    waits = [table(spark, sf_dir, t).select(node(k, c).alias("node"), node(o, d).alias("needs")) for t, k, c, o, d in needs]
    return cycles.topological_order(reduce(DataFrame.unionByName, tasks), reduce(DataFrame.unionByName, waits), ["file", "action"])


BUILD_ORDER = """
WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS node, r_name AS file, 'region' AS action FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT 'p' || p_partkey, p_name, 'part' FROM part UNION ALL SELECT 'o' || o_orderkey, o_orderpriority, 'orders' FROM orders),
e AS MATERIALIZED (SELECT DISTINCT a, b FROM (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem) WHERE a IN (SELECT node FROM t) AND b IN (SELECT node FROM t)),
w(node, level) AS (SELECT node, 0 FROM t WHERE node NOT IN (SELECT a FROM e) UNION SELECT e.a, level + 1 FROM w JOIN e ON e.b = w.node)
SELECT node, level, row_number() OVER (ORDER BY level, file, action, node) AS position FROM (SELECT node, CAST(max(level) AS INTEGER) AS level FROM w GROUP BY 1) JOIN t USING (node)
"""


def _region_graphs(spark, sf_dir):
    """A graph a region: from each nation n to nation (3 n + 1) mod 25."""
    n = table(spark, sf_dir, "nation")
    edges = n.select("n_regionkey", F.col("n_name").alias("from"), ((F.col("n_nationkey") * 3 + 1) % 25).alias("k")).join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("to")), "k")
    return edges.select(F.col("n_regionkey").alias("graph"), "from", "to")


_REGION_GRAPHS = "e AS MATERIALIZED (SELECT DISTINCT n.n_regionkey AS graph, n.n_name AS a, m.n_name AS b FROM nation n JOIN nation m ON m.n_nationkey = (n.n_nationkey * 3 + 1) % 25), r(graph, a, b) AS (SELECT * FROM e UNION SELECT r.graph, r.a, e.b FROM r JOIN e ON e.graph = r.graph AND e.a = r.b)"


def topo_order(spark, sf_dir):
    return graph.topological(_region_graphs(spark, sf_dir))


TOPO = f"""
WITH RECURSIVE {_REGION_GRAPHS}, n AS (SELECT graph, a AS node FROM e UNION SELECT graph, b FROM e), x AS (SELECT graph, a AS node FROM r WHERE a = b UNION SELECT r.graph, r.b FROM r JOIN r c ON c.graph = r.graph AND c.a = c.b AND c.a = r.a),
f AS (SELECT * FROM n EXCEPT SELECT * FROM x), w(graph, node, level) AS (SELECT graph, node, 0 FROM f UNION SELECT w.graph, e.b, level + 1 FROM w JOIN e ON e.graph = w.graph AND e.a = w.node JOIN f ON f.graph = e.graph AND f.node = e.b),
l AS (SELECT n.graph, n.node, max(level) AS level FROM n LEFT JOIN w USING (graph, node) GROUP BY 1, 2)
SELECT graph, node, row_number() OVER (PARTITION BY graph ORDER BY level IS NULL, level, node) - 1 AS position, level IS NULL AS is_cyclic FROM l
"""


def cycle_paths(spark, sf_dir):
    return graph.cycle_paths(_region_graphs(spark, sf_dir)).select("graph", F.array_join("cycle", ">").alias("cycle"))


#: Each node has one edge out, so a component is one cycle.
CYCLE_PATHS = f"""
WITH RECURSIVE {_REGION_GRAPHS}, c AS (SELECT x.graph, x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.graph = y.graph AND x.a = y.b AND x.b = y.a GROUP BY 1, 2),
w(graph, component, path) AS (SELECT DISTINCT graph, component, [component] FROM c UNION ALL SELECT w.graph, component, list_append(path, e.b) FROM w JOIN e ON e.graph = w.graph AND e.a = path[-1] WHERE len(path) = 1 OR path[-1] <> component)
SELECT graph, array_to_string(path, '>') AS cycle FROM w WHERE len(path) > 1 AND path[-1] = component
"""


def hotspot_scores(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("file"), F.col("l_suppkey").cast("string")).alias("file")).agg(F.count_distinct("l_partkey").alias("fan_in"), F.count_distinct("l_orderkey").alias("fan_out"), F.max("l_linenumber").alias("methods"), F.count(F.lit(1)).alias("loc"), F.count_if(F.col("l_quantity") >= 50).alias("v"))
    own = files.select("file", "fan_in", "fan_out", "methods", "loc", F.least(F.lit(1), F.col("v")).alias("violations"), (F.col("fan_in") % 2 == 0).alias("is_god"), F.pmod("fan_out", F.lit(3)).alias("cycles"))
    return graph.hotspots(own).select("file", numbers.half_up(F.col("score"), 6).alias("score"), "risk_level", F.array_join("reasons", ",").alias("reasons"))


HOTSPOTS = f"""
WITH f AS (SELECT 'file' || l_suppkey AS file, count(DISTINCT l_partkey) AS i, count(DISTINCT l_orderkey) AS o, max(l_linenumber) AS m, count(*) AS loc, least(1, count(*) FILTER (l_quantity >= 50)) AS v FROM lineitem GROUP BY 1),
s AS (SELECT *, least(1.0, (i * 1.5 + o) / max(i * 1.5 + o) OVER () * 0.4 + loc / max(loc) OVER () * 0.15 + m / greatest(1, max(m) OVER ()) * 0.1 + v * 0.2 + CASE WHEN i % 2 = 0 THEN 0.3 ELSE 0.0 END + least(0.5, o % 3 * 0.35)) AS score FROM f)
SELECT file, {_HALF('CAST(score AS DOUBLE)', 6)} AS score, CASE WHEN score >= 0.55 THEN 'critical' WHEN score >= 0.30 THEN 'high' WHEN score >= 0.15 THEN 'medium' ELSE 'low' END AS risk_level,
 'high_coupling,high_complexity' || CASE WHEN i % 2 = 0 THEN ',god_object' ELSE '' END || CASE WHEN o % 3 > 0 THEN ',circular_dependency' ELSE '' END AS reasons FROM s
"""


def array_hof(spark, sf_dir):
    a = F.col("embedding")
    big = lambda x: x > F.lit(0.1).cast("float")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", L["array.length"](L["array.filter"](a, big)).alias("big"), L["array.some"](a, big).alias("some"), L["array.every"](a, big).alias("every"), L["array.findIndex"](a, big).alias("first_at"), L["array.findLastIndex"](a, big).alias("last_at"),
        L["array.at"](a, -1).cast("double").alias("last"), L["array.length"](L["array.slice"](a, 2, -2)).alias("inner"), L["array.at"](L["array.reverse"](a), 0).cast("double").alias("reversed"), F.array_max(a).cast("double").alias("top"),
    )


HOF = "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > CAST(0.1 AS FLOAT))) AS INTEGER) AS big, len(list_filter(embedding, lambda x: x > CAST(0.1 AS FLOAT))) > 0 AS some, len(list_filter(embedding, lambda x: x > CAST(0.1 AS FLOAT))) = len(embedding) AS every, CAST(coalesce(list_position(list_transform(embedding, lambda x: x > CAST(0.1 AS FLOAT)), true), 0) - 1 AS INTEGER) AS first_at, CAST(CASE WHEN list_contains(list_transform(embedding, lambda x: x > CAST(0.1 AS FLOAT)), true) THEN len(embedding) - list_position(list_transform(list_reverse(embedding), lambda x: x > CAST(0.1 AS FLOAT)), true) ELSE -1 END AS INTEGER) AS last_at, CAST(embedding[-1] AS DOUBLE) AS last, CAST(len(embedding) - 4 AS INTEGER) AS inner, CAST(embedding[-1] AS DOUBLE) AS reversed, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings"


def map_ops(spark, sf_dir):
    m = F.from_json("props", "map<string,bigint>")
    own = table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    return own.select("event_id", L["map.get"](F.col("m"), "k").alias("k"), L["map.has"](F.col("m"), "z").alias("has_z"), L["map.size"](L["map.set"](F.col("m"), "z", F.lit(1).cast("long"))).alias("size"), L["map.get"](L["map.set"](F.col("m"), "k", F.lit(5).cast("long")), "k").alias("set_k"), F.array_join(L["map.keys"](F.col("m")), ",").alias("keys"))


def string_ops(spark, sf_dir):
    c = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", L["string.toUpperCase"](c).alias("upper"), L["string.indexOf"](c, "e").alias("e_at"), L["string.lastIndexOf"](c, "e").alias("last_e"), L["string.slice"](c, -4).alias("tail"), L["string.substring"](c, 5, 2).alias("mid"),
        L["string.padStart"](c, 12, "*").alias("padded"), L["string.replace"](c, "e", "E").alias("once"), L["string.replaceAll"](c, "e", "E").alias("all"), L["string.charAt"](c, 1).alias("second"), L["string.search"](c, "[aeiou]").alias("vowel"), F.element_at(L["string.split"](c, " "), 1).alias("word"), L["string.repeat"](F.col("p_type"), 2).alias("twice"),
    )


STRINGS = "SELECT p_partkey, upper(p_name) AS upper, CAST(instr(p_name, 'e') - 1 AS INTEGER) AS e_at, CAST(CASE WHEN contains(p_name, 'e') THEN length(p_name) - instr(reverse(p_name), 'e') ELSE -1 END AS INTEGER) AS last_e, right(p_name, 4) AS tail, substr(p_name, 3, 3) AS mid, CASE WHEN length(p_name) >= 12 THEN p_name ELSE lpad(p_name, 12, '*') END AS padded, CASE WHEN contains(p_name, 'e') THEN substr(p_name, 1, instr(p_name, 'e') - 1) || 'E' || substr(p_name, instr(p_name, 'e') + 1) ELSE p_name END AS once, replace(p_name, 'e', 'E') AS all, substr(p_name, 2, 1) AS second, CAST(length(regexp_extract(p_name, '^([^aeiou]*)[aeiou]', 1)) AS INTEGER) AS vowel, split_part(p_name, ' ', 1) AS word, p_type || p_type AS twice FROM part"


def math_ops(spark, sf_dir):
    c = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", L["math.trunc"](c).cast("long").alias("trunc"), L["math.round"](c).alias("rounded"), L["math.floor"](c).alias("floor"), L["math.ceil"](c).alias("ceil"), L["math.sign"](c).cast("int").alias("sign"), L["math.max"](c, F.lit(0.0)).alias("top"), L["number.isInteger"](c).alias("whole"), L["number.parseInt"](c.cast("string")).alias("parsed"), L["number.toString"](F.col("c_custkey"), 16).alias("hex"))


MATH = "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS trunc, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS rounded, CAST(floor(c_acctbal) AS BIGINT) AS floor, CAST(ceil(c_acctbal) AS BIGINT) AS ceil, CAST(sign(c_acctbal) AS INTEGER) AS sign, greatest(c_acctbal, 0.0) AS top, c_acctbal = floor(c_acctbal) AS whole, CAST(trunc(c_acctbal) AS BIGINT) AS parsed, lower(to_hex(c_custkey)) AS hex FROM customer"


def url_ops(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", L["url.protocol"](u).alias("protocol"), L["url.hostname"](u).alias("host"), L["url.pathname"](u).alias("path"), L["url.search"](u).alias("search"), L["url.get"](u, "utm_source").alias("utm"), L["url.has"](u, "page").alias("has_page"), L["url.encodeURIComponent"](u).alias("encoded"))


URLS = "SELECT page_id, regexp_extract(url, '^([a-z]+:)', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '(\\?[^#]*)', 1) AS search, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm, regexp_matches(url, '[?&]page=') AS has_page, url_encode(url) AS encoded FROM pages"


def coercions(spark, sf_dir):
    raw = F.when(F.pmod("c_custkey", F.lit(4)) == 0, F.col("c_acctbal").cast("string")).when(F.pmod("c_custkey", F.lit(4)) == 1, "true").when(F.pmod("c_custkey", F.lit(4)) == 2, "").otherwise("x1")
    ip = F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.concat(F.lit("10.0."), F.pmod("c_custkey", F.lit(250)).cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit("2001:0DB8::"), F.lower(F.hex("c_custkey"))))
    return table(spark, sf_dir, "customer").select("c_custkey", coerce.loose_double(raw).alias("number"), coerce.loose_boolean(raw).alias("flag"), coerce.country(F.substring("c_mktsegment", 1, 2)).alias("country"), coerce.ip_prefix(ip).alias("prefix"))


COERCIONS = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal WHEN 2 THEN 0.0 END AS number, CASE WHEN c_custkey % 4 = 1 THEN true END AS flag, upper(substr(c_mktsegment, 1, 2)) AS country, CASE WHEN c_custkey % 2 = 0 THEN '10.0.' || (c_custkey % 250) || '.7/32' ELSE '2001:db8:0:0::/64' END AS prefix FROM customer"


def top_parts_per_brand(spark, sf_dir):
    return analytics.top_per_group(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], 3, F.col("p_size").desc(), "p_partkey")


def order_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1 + F.when(F.pmod("o_orderkey", F.lit(97)) == 0, 1).otherwise(0)).cast("long").alias("seq"), "o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("seq", "o_orderkey")
    return rows.withColumn("before", F.lag("seq").over(order)).filter(F.col("seq") != F.coalesce(F.col("before") + 1, F.lit(0))).select("o_custkey", "seq", "o_orderkey")


QUERIES = {
    "weighted_average_merge": (weighted_average_merge, WEIGHTED), "rank_market_share": (rank_market_share, RANKS), "provider_rules": (provider_rules, PROVIDERS), "usage_plans_daily": (usage_plans_daily, USAGE_DAILY), "weekly_pivot_top3": (weekly_pivot_top3, TOP3), "weekly_spend": (weekly_spend, WEEKLY), "yearly_pivot": (weekly_pivot, PIVOT),
    "tz_daily_cost": (tz_daily_cost, TZ), "calendar_fill": (calendar_fill, CALENDAR),
    "join_inner": (join_inner, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'"),
    "join_left_on_filter": (join_left_on_filter, "SELECT c_custkey, count(o_orderkey) AS finished FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1"),
    "join_right": (join_right, "SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey"),
    "join_full": (join_full, "SELECT coalesce(c_nationkey, s_nationkey) AS nation, rich, suppliers FROM (SELECT c_nationkey, count(*) FILTER (c_acctbal > 9000) AS rich FROM customer GROUP BY 1 HAVING rich > 5) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1 HAVING suppliers > 3) ON c_nationkey = s_nationkey"),
    "join_semi": (join_semi, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    "join_anti": (join_anti, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "semi_or_predicate": (semi_or_predicate, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) OR c_acctbal < 0"),
    "correlated_scalar": (correlated_scalar, f"SELECT c_custkey, (SELECT max({_CENTS.format('o_totalprice')}) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer"),
    "fallback_key_join": (fallback_key_join, "WITH k AS (SELECT p_brand AS k, min(p_name) AS v FROM part GROUP BY 1 UNION ALL SELECT p_type, max(p_name) FROM part GROUP BY 1) SELECT p_partkey, coalesce(a.v, b.v, p_name) AS found FROM part LEFT JOIN k a ON a.k = CASE WHEN p_size > 25 THEN p_brand ELSE 'Brand#none' END LEFT JOIN k b ON b.k = CASE WHEN p_size > 10 THEN p_type END"),
    "band_match": (band_match, "WITH s AS (SELECT s_nationkey, s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS u FROM supplier) SELECT a.s_nationkey, a.s_suppkey AS a_id, b.s_suppkey AS b_id, a.u AS a_value, b.u AS b_value FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.u - b.u) <= 500"),
    "update_from_joined": (update_from_joined, UPDATE_JOINED), "update_from": (update_from, "SELECT c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS p FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) ON c_custkey = o_custkey"),
    "keyset_page_first": (keyset_page_first, _page_sql("true")), "keyset_page_next": (keyset_page_next, _page_sql("(o_totalprice, o_orderkey) < (250000.0, 5000)")), "keyset_page_prev": (keyset_page_prev, _page_sql("(o_totalprice, o_orderkey) > (250000.0, 5000)", True)),
    "midrank_percentile": (midrank_percentile, MIDRANK),
    "set_union_last_wins": (set_union_last_wins, "WITH a AS (SELECT c_nationkey AS k, max(c_custkey) AS v, 1 AS batch FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, max(s_suppkey), 2 FROM supplier GROUP BY 1) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch DESC) = 1"),
    "set_distinct": (set_distinct, "SELECT DISTINCT event_type, user_id % 10 AS bucket FROM events"),
    "set_difference": (set_difference, "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000"),
    "set_intersection": (set_intersection, "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier GROUP BY 1 HAVING max(s_suppkey) > 50"),
    "monthly_bounds": (monthly_bounds, BOUNDS),
    "iso_week_ids": (iso_week_ids, "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS from_number FROM orders"),
    "usage_status": (usage_status, STATUS),
    "levenshtein_pairs": (levenshtein_pairs, f"WITH n AS (SELECT DISTINCT p_name AS x FROM part) SELECT a.x AS a, b.x AS b, CAST(levenshtein(a.x, b.x) AS INTEGER) AS distance, {_HALF('(1 - levenshtein(a.x, b.x) / greatest(length(a.x), length(b.x)))', 4)} AS similarity FROM n a JOIN n b ON a.x < b.x WHERE levenshtein(a.x, b.x) <= 2"),
    "grep_lines": (grep_lines, GREP),
    "slug": (slug_names, "SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' / ', p_name, p_brand, p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part"),
    "token_estimate": (token_estimate, "SELECT doc_id, CAST(floor(length(text) / 4 + 0.5) AS BIGINT) AS tokens, md5(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END) AS head FROM documents"),
    "wildcard_rules": (wildcard_rules, "SELECT p_partkey, CASE WHEN p_name LIKE 'blue _olt' THEN 'allow' WHEN p_name LIKE '%bolt' THEN 'deny' WHEN p_name LIKE 'red %' THEN 'allow' ELSE 'ask' END AS action FROM part"),
    "page_scripts": (page_scripts, PAGES),
    "label_groups": (label_groups, "WITH g AS (SELECT quality, lang, max(n_chars) AS m FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) SELECT quality, array_to_string(list_sort(list(lang || ':' || m)), ',') AS longest, count(*) AS langs FROM g GROUP BY 1"),
    "session_stats_median": (session_stats_median, "WITH b AS (SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY 1) SELECT count(*) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(chars) AS BIGINT) AS chars, CAST(median(chars) AS DOUBLE) AS median_chars, max(asked) AS most_asked FROM b"),
    "newest_within_budget": (newest_within_budget, NEWEST),
    "fan_in_out": (fan_in_out, FAN), "bfs_depth5": (bfs_depth5, BFS), "shortest_path": (shortest_path, SHORTEST), "fuzzy_names": (fuzzy_names, FUZZY), "edited_blocks": (edited_blocks, EDITED_BLOCKS), "orders_looked_up": (orders_looked_up, LOOKED_UP), "typed_line_counts": (typed_line_counts, LINE_COUNTS),
    "cycle_nodes": (cycle_nodes, CYCLES), "strong_components": (strong_components, COMPONENTS), "component_cycles": (component_cycles, COMPONENT_CYCLES), "build_order": (build_order, BUILD_ORDER), "topo_order": (topo_order, TOPO), "cycle_paths": (cycle_paths, CYCLE_PATHS), "hotspot_scores": (hotspot_scores, HOTSPOTS),
    "array_hof": (array_hof, HOF),
    "map_ops": (map_ops, "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, false AS has_z, CAST(2 AS INTEGER) AS size, CAST(5 AS BIGINT) AS set_k, 'k' AS keys FROM events"),
    "string_ops": (string_ops, STRINGS), "math_ops": (math_ops, MATH), "url_ops": (url_ops, URLS), "coercions": (coercions, COERCIONS),
    "top_per_group": (top_parts_per_brand, "SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3"),
    "sequence_gaps": (order_gaps, "WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END AS seq, o_orderkey FROM orders) SELECT o_custkey, seq, o_orderkey FROM r QUALIFY seq <> coalesce(lag(seq) OVER (PARTITION BY o_custkey ORDER BY seq, o_orderkey) + 1, 0)"),
}
