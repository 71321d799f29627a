"""Queries over request events, alerts, windows and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..operators import analytics, eventlog, rollup, search, sessions
from ..sources.files import table
from ..streaming import counters

#: Stand-ins for the dimensions of a request, by remainders of the user's number.
COUNTRIES, TIERS, PROVIDERS = ("US", "DE", "FR", "JP", ""), ("Go", "Free", "Paid"), ("openai", "anthropic", "google", "xai")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as normalised requests: type as model, user as user, value as duration and cost, props.k as tokens."""
    user, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("long")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(user, F.lit(len(names))) + 1).cast("int"))
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("event_time"), pick(TIERS).alias("tier"), pick(PROVIDERS).alias("provider"), F.concat(F.col("event_type"), F.lit("-v1")).alias("provider_model"), F.col("event_type").alias("model"),
        F.upper(F.coalesce(F.nullif(pick(COUNTRIES), F.lit("")), F.lit("ZZ"))).alias("country"), F.lit("").alias("continent"), F.concat_ws("-", user.cast("string"), dates.day_key(F.col("ts"))).alias("session"), user.cast("string").alias("user_key"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("duration_ms"), (F.col("value") / 2).alias("ttfb_ms"), F.when(F.col("value") >= 1, F.col("value") * 3).alias("output_tps"),
        k.alias("tokens_input"), (k * 2).alias("tokens_output"), F.lit(0).cast("long").alias("tokens_reasoning"), F.lit(0).cast("long").alias("tokens_cache_read"), (k * 3).alias("tokens_total"),
        cents.alias("cost_input_microcents"), cents.alias("cost_output_microcents"), (cents * 2).alias("cost_total_microcents"),
    )


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: numbers.half_up(F.col(c), places) for c in columns})


_REQUESTS = f"""
r AS (SELECT ts AS event_time, (ARRAY{list(TIERS)})[user_id % {len(TIERS)} + 1] AS tier, (ARRAY{list(PROVIDERS)})[user_id % {len(PROVIDERS)} + 1] AS provider, event_type || '-v1' AS provider_model, event_type AS model,
 coalesce(nullif((ARRAY{list(COUNTRIES)})[user_id % {len(COUNTRIES)} + 1], ''), 'ZZ') AS country, user_id || '-' || strftime(ts, '%Y-%m-%d') AS session, CAST(user_id AS VARCHAR) AS user_key,
 CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS duration_ms, value / 2 AS ttfb_ms, CASE WHEN value >= 1 THEN value * 3 END AS output_tps,
 CAST(props->>'$.k' AS BIGINT) AS k, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, strftime(ts, '%G-W%V') AS week_key, strftime(ts, '%Y-%m-%d') AS day_key FROM events)
"""

_AVERAGES = {"avg_duration_ms": "avg(duration_ms)", "avg_ttfb_ms": "avg(ttfb_ms)", "avg_output_tps": "avg(output_tps)", "p50_duration_ms": "quantile_cont(duration_ms, 0.5)", "p95_duration_ms": "quantile_cont(duration_ms, 0.95)", "p50_ttfb_ms": "quantile_cont(ttfb_ms, 0.5)", "p95_ttfb_ms": "quantile_cont(ttfb_ms, 0.95)"}
_HALF = lambda e, n: f"floor({e} * {10**n} + 0.5) / {10**n}"


def stats_rollup(spark, sf_dir):
    """All eight sets and all measures, the percentiles exact; those of sketches are checked by their ranks in rollup_percentile_ranks."""
    return rounded(rollup.grouped(requests(spark, sf_dir), "all", exact=True), *_AVERAGES, places=8)


def rollup_exact_percentiles(spark, sf_dir):
    return rounded(rollup.exact_percentiles(requests(spark, sf_dir)), *rollup.PERCENTILES, places=8)


def rollup_percentile_ranks(spark, sf_dir):
    """Whether each sketched percentile's rank is within 1 % of what was asked for, in every group of the eight sets."""
    rows = requests(spark, sf_dir)
    return rollup.percentile_ranks(rows, rollup.grouped(rows, "all"))


SET_KEYS = """
CASE WHEN grouping(week_key) = 0 THEN 'week' ELSE 'day' END AS grain, coalesce(week_key, day_key) AS period_key,
 CASE WHEN grouping(country) = 0 AND grouping(model) = 0 THEN 'geo_model' WHEN grouping(country) = 0 THEN 'geo' WHEN grouping(model) = 0 THEN 'model' ELSE 'provider' END AS dimension,
 tier, CASE WHEN grouping(provider) = 0 THEN provider ELSE 'all' END AS provider, CASE WHEN grouping(model) = 0 THEN model WHEN grouping(country) = 0 THEN 'all' END AS model, CASE WHEN grouping(country) = 0 THEN country END AS country
""".strip()
BY_SETS = "GROUP BY GROUPING SETS ((week_key, tier, provider, model), (week_key, tier, provider), (week_key, tier, country), (week_key, tier, provider, model, country), (day_key, tier, provider, model), (day_key, tier, provider), (day_key, tier, country), (day_key, tier, provider, model, country))"
STATS_ROLLUP = f"""
WITH {_REQUESTS}
SELECT {SET_KEYS}, 'all' AS dataset,
 CASE WHEN grouping(model) = 0 AND grouping(country) = 1 THEN coalesce(max(nullif(provider_model, '')), '') END AS provider_model, CASE WHEN grouping(country) = 0 THEN '' END AS continent,
 count(DISTINCT session) AS sessions, count(*) AS requests, count(DISTINCT user_key) AS unique_users,
 CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS reasoning_tokens, CAST(0 AS BIGINT) AS cache_read_tokens, CAST(sum(k * 3) AS BIGINT) AS total_tokens,
 CAST(sum(cents) AS BIGINT) AS input_cost_microcents, CAST(sum(cents) AS BIGINT) AS output_cost_microcents, CAST(sum(cents * 2) AS BIGINT) AS total_cost_microcents,
 {', '.join(f'{_HALF(e, 8)} AS {n}' for n, e in _AVERAGES.items())},
 count(*) FILTER (status >= 200 AND status < 400) AS success_count, count(*) FILTER (status >= 400) AS error_count, count(*) AS sample_count
FROM r {BY_SETS}
"""
EXACT_PERCENTILES = f"WITH {_REQUESTS} SELECT {SET_KEYS}, {', '.join(f'{_HALF(_AVERAGES[n], 8)} AS {n}' for n in rollup.PERCENTILES)} FROM r {BY_SETS}"
RANKS = f"WITH {_REQUESTS} SELECT {SET_KEYS}, {', '.join(f'true AS {n}_ok' for n in rollup.PERCENTILES)} FROM r {BY_SETS}"


def all_tier_synthesis(spark, sf_dir):
    rows = requests(spark, sf_dir).groupBy(dates.day_key(F.col("event_time")).alias("period_key"), "tier", "model").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("session").alias("sessions"), F.sum("tokens_total").alias("total_tokens"), numbers.half_up(F.avg("duration_ms"), 8).alias("avg_duration_ms"), numbers.half_up(F.percentile("duration_ms", 0.5), 8).alias("p50_duration_ms"))
    return rollup.with_all_tier(rows, ["period_key", "tier", "model"], added=("requests", "sessions", "total_tokens"), averaged=("avg_duration_ms",), percentiles=("p50_duration_ms",))


ALL_TIER = f"""
WITH {_REQUESTS}, a AS (SELECT day_key AS period_key, tier, model, count(*) AS requests, count(DISTINCT session) AS sessions, CAST(sum(k * 3) AS BIGINT) AS total_tokens, {_HALF('avg(duration_ms)', 8)} AS avg_duration_ms, {_HALF('quantile_cont(duration_ms, 0.5)', 8)} AS p50_duration_ms FROM r GROUP BY 1, 2, 3)
SELECT * FROM a UNION ALL SELECT period_key, 'all', model, CAST(sum(requests) AS BIGINT), CAST(sum(sessions) AS BIGINT), CAST(sum(total_tokens) AS BIGINT),
 CASE WHEN count(*) = 1 THEN max(avg_duration_ms) ELSE {_HALF('(CAST(sum(CAST(avg_duration_ms * requests AS DECIMAL(28,8))) AS DOUBLE) / sum(requests))', 2)} END, CASE WHEN count(*) = 1 THEN max(p50_duration_ms) END FROM a GROUP BY 1, 3
"""


def conditional_counts_daily(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(dates.day_key(F.col("ts")).alias("day")).agg(F.count_if(t == "purchase").alias("purchases"), F.count_if(t == "error").alias("errors"), F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.when(t == "purchase", F.floor(F.col("value") * 100 + 0.5))), F.lit(0)).alias("purchase_cents"))


CONDITIONAL = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors, count(*) AS total, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 100 + 0.5) AS BIGINT) END), 0) AS BIGINT) AS purchase_cents FROM events GROUP BY 1"


def usage_daily_total(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("date", dates.day_key(F.col("ts")))
    return analytics.with_total(rows, "date", {"requests": F.count(F.lit(1)), "users": F.count_distinct("user_id"), "cents": F.sum(F.floor(F.col("value") * 100 + 0.5))})


USAGE_TOTAL = "SELECT CASE WHEN grouping(d) = 1 THEN 'TOTAL' ELSE d END AS date, count(*) AS requests, count(DISTINCT user_id) AS users, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS d FROM events) GROUP BY ROLLUP (d)"


def exact_percentiles_by_type(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.median("value").alias("median")), "p50", "p95", "median")


PERCENTILES = f"SELECT event_type, {_HALF('quantile_cont(value, 0.5)', 4)} AS p50, {_HALF('quantile_cont(value, 0.95)', 4)} AS p95, {_HALF('median(value)', 4)} AS median FROM events GROUP BY 1"


def approx_percentiles_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95], 10000).alias("p")).select("event_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def distinct_users_week(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(dates.iso_week_id(F.col("ts")).alias("week")).agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"))


USERS_WEEK = "SELECT strftime(ts, '%G-W%V') AS week, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events GROUP BY 1"


def json_path_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("user_id").alias("max_user"))


JSON_GROUPS = "SELECT props->>'$.k' AS k, count(*) AS n, max(user_id) AS max_user FROM events GROUP BY 1"


def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    return analytics.latest(rows, ["user_id"], ["at", "event_id"])


LATEST = "SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def lag_delta(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", dates.day_key(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("change", analytics.change("n", ["event_type"], "day"))


LAG = "SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def _daily_cents(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", dates.day_key(F.col("ts")).alias("day")).agg(F.sum(F.floor(F.col("value") * 100 + 0.5)).alias("cents"))


_DAILY = "d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2)"


def running_sum(spark, sf_dir):
    return _daily_cents(spark, sf_dir).withColumn("spent", analytics.running_sum(F.col("cents"), ["event_type"], "day"))


RUNNING = f"WITH {_DAILY} SELECT *, CAST(sum(cents) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM d"


def running_sum_exclusive(spark, sf_dir):
    return _daily_cents(spark, sf_dir).withColumn("budget_left", analytics.effective_budget(F.lit(100_000).cast("long"), F.col("cents"), ["event_type"], "day"))


RUNNING_EXCLUSIVE = f"WITH {_DAILY} SELECT *, CAST(greatest(0, 100000 - coalesce(sum(cents) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS budget_left FROM d"


def budget_priorities(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type", (F.pmod("user_id", F.lit(4)) + 1).cast("int").alias("priority")).agg(F.sum(F.when(F.dayofmonth("ts") > 15, F.floor(F.col("value") * 100 + 0.5)).otherwise(0)).alias("now_cents"), F.sum(F.when(F.dayofmonth("ts") <= 15, F.floor(F.col("value") * 100 + 0.5)).otherwise(0)).alias("before_cents"))
    return analytics.budget_by_priority(rows.withColumn("budget", F.lit(3_000_000).cast("long")), "event_type", "budget", "now_cents", "before_cents")


BUDGETS = """
WITH d AS (SELECT event_type, CAST(user_id % 4 + 1 AS INTEGER) AS priority, CAST(sum(CASE WHEN day(ts) > 15 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS now_cents, CAST(sum(CASE WHEN day(ts) <= 15 THEN CAST(floor(value * 100 + 0.5) AS BIGINT) ELSE 0 END) AS BIGINT) AS before_cents, CAST(3000000 AS BIGINT) AS budget FROM events GROUP BY 1, 2),
w AS (SELECT *, CAST(greatest(0, budget - coalesce(sum(before_cents) OVER e, 0)) AS BIGINT) AS effective_budget, CAST(sum(now_cents) OVER i AS BIGINT) AS spent_through, CAST(sum(before_cents) OVER i AS BIGINT) AS previous_through FROM d
 WINDOW e AS (PARTITION BY event_type ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i AS (PARTITION BY event_type ORDER BY priority ROWS UNBOUNDED PRECEDING))
SELECT *, priority <= 1 OR spent_through < effective_budget AS qualifies, previous_through < budget * 0.8 AS preferred FROM w
"""


def _times(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


def tumbling_minute_counts(spark, sf_dir):
    return _times(counters.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "1 minute", {"n": F.count(F.lit(1)), "users": F.count_distinct("user_id")}), "window_start")


TUMBLING = "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"


def sliding_two_minute(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return _times(counters.sliding(rows, "ts", ["event_type"], "2 minutes", "1 minute", {"qualified": F.count_if("ok"), "unqualified": F.count_if(~F.col("ok"))}), "window_start", "window_end")


SLIDING = "SELECT strftime(date_trunc('minute', ts) - to_minutes(i), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('minute', ts) - to_minutes(i) + INTERVAL 2 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, count(*) FILTER (event_type <> 'error') AS qualified, count(*) FILTER (event_type = 'error') AS unqualified FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY 1, 2, 3"


def _hourly(spark, sf_dir):
    return counters.tumbling(table(spark, sf_dir, "events"), "ts", [], "6 hours", {"failed": F.count_if(F.col("event_type") == "error"), "total": F.count(F.lit(1))})


_SIX = "w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS window_start, count(*) FILTER (event_type = 'error') AS failed, count(*) AS total FROM events GROUP BY 1)"
_GATED = "g AS (SELECT *, CASE WHEN total >= 20 THEN failed / total ELSE 0.0 END AS ratio, CASE WHEN total >= 20 THEN failed / total ELSE 0.0 END >= 0.2 AS triggered FROM w)"


def alert_ratio_gated(spark, sf_dir):
    return rounded(_times(counters.gated(_hourly(spark, sf_dir), "failed", "total", 20, 0.2), "window_start"), "ratio", places=6)


RATIO_GATED = f"WITH {_SIX}, {_GATED} SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, failed, total, {_HALF('ratio', 6)} AS ratio, triggered FROM g"


def alert_on_change(spark, sf_dir):
    return _times(counters.on_change(counters.gated(_hourly(spark, sf_dir), "failed", "total", 20, 0.2), [], "window_start"), "window_start").select("window_start", "failed", "total", "triggered")


ON_CHANGE = f"WITH {_SIX}, {_GATED} SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, failed, total, triggered FROM g QUALIFY triggered <> coalesce(lag(triggered) OVER (ORDER BY g.window_start), false)"


def alert_day_over_day(spark, sf_dir):
    hours = counters.sliding(table(spark, sf_dir, "events"), "ts", ["event_type"], "60 minutes", "15 minutes", {"n": F.count(F.lit(1))}).drop("window_end")
    return rounded(_times(counters.day_over_day(hours, "n", ["event_type"]), "window_start"), "drop_percent")


DAY_OVER_DAY = f"""
WITH h AS (SELECT time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '2024-01-01') - to_minutes(i) AS ws, event_type, count(*) AS n FROM events, (SELECT unnest([0, 15, 30, 45]) AS i) GROUP BY 1, 2)
SELECT strftime(a.ws, '%Y-%m-%d %H:%M:%S') AS window_start, a.event_type, a.n, b.n AS before, {_HALF('((b.n - a.n) / b.n * 100)', 4)} AS drop_percent, (b.n - a.n) / b.n * 100 >= 50 AS triggered FROM h a JOIN h b ON a.event_type = b.event_type AND a.ws = b.ws + INTERVAL 1 DAY
"""


def frecency_top(spark, sf_dir):
    use = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last"))
    scored = use.withColumn("score", numbers.half_up(search.frecency(F.col("uses"), F.col("last"), F.lit("2024-02-01").cast("timestamp")), 6))
    return scored.orderBy(F.col("score").desc(), "user_id").limit(50).select("user_id", "uses", "score")


FRECENCY = "SELECT user_id, count(*) AS uses, floor(count(*) / (1 + (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(ts))) / 86400000000) * 1000000 + 0.5) / 1000000 AS score FROM events GROUP BY 1 ORDER BY score DESC, user_id LIMIT 50"


def _log(spark, sf_dir):
    """The events as a log of each user."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("aggregate_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("data"))


_LOG = "l AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS aggregate_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type AS type, props AS data FROM events)"


def event_replay_verdicts(spark, sf_dir):
    """The last events of each user replayed: unchanged, changed, following, and after a gap."""
    log = _log(spark, sf_dir)
    kind = F.pmod(F.col("id").cast("long"), F.lit(4))
    last = analytics.latest(log, ["aggregate_id"], ["seq"])
    batch = last.select("id", "aggregate_id", F.when(kind == 2, F.col("seq") + 1).when(kind == 3, F.col("seq") + 2).otherwise(F.col("seq")).alias("seq"), "type", F.when(kind == 1, F.lit("{}")).otherwise(F.col("data")).alias("data"))
    return eventlog.incoming(log, batch).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


REPLAY = f"WITH {_LOG}, h AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC) = 1) SELECT CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'replay' WHEN 1 THEN 'divergent' WHEN 2 THEN 'append' ELSE 'gap' END AS verdict, count(*) AS n, CAST(sum(seq + CASE CAST(id AS BIGINT) % 4 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END) AS BIGINT) AS seqs FROM h GROUP BY 1"


def event_projection(spark, sf_dir):
    """A row for each user: the last amounts by type; users whose last event is an error are gone."""
    k = F.get_json_object("data", "$.k")
    fields = {f"last_{t}": F.when(F.col("type") == t, k) for t in ("view", "click", "purchase")}
    return eventlog.project(_log(spark, sf_dir), "aggregate_id", ["error"], fields)


PROJECTION = f"WITH {_LOG} SELECT aggregate_id, max(seq) AS seq, " + ", ".join(f"arg_max(data->>'$.k', seq) FILTER (type = '{t}') AS last_{t}" for t in ("view", "click", "purchase")) + " FROM l GROUP BY 1 HAVING arg_max(type, seq) <> 'error'"


def read_after_cursor(spark, sf_dir):
    return eventlog.read_after(_log(spark, sf_dir), "7", after=1, limit=5)


READ_AFTER = f"WITH {_LOG}, m AS (SELECT * FROM l WHERE aggregate_id = '7' AND seq > 1 ORDER BY seq LIMIT 6) SELECT *, (SELECT count(*) > 5 FROM m) AS has_more FROM m ORDER BY seq LIMIT 5"


def snapshot_replay(spark, sf_dir):
    log = _log(spark, sf_dir)
    snapshot = eventlog.compacted(log.filter("seq < 3"), ["aggregate_id"])
    return eventlog.snapshot_and_log(snapshot, log.filter("seq >= 3"), ["aggregate_id"])


SNAPSHOT = f"WITH {_LOG} SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY aggregate_id ORDER BY seq DESC) = 1"


def usage_delta(spark, sf_dir):
    """Signed changes: each event type is a message whose tokens replace its earlier ones."""
    rows = _log(spark, sf_dir).select(F.col("aggregate_id").alias("session_id"), F.col("type").alias("message_id"), "seq", F.get_json_object("data", "$.k").cast("long").alias("tokens"))
    return sessions.usage_delta(rows)


USAGE_DELTA = f"WITH {_LOG}, m AS (SELECT aggregate_id AS session_id, type, arg_max(CAST(data->>'$.k' AS BIGINT), seq) AS tokens FROM l GROUP BY 1, 2) SELECT session_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY 1"


QUERIES = {
    "stats_rollup": (stats_rollup, STATS_ROLLUP), "rollup_exact_percentiles": (rollup_exact_percentiles, EXACT_PERCENTILES), "rollup_percentile_ranks": (rollup_percentile_ranks, RANKS), "all_tier_synthesis": (all_tier_synthesis, ALL_TIER), "conditional_counts_daily": (conditional_counts_daily, CONDITIONAL), "usage_daily_total": (usage_daily_total, USAGE_TOTAL),
    "exact_percentiles_by_type": (exact_percentiles_by_type, PERCENTILES), "approx_percentiles_by_type": (approx_percentiles_by_type, None), "distinct_users_week": (distinct_users_week, USERS_WEEK), "json_path_groups": (json_path_groups, JSON_GROUPS),
    "latest_per_key": (latest_per_key, LATEST), "lag_delta": (lag_delta, LAG), "running_sum": (running_sum, RUNNING), "running_sum_exclusive": (running_sum_exclusive, RUNNING_EXCLUSIVE), "budget_priorities": (budget_priorities, BUDGETS),
    "tumbling_minute_counts": (tumbling_minute_counts, TUMBLING), "sliding_two_minute": (sliding_two_minute, SLIDING), "alert_ratio_gated": (alert_ratio_gated, RATIO_GATED), "alert_on_change": (alert_on_change, ON_CHANGE), "alert_day_over_day": (alert_day_over_day, DAY_OVER_DAY),
    "frecency_top": (frecency_top, FRECENCY), "event_replay_verdicts": (event_replay_verdicts, REPLAY), "event_projection": (event_projection, PROJECTION), "read_after_cursor": (read_after_cursor, READ_AFTER), "snapshot_replay": (snapshot_replay, SNAPSHOT), "usage_delta": (usage_delta, USAGE_DELTA),
}
