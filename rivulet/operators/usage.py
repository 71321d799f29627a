"""Billing and usage reports, and the status of usage windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers
from .analytics import with_total


def plan_of(enrichment: Column) -> Column:
    return F.get_json_object(enrichment, "$.plan")


def daily(usage: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """Requests, tokens and cost of each of the last days, split by plan, and a TOTAL row."""
    plan = plan_of(F.col("enrichment"))
    recent = usage.filter(F.col("time_created") >= as_of - F.expr(f"INTERVAL {days} DAYS")).withColumn("date", dates.day_key(F.col("time_created"))).withColumn("__plan", plan)
    of = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    p = F.col("__plan")
    api = p.isNull() | ~p.isin("sub", "lite", "byok")
    tokens = sum((F.coalesce(F.col(f"{k}_tokens"), F.lit(0)) for k in ("input", "output", "reasoning", "cache_read", "cache_write_5m", "cache_write_1h")), F.lit(0))
    return with_total(recent, "date", {
        "requests": F.count(F.lit(1)), "tokens": F.sum(tokens), "sub_cost": of(p == "sub", F.col("cost")), "lite_cost": of(p == "lite", F.col("cost")), "api_cost": of(api, F.col("cost")), "byok_requests": F.count_if(p == "byok"),
    })


def weekly_spend(usage: DataFrame, subscribers: DataFrame) -> DataFrame:
    """Cost by workspace and ISO week of rows outside subscriptions, for workspaces that subscribe (a semi-join)."""
    plan = plan_of(F.col("enrichment"))
    own = usage.filter(plan.isNull() | (plan != "sub")).join(subscribers.select("workspace_id").distinct(), "workspace_id", "left_semi")
    return own.groupBy("workspace_id", dates.iso_week_number(F.col("time_created")).alias("week")).agg(F.sum("cost").alias("cost"))


def top_models(usage: DataFrame, k: int = 3) -> DataFrame:
    """The k costliest models of each workspace with their percentage of its cost."""
    by = usage.groupBy("workspace_id", "model").agg(F.sum("cost").alias("cost"))
    whole = Window.partitionBy("workspace_id")
    ranked = by.withColumns({"rank": F.row_number().over(whole.orderBy(F.col("cost").desc(), "model")), "total": F.sum("cost").over(whole)}).filter(F.col("rank") <= k)
    return ranked.select("workspace_id", "rank", "model", "cost", F.when(F.col("total") > 0, numbers.half_up(F.col("cost") / F.col("total") * 100, 1)).alias("percent"))


def cost_graph(usage: DataFrame, offset: str) -> DataFrame:
    """Cost by day at a fixed offset, model and key."""
    return usage.groupBy(dates.shifted_day(F.col("time_created"), offset).alias("date"), "model", "key_id").agg(F.sum("cost").alias("cost"))


def _status(usage: Column, limit_dollars: Column, fresh: Column, reset: Column, idle_reset: Column) -> Column:
    limit = numbers.cents_to_micro(limit_dollars * 100)
    over = fresh & (usage >= limit)
    percent = F.when(~fresh, 0).when(over, 100).otherwise(numbers.percent_used(usage, limit))
    return F.struct(F.when(over, "rate-limited").otherwise("ok").alias("status"), F.when(fresh, reset).otherwise(idle_reset).cast("long").alias("reset_in_sec"), percent.cast("int").alias("usage_percent"))


def _until(end: Column, now: Column) -> Column:
    return F.ceil((F.unix_micros(end.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6)


def rolling_status(usage: Column, updated: Column, limit_dollars: Column, hours: int, now: Column) -> Column:
    """A window that starts with its last update; it is empty once that is longer ago than its length."""
    length = F.expr(f"INTERVAL {hours} HOURS")
    return _status(usage, limit_dollars, updated >= now - length, _until(updated + length, now), F.lit(hours * 3600))


def weekly_status(usage: Column, updated: Column, limit_dollars: Column, now: Column) -> Column:
    reset = _until(dates.week_end(now), now)
    return _status(usage, limit_dollars, updated >= dates.week_start(now), reset, reset)


def monthly_status(usage: Column, updated: Column, subscribed: Column, limit_dollars: Column, now: Column) -> Column:
    reset = _until(dates.month_end(now, subscribed), now)
    return _status(usage, limit_dollars, updated >= dates.month_start(now, subscribed), reset, reset)
