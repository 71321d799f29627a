"""Session statistics, context slices, shares and compaction over event-sourced sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analytics import latest

MESSAGE = "role string, cost double, modelID string, providerID string, tokens struct<input:bigint,output:bigint,reasoning:bigint,cache:struct<read:bigint,write:bigint>>"
PART = "type string, tool string"


def message_facts(messages: DataFrame) -> DataFrame:
    """session_id, role, cost and token counts from each message's JSON, absent numbers as 0."""
    m = F.from_json("data", MESSAGE)
    n = lambda c: F.coalesce(c, F.lit(0))
    return messages.select("id", "session_id", m.alias("m")).select(
        "id", "session_id", F.col("m.role").alias("role"), n(F.col("m.cost")).alias("cost"), F.concat_ws("/", "m.providerID", "m.modelID").alias("model"),
        n(F.col("m.tokens.input")).alias("input"), n(F.col("m.tokens.output")).alias("output"), n(F.col("m.tokens.reasoning")).alias("reasoning"), n(F.col("m.tokens.cache.read")).alias("cache_read"), n(F.col("m.tokens.cache.write")).alias("cache_write"),
    )


def totals(facts: DataFrame) -> DataFrame:
    """Over all sessions: counts, cost, tokens, and mean and median tokens of a session."""
    tokens = sum((F.col(k) for k in ("input", "output", "reasoning", "cache_read", "cache_write")), F.lit(0))
    own = facts.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.sum("cost").alias("cost"), F.sum(tokens).alias("tokens"))
    return own.agg(F.count(F.lit(1)).alias("sessions"), F.sum("messages").alias("messages"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.avg("tokens").alias("mean_tokens"), F.median("tokens").alias("median_tokens"))


def tool_counts(parts: DataFrame) -> DataFrame:
    p = F.from_json("data", PART)
    return parts.select(p.alias("p")).filter("p.type = 'tool'").groupBy(F.col("p.tool").alias("tool")).count().orderBy(F.col("count").desc(), "tool")


def model_usage(facts: DataFrame) -> DataFrame:
    own = facts.filter(F.col("role") == "assistant")
    return own.groupBy("model").agg(F.count(F.lit(1)).alias("messages"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("cost")).orderBy(F.col("messages").desc(), "model")


def context_slice(messages: DataFrame, baseline: str | None = None) -> DataFrame:
    """Of each session what a model sees: rows from the last compaction on; system rows only if they come after the baseline column's number."""
    session = Window.partitionBy("session_id")
    start = F.coalesce(F.max(F.when(F.col("type") == "compaction", F.col("seq"))).over(session), F.lit(-1))
    own = messages.withColumn("__start", start)
    system = F.col("type") == "system"
    late = F.col("seq") > F.coalesce(F.col(baseline), F.lit(-1)) if baseline else F.lit(False)
    return own.filter((~system & (F.col("seq") >= F.col("__start"))) | (system & late)).drop("__start")


def pending(inbox: DataFrame, cutoff: Column, kind: str, limit: int | None = None) -> DataFrame:
    """Unpromoted entries of a kind up to a sequence number, first in first out."""
    out = inbox.filter(F.col("promoted_seq").isNull() & (F.col("kind") == kind) & (F.col("seq") <= cutoff)).orderBy("seq")
    return out if limit is None else out.limit(limit)


def share_state(items: DataFrame, order: str = "batch") -> DataFrame:
    """The last version of each shared item: by type and id, session, message and part each by their own id, others by type."""
    ident = F.coalesce(F.get_json_object("data", "$.id"), F.lit(""))
    return latest(items.withColumn("item_id", ident), ["type", "item_id"], [order])


def redacted(sessions: DataFrame, columns: list[str], mask: str = "[redacted]") -> DataFrame:
    """Texts that identify a user, masked; nulls stay null."""
    return sessions.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mask)) for c in columns})


def usage_delta(events: DataFrame) -> DataFrame:
    """Running totals of sessions from signed changes: a replaced message takes its old usage back."""
    order = Window.partitionBy("session_id", "message_id").orderBy("seq")
    value = F.col("tokens") - F.coalesce(F.lag("tokens").over(order), F.lit(0))
    return events.withColumn("delta", value).groupBy("session_id").agg(F.sum("delta").alias("tokens"))
