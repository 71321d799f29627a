"""Findings: levels by category, overall risk, impact chains, relevance to an objective, triggers, affected interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import severity

# Categories of each type of finding, weights of categories, values of levels, and which reasons of a
# hotspot matter to which kind of task.
CATEGORIES = {
    "security_pattern": ("security",), "architecture_violation": ("architecture",), "circular_dependency": ("architecture",), "coupling_issue": ("maintainability",),
    "complexity_issue": ("maintainability", "reliability"), "dependency_issue": ("reliability",), "missing_symbol": ("reliability",), "dead_code": ("maintainability",),
}
WEIGHTS = {"security": 0.35, "architecture": 0.25, "reliability": 0.20, "maintainability": 0.15, "performance": 0.05}
LEVELS = ("none", "low", "medium", "high", "critical")
TASK_REASONS = {
    "bug_fix": ("circular_dependency", "high_coupling", "high_complexity"), "refactor": ("high_coupling", "high_complexity", "god_object"), "security_audit": ("god_object", "high_coupling"),
    "feature": ("circular_dependency", "high_coupling"), "architecture_review": ("high_coupling", "deep_inheritance", "god_object", "circular_dependency"), "general": (),
}


def category_levels(findings: DataFrame, hotspots: DataFrame) -> DataFrame:
    """category, level, findings and the ids of the three worst, for each category; one with a god object's category is a level up.

    Any critical finding makes a category critical; else it is high if high findings outnumber medium ones, medium if
    those outnumber low ones, and low otherwise. Severities are counted, so no category's findings are gathered; the
    three worst are a top-k by group.
    """
    spark = findings.sparkSession
    kinds = spark.createDataFrame([(t, c) for t, cs in CATEGORIES.items() for c in cs], "type string, category string")
    own = findings.select("id", "type", "severity").join(F.broadcast(kinds), "type")  # nine rows
    n = lambda *s: F.count_if(F.col("severity").isin(*s))
    level = F.when(n("critical") > 0, "critical").when(n("high") > n("medium"), "high").when(n("medium") > n("low", "info"), "medium").otherwise("low")
    counted = own.groupBy("category").agg(level.alias("level"), F.count(F.lit(1)).alias("findings"))
    order = Window.partitionBy("category").orderBy(severity(F.col("severity")).desc(), "id")
    worst = own.withColumn("no", F.row_number().over(order)).filter("no <= 3").groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "id"))), lambda x: x["id"]).alias("top_ids"))
    everything = spark.createDataFrame([(c,) for c in WEIGHTS], "category string")
    god = hotspots.agg(F.coalesce(F.bool_or(F.array_contains("reasons", "god_object")), F.lit(False)).alias("__god"))
    out = everything.join(counted, "category", "left").join(worst, "category", "left").join(god)  # god: one row
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce("level", F.lit("none")))
    raised = F.least(F.lit(len(LEVELS)), place + (F.col("__god") & F.col("category").isin("architecture", "maintainability")).cast("int"))
    return out.select("category", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), raised.cast("int")).alias("level"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("top_ids", F.array().cast("array<string>")).alias("top_ids"))


def overall_risk(levels: DataFrame) -> DataFrame:
    """One row: the weighted sum of the levels' values (a quarter a step), two places."""
    value = (F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")) - 1) * 0.25
    weight = F.create_map(*[F.lit(x) for k, w in WEIGHTS.items() for x in (k, w)])[F.col("category")]
    return levels.agg((F.floor(F.sum(value * weight) * 100 + F.lit(0.5) + F.lit(1e-9)) / 100).alias("overall_risk"))


def chains(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(root_id, confidence: the mean of its pairs', four places; chain steps in order of path length) of :func:`graph.root_causes`."""
    order = Window.partitionBy("root_id").orderBy("path_length", "related_id")
    steps = pairs.withColumn("step", F.row_number().over(order)).select("root_id", "step", F.col("related_id").alias("finding_id"), "path_length")
    heads = pairs.groupBy("root_id").agg((F.floor(F.avg("confidence") * 10000 + 0.5) / 10000).alias("confidence"), F.count_distinct("related_id").alias("related"))
    return heads, steps


def relevance(hotspots: DataFrame, mentioned: list[str], task: str) -> DataFrame:
    """Hotspots by relevance: named in the objective 0.3, a reason that matters to the task 0.2, half the score; 1 at most."""
    named = F.lower("path").isin(*[m.lower() for m in mentioned]) if mentioned else F.lit(False)
    reasons = TASK_REASONS.get(task, ())
    aligned = F.coalesce(F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in reasons])), F.lit(False)) if reasons else F.lit(False)
    score = F.least(F.lit(1.0), F.when(named, 0.3).otherwise(0.0) + F.when(aligned, 0.2).otherwise(0.0) + F.col("score") * 0.5)
    return hotspots.withColumn("relevance", score).orderBy(F.col("relevance").desc(), "path")


def triggers(hotspots: DataFrame, entry_points: DataFrame, findings: DataFrame) -> DataFrame:
    """Files whose change is worth following: risky hotspots, entry points, files on a cycle."""
    risky = hotspots.filter(F.col("risk_level").isin("critical", "high")).select(F.col("path").alias("file"))
    cyclic = findings.filter("type = 'circular_dependency'").select("file")
    return risky.unionByName(entry_points.select("file")).unionByName(cyclic).distinct()


def api_impacts(impacts: DataFrame, routes: DataFrame, handlers: DataFrame) -> DataFrame:
    """Endpoints that a trigger affects: breaking if the trigger is the route itself or an interface, else by whether the route is direct (depth 1).

    ``impacts``: trigger, file, depth, is_interface; ``routes``: file; ``handlers``: file, name of exported functions.
    """
    first = handlers.groupBy("file").agg(F.min("name").alias("__name"))
    own = impacts.select("trigger", "is_interface", F.col("trigger").alias("file"), F.lit(0).alias("depth")).distinct().unionByName(impacts.select("trigger", "is_interface", "file", "depth"))
    hit = own.join(routes.select("file").distinct(), "file").join(first, "file", "left")
    level: Column = F.when((F.col("depth") == 0) | F.col("is_interface"), "breaking").when(F.col("depth") == 1, "non_breaking").otherwise("unknown")
    return hit.select("trigger", F.coalesce(F.concat(F.col("file"), F.lit("::"), F.col("__name")), F.col("file")).alias("endpoint"), level.alias("impact_level"))
