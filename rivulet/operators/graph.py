"""Dependency graphs as two tables: nodes (id, kind, file, ...) and edges (from, to, kind).

Traversals are rounds of joins from a frontier; each round keeps new nodes only, so its cost is that of the edges that
leave the frontier. Each round is a written table. Cycles and orders of whole graphs are in :mod:`cycles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import cycles

# Confidence that a change reaches a file, by its distance in steps (1 to 5); limits of a file that knows too
# much (symbols, ways in, ways out); least scores of risk levels; weights of a hotspot's and of a risk's parts; what a step of
# a path takes from a cause's confidence, what compatible types and a hotspot add, and the least that counts; levels of
# severity; lines between duplicates; depth from which a finding is derived, chains from which it is redundant.
DEPTH_CONFIDENCE = (1.0, 0.9, 0.75, 0.6, 0.45)
MOST_SYMBOLS, MOST_IN, MOST_OUT = 5, 5, 8
RISK_LEVELS = (("critical", 0.55), ("high", 0.30), ("medium", 0.15))
IMPORT_FACTOR = 1.5
HOTSPOT = {"coupling": 0.40, "size": 0.15, "methods": 0.10, "violation": 0.2, "god": 0.30, "cycle": 0.35, "most_cycles": 0.50, "repository": 0.25}
REPOSITORY_METHODS = 3
RISK = {"hotspot": 0.4, "spread": 0.25, "modules": 0.2, "services": 0.1, "interfaces": 0.1 * 0.05, "unknown_hotspot": 0.5, "files": 50}
SMALL_MODULE = 3
CAUSE = {"step": 0.1, "compatible": 0.2, "hotspot": 0.1, "least": 0.6, "depth": 6}
SEVERITY = ("info", "low", "medium", "high", "critical")
NEAR_LINES, DERIVED_DEPTH, REDUNDANT_CHAINS = 20, 3, 2


def adjacency(edges: DataFrame, kinds: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """Distinct (src, dst), of some kinds of edge, turned round if ``reverse``."""
    own = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    a, b = ("to", "from") if reverse else ("from", "to")
    return own.select(F.col(f"`{a}`").alias("src"), F.col(f"`{b}`").alias("dst")).distinct()


def reach(adj: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(origin, node, depth): the least number of steps, 1 to ``depth``, from each origin (column ``origin``) to the nodes that it reaches."""
    seen = starts.select("origin", F.col("origin").alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select("origin", F.col("node").alias("src")).join(adj, "src").select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def shortest_paths(adj: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(origin, node, length, path): of equally short paths the first in order of its nodes."""
    seen = starts.select("origin", F.col("origin").alias("node"), F.array("origin").alias("path"))
    frontier = seen
    for _ in range(depth):
        step = frontier.select("origin", F.col("node").alias("src"), "path").join(adj, "src").select("origin", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        new = step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").groupBy("origin", "node").agg(F.min("path").alias("path"))
        frontier = cut(new)
        seen = seen.unionByName(frontier)
    return seen.select("origin", "node", (F.size("path") - 1).alias("length"), "path")


def impact(nodes: DataFrame, edges: DataFrame, triggers: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Files that depend on each trigger file: least depth (up to 5) and the confidence of that depth."""
    files = nodes.select(F.col("id").alias("node"), "file")
    origin = triggers.join(files, "file").select(F.col("node").alias("origin"), F.col("file").alias("trigger"))
    found = reach(adjacency(edges, kinds, reverse=True), origin.select("origin").distinct(), len(DEPTH_CONFIDENCE))
    by_file = found.join(files, "node").join(origin, "origin").filter("file <> trigger").groupBy("trigger", "file").agg(F.min("depth").alias("depth"))
    return by_file.withColumn("confidence", F.element_at(F.array(*[F.lit(x) for x in DEPTH_CONFIDENCE]), F.col("depth")))


def fan(nodes: DataFrame, edges: DataFrame, skip: tuple[str, ...] = ("method",)) -> DataFrame:
    """fan_in and fan_out of each file: edges from and to other files."""
    files = nodes.select("id", "file")
    own = edges.filter(~F.col("kind").isin(*skip)) if skip else edges
    placed = own.join(files.select(F.col("id").alias("from"), F.col("file").alias("a")), "from").join(files.select(F.col("id").alias("to"), F.col("file").alias("b")), "to").filter("a <> b")
    ends = placed.select(F.explode(F.array(F.struct(F.col("a").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("b").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.file").alias("file")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "class")) -> DataFrame:
    """Nodes of some kinds that nothing points to, that are neither exported nor entry points."""
    own = nodes.filter(F.col("kind").isin(*kinds) & ~F.coalesce("is_exported", F.lit(False)) & ~F.coalesce("is_entry_point", F.lit(False)))
    return own.join(edges.select(F.col("to").alias("id")), "id", "left_anti")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose target is no node."""
    return edges.join(nodes.select(F.col("id").alias("to")), "to", "left_anti")


def on_cycles(adj: DataFrame, depth: int) -> DataFrame:
    """Nodes that reach themselves within so many steps, with the least number."""
    starts = adj.select(F.col("src").alias("origin")).distinct()
    first = starts.select("origin", F.col("origin").alias("src")).join(adj, "src").select("origin", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct()
    seen = frontier = first
    for d in range(2, depth + 1):
        step = frontier.select("origin", F.col("node").alias("src")).join(adj, "src").select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.select("origin", "node"), ["origin", "node"], "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen.filter("origin = node").select(F.col("origin").alias("node"), "depth")


def _within(edges: DataFrame, graph: str) -> DataFrame:
    """(src, dst) of a table of several graphs: nodes are told apart by their graph."""
    node = lambda c: F.struct(F.col(graph).alias("graph"), F.col(f"`{c}`").alias("node"))
    return edges.dropna(subset=[graph, "from", "to"]).select(node("from").alias("src"), node("to").alias("dst"))


def cycle_paths(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, cycle): a shortest cycle through the smallest node of each strongly connected component of each graph (columns graph, from, to)."""
    own = _within(edges, graph)
    found = cycles.component_cycles(own, cycles.components(own))
    return found.select(F.col("component.graph").alias(graph), F.transform("cycle", lambda n: n["node"]).alias("cycle"))


def topological(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, node, position, is_cyclic) of each graph: by the longest chain before a node, then by name; what is on or behind a cycle comes last."""
    own = _within(edges, graph)
    nodes = own.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    levels = cycles.topological_order(nodes, own.select(F.col("dst").alias("node"), F.col("src").alias("needs")), []).select("node", "level")
    placed = nodes.join(levels, "node", "left").select(F.col("node.graph").alias(graph), F.col("node.node").alias("node"), F.col("level").isNull().alias("is_cyclic"), F.coalesce("level", F.lit(0)).alias("level"))
    placed = cycles.numbered(placed, [graph, "is_cyclic", "level", "node"], "__no")
    first = placed.groupBy(F.col(graph).alias("__graph")).agg(F.min("__no").alias("__first"))
    return placed.join(first, F.col(graph) == F.col("__graph")).select(graph, "node", (F.col("__no") - F.col("__first")).alias("position"), "is_cyclic")


def god_objects(nodes: DataFrame, coupling: DataFrame, roles: DataFrame, most_nodes: int = MOST_SYMBOLS, most_in: int = MOST_IN, most_out: int = MOST_OUT) -> DataFrame:
    """Files, no tests, with more symbols than a limit, and more ways in or out than another."""
    own = nodes.filter(F.col("kind").isin("function", "method", "class")).groupBy("file").agg(F.count(F.lit(1)).alias("symbols")).filter(F.col("symbols") > most_nodes)
    coupled = own.join(coupling, "file").filter((F.col("fan_in") > most_in) | (F.col("fan_out") > most_out))
    return coupled.join(roles.filter("role = 'test'"), "file", "left_anti").select("file", "symbols", "fan_in", "fan_out")


def risk_level(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= least, level) for level, least in RISK_LEVELS], F.lit("low"))


def hotspots(files: DataFrame) -> DataFrame:
    """Score of each file from fan_in, fan_out, loc, methods, violations, is_god, cycles.

    Coupling (an import counts one and a half times), size and methods are shares of their maxima; violations, cycles,
    god objects and repositories that others use add fixed amounts. Files without any sign are left out.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(0))
    coupling = c("fan_in") * IMPORT_FACTOR + c("fan_out")
    top = files.agg(F.max(coupling).alias("__c"), F.max(c("loc")).alias("__l"), F.greatest(F.lit(1), F.max(c("methods"))).alias("__m"))
    share = lambda v, m: F.when(F.col(m) > 0, v / F.col(m)).otherwise(F.lit(0.0))
    god = F.coalesce("is_god", F.lit(False))
    repository = F.lower("file").contains("repository") | F.col("file").contains("/repositories/")
    signs = (coupling > 0) | (c("loc") > 0) | (c("violations") > 0) | god | (c("cycles") > 0)
    score = (
        share(coupling, "__c") * HOTSPOT["coupling"] + share(c("loc"), "__l") * HOTSPOT["size"] + share(c("methods"), "__m") * HOTSPOT["methods"] + c("violations") * HOTSPOT["violation"]
        + F.when(god, HOTSPOT["god"]).otherwise(0.0) + F.least(F.lit(HOTSPOT["most_cycles"]), c("cycles") * HOTSPOT["cycle"])
        + F.when(repository & (c("methods") >= REPOSITORY_METHODS) & (c("fan_in") >= 1), HOTSPOT["repository"]).otherwise(0.0)
    )
    reasons = F.array_compact(F.array(F.when(coupling > 0, "high_coupling"), F.when(c("loc") > 0, "high_complexity"), F.when(god, "god_object"), F.when(c("cycles") > 0, "circular_dependency")))
    out = files.crossJoin(F.broadcast(top)).filter(signs).withColumns({"score": F.least(F.lit(1.0), score), "reasons": reasons})  # top: one row
    return out.filter(F.size("reasons") > 0).withColumn("risk_level", risk_level(F.col("score"))).drop("__c", "__l", "__m")


def risk_score(hotspot: Column, affected_files: Column, full_modules: Column, modules: Column, full_services: Column, services: Column, breaking_apis: Column) -> Column:
    """Weighted sum of hotspot (0.5 if unknown), spread, modules, services and broken interfaces; 1 at most."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    spread = F.least(F.lit(1.0), affected_files / RISK["files"]) * RISK["spread"]
    whole = part(full_modules, modules) * RISK["modules"] + part(full_services, services) * RISK["services"]
    return F.least(F.lit(1.0), F.coalesce(hotspot, F.lit(RISK["unknown_hotspot"])) * RISK["hotspot"] + spread + whole + breaking_apis * RISK["interfaces"])


def coverage(affected: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """How much of each module is affected: full (all files), minimal (one file of more than three) or partial."""
    total = files.groupBy(key).agg(F.count_distinct("file").alias("total_files"))
    hit = affected.join(files, "file").groupBy(key).agg(F.count_distinct("file").alias("affected_files"))
    level = F.when(F.col("affected_files") == F.col("total_files"), "full").when((F.col("affected_files") == 1) & (F.col("total_files") > SMALL_MODULE), "minimal").otherwise("partial")
    return hit.join(total, key).withColumn("impact_level", level)


def confidence(length: Column, compatible: Column, hotspot: Column) -> Column:
    return F.least(F.lit(1.0), 1.0 - length * CAUSE["step"] + F.when(compatible, CAUSE["compatible"]).otherwise(0.0) + F.coalesce(hotspot, F.lit(0.0)) * CAUSE["hotspot"])


def root_causes(findings: DataFrame, edges: DataFrame, compatible: DataFrame, depth: int = CAUSE["depth"], least: float = CAUSE["least"]) -> DataFrame:
    """Pairs of findings whose nodes are connected: one traversal from all roots, joined with the findings at its ends.

    ``compatible`` has (root_type, related_type); a path of more than 6 steps can't reach the least confidence.
    """
    roots = findings.select(F.col("id").alias("root_id"), F.col("node").alias("origin"), F.col("type").alias("root_type"), F.col("hotspot").alias("hotspot"))
    paths = reach(adjacency(edges), roots.select("origin").distinct(), depth)
    related = findings.select(F.col("id").alias("related_id"), "node", F.col("type").alias("related_type"))
    pairs = roots.join(paths, "origin").join(related, "node").join(compatible.distinct().withColumn("__ok", F.lit(True)), ["root_type", "related_type"], "left")
    out = pairs.withColumn("confidence", confidence(F.col("depth"), F.coalesce("__ok", F.lit(False)), F.col("hotspot")))
    return out.filter((F.col("confidence") >= least) & (F.col("root_id") != F.col("related_id"))).select("root_id", "related_id", F.col("depth").alias("path_length"), "confidence")


def severity(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), c), F.lit(1)) - 1


def noise(findings: DataFrame, steps: DataFrame, tolerance: int = NEAR_LINES) -> DataFrame:
    """Mark, don't delete: duplicates of a worse finding of the same file and type, findings deep in a chain, findings in many chains.

    ``steps`` has (chain_id, finding_id, step, root_severity). The first rule that applies gives the reason.
    """
    order = Window.partitionBy("file", "type").orderBy(severity(F.col("severity")).desc(), "id")
    first = lambda c: F.first(c).over(order)
    near = F.abs(F.col("line_start") - first("line_start")) <= tolerance
    duplicate = F.when(F.row_number().over(order) > 1, F.concat(F.lit("duplicate of "), first("id"), F.when(near, ": line range").otherwise(": severity")))
    chains = steps.groupBy("finding_id").agg(F.min("step").alias("depth"), F.max_by("root_severity", "chain_id").alias("root_severity"), F.count_distinct("chain_id").alias("chains"))
    own = findings.withColumn("__duplicate", duplicate).join(chains, F.col("id") == F.col("finding_id"), "left")
    derived = F.when((F.col("depth") > DERIVED_DEPTH) & (severity(F.col("severity")) <= severity(F.col("root_severity"))), F.concat(F.lit("derived at depth "), F.col("depth").cast("string")))
    redundant = F.when(F.col("chains") >= REDUNDANT_CHAINS, F.concat(F.lit("in "), F.col("chains").cast("string"), F.lit(" chains")))
    out = own.withColumn("noise_reason", F.coalesce("__duplicate", derived, redundant))
    return out.withColumn("noise_suppressed", F.col("noise_reason").isNotNull()).select(*findings.columns, "noise_suppressed", "noise_reason")
