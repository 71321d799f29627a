"""Cycles and orders of large directed graphs, by rounds of joins over edges (src, dst); no task ever holds a graph.

Strongly connected components: nodes without edges in or out are trimmed; then each node takes the smallest node that
reaches it as its colour, and what reaches a colour's own node within the colour is that node's component (Orzan's
colouring). A topological order: nodes that wait for nothing are peeled off round by round. Rounds are as many as the longest
shortest path (components) or the longest chain (order); each moves the frontier's edges only, and is a written table.

Defined results: null ends are no edges; repeated edges count once; an edge from a node to itself makes a cycle of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written

#: A round of trimming that drops less than this share of the edges is the last; colouring does the rest.
TRIMMED = 0.05


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").dropna().distinct()


def _together(tables: list[DataFrame]) -> DataFrame | None:
    """The written tables of all rounds as one scan, so that many rounds don't make a deep plan."""
    if not tables:
        return None
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._rivulet_path for t in tables])


def _trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges whose start has an edge in and whose end has an edge out, again and again; and their number."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        kept = written(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "trim")
        discard(edges)
        before, n, edges = n, kept.count(), kept
        if n > before * (1 - TRIMMED):
            break
    return edges, n


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest node that reaches each node of ``edges``, itself included; written."""
    now = written(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while True:
        told = now.filter("fresh").join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("heard"))
        lower = F.col("heard").isNotNull() & (F.col("heard") < F.col("colour"))
        new = written(now.join(told, "node", "left").select("node", F.when(lower, F.col("heard")).otherwise(F.col("colour")).alias("colour"), lower.alias("fresh")), "colours")
        discard(now)
        now = new
        if now.filter("fresh").isEmpty():
            return now.select("node", "colour")


def _members(edges: DataFrame) -> DataFrame:
    """(node, component): of edges (src, dst, colour) within colours, the nodes that reach their colour's own node; written."""
    found = frontier = written(edges.select(F.col("colour").alias("node"), F.col("colour").alias("component")).distinct(), "members")
    while True:
        back = edges.join(frontier, (F.col("dst") == F.col("node")) & (F.col("colour") == F.col("component"))).select(F.col("src").alias("node"), "component").distinct()
        frontier = written(back.join(found, ["node", "component"], "left_anti"), "members")
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier), "members")


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of every node on a cycle: a component is named by its smallest node."""
    own = _pairs(edges)
    loops = own.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest, found = written(own.filter("src <> dst"), "edges"), []
    while True:
        rest, n = _trim(rest)
        if not n:
            break
        colour = _colours(rest)
        ends = lambda e, c: colour.select(F.col("node").alias(e), F.col("colour").alias(c))
        # An edge between colours is on no cycle.
        within = written(rest.join(ends("src", "colour"), "src").join(ends("dst", "other"), "dst").filter("colour = other").select("src", "dst", "colour"), "inside")
        members = _members(within)
        found.append(members)
        rest, past = written(within.select("src", "dst").join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti"), "edges"), rest
        discard(past, within)
    # A colour's own node without a way back is alone, as is a node with a loop that no other component has.
    of = _together(found)
    if of is not None:
        sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        of = of.join(sizes, "component").select("node", "component", "size")
        loops = loops.join(of.select("node"), "node", "left_anti")
    loops = loops.withColumn("size", F.lit(1).cast("long"))
    return loops if of is None else of.unionByName(loops)


def inside(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(src, dst, component): the edges whose ends are of one of the :func:`components`."""
    of = lambda e: members.select(F.col("node").alias(e), F.col("component").alias(f"{e}_of"))
    both = _pairs(edges).join(of("src"), "src").join(of("dst"), "dst").filter("src_of = dst_of")
    return both.select("src", "dst", F.col("src_of").alias("component"))


def component_cycles(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(component, length, cycle): for each of :func:`components` a shortest cycle through its smallest node, which comes first and last.

    Of equally short ones, the one whose nodes, read backwards, are the smallest. Steps from the smallest node are
    counted for all components at once; then each component's path is walked back, a row a component a round.
    """
    members = written(members, "cycle-members")
    own = written(inside(edges, members), "cycle-edges")
    steps = frontier = written(members.select("component", F.col("component").alias("node"), F.lit(0).alias("step")).distinct(), "cycle-steps")
    n = 0
    while not frontier.isEmpty():
        n += 1
        on = frontier.select("component", F.col("node").alias("src")).join(own, ["component", "src"]).select("component", F.col("dst").alias("node")).distinct()
        frontier = written(on.join(steps, ["component", "node"], "left_anti").withColumn("step", F.lit(n)), "cycle-steps")
        steps = written(steps.unionByName(frontier), "cycle-steps")
    # The last step enters the component's own node; each earlier one is the smallest node a step before.
    at = F.min(F.struct("step", F.col("src").alias("node"))).alias("p")
    before = own.join(steps.withColumnRenamed("node", "src"), ["component", "src"])
    walk = before.filter("dst = component").groupBy("component").agg(at)
    walk = written(walk.select("component", (F.col("p.step") + 1).alias("length"), F.array("p.node", "component").alias("cycle"), F.col("p.step").alias("step"), F.col("p.node").alias("node")), "cycle-walk")
    done = []
    while True:
        done.append(written(walk.filter("step = 0").select("component", "length", "cycle"), "cycles"))
        open_ = walk.filter("step > 0").withColumnRenamed("node", "dst").withColumn("step", F.col("step") - 1)
        back = open_.join(before, ["component", "dst", "step"]).groupBy("component", "length", "cycle", "step").agg(F.min("src").alias("node"))
        walk = written(back.select("component", "length", F.concat(F.array("node"), "cycle").alias("cycle"), "step", "node"), "cycle-walk")
        if walk.isEmpty():
            break
    return _together(done)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 1, in ``order``: sorted by ranges, each of which starts at the rows before it."""
    part = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    block: Column = F.shiftright("__at", 33)
    sizes = part.groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("__before", before).drop("__n")
    placed = part.withColumn("__block", block).join(F.broadcast(sizes), "__block")
    return placed.select(*df.columns, (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias(name))


def topological_order(tasks: DataFrame, waits: DataFrame, ties: list[str]) -> DataFrame:
    """(node, level, position) of each task (node, and the ``ties`` columns) that is not on or behind a cycle.

    ``waits`` (node, needs): the node comes after what it needs; needs that are no tasks are passed over. ``level`` is the
    length of the longest chain before it, ``position`` numbers levels one after another from 1, ties in order, then by node.
    """
    names = tasks.select("node").dropna().distinct()
    edges = waits.select(F.col("needs").alias("src"), F.col("node").alias("dst")).dropna().distinct()
    edges = written(edges.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "dst"), "dst", "left_semi"), "order-edges")
    degrees = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("open"))
    left = written(names.join(degrees, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open")), "order-left")
    peeled, level = [], 0
    while True:
        free = written(left.filter("open = 0").select("node", F.lit(level).alias("level")), "order-level")
        if free.isEmpty():
            break
        peeled.append(free)
        done = free.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("met"))
        left, past = written(left.filter("open > 0").join(done, "node", "left").select("node", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "order-left"), left
        discard(past)
        level += 1
    levels = _together(peeled or [free])
    first = tasks.groupBy("node").agg(F.min(F.struct(*ties)).alias("tie")) if ties else tasks.select("node", F.struct(F.lit(0).alias("none")).alias("tie")).distinct()
    return numbered(levels.join(first, "node"), ["level", "tie", "node"], "position").select("node", "level", "position")
