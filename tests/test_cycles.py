"""Components, cycles and orders of random graphs against plain Python."""

import random

import pytest

from rivulet.operators import cycles


def reachable(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    out = {}
    for a in near:
        seen, todo = set(), list(near[a])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near.get(n, ())
        out[a] = seen
    return out


def brute_components(edges):
    to = reachable(edges)
    of = {a: min(b for b in to[a] if a in to.get(b, ())) for a in to if a in to[a]}
    return {(n, c, sum(x == c for x in of.values())) for n, c in of.items()}


def brute_cycle(edges, component, members):
    """Breadth first from the smallest node, then back by the smallest node a step before."""
    near = {(a, b) for a, b in edges if a in members and b in members}
    step, level = {component: 0}, [component]
    while level:
        level = [b for b in {b for a, b in near if a in level} if b not in step]
        step |= dict.fromkeys(level, step[max(step, key=step.get)] + 1)
    path = [min((step[a], a) for a, b in near if b == component)[1], component]
    while step[path[0]]:
        path.insert(0, min(a for a, b in near if b == path[0] and step[a] == step[path[0]] - 1))
    return path


def brute_order(tasks, waits, ties):
    left, out, level = {n: {b for a, b in waits if a == n and b in tasks} for n in tasks}, [], 0
    while free := sorted((n for n in left if not left[n]), key=lambda n: (ties[n], n)):
        out += [(n, level) for n in free]
        left = {n: w - set(free) for n, w in left.items() if n not in free}
        level += 1
    return [(n, level, i) for i, (n, level) in enumerate(out, 1)]


def graphs():
    """Several graphs side by side, each with numbers of its own: sparse and dense, a chain, a ring, two rings in a row, loops."""
    rng = random.Random(4)
    made = [{(rng.randrange(n), rng.randrange(n)) for _ in range(m)} for n, m in ((30, 25), (30, 45), (60, 75), (12, 60))]
    chain = {(i, i + 1) for i in range(8)}
    made += [chain, chain | {(8, 0)}, {(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5)}, {(7, 7), (7, 8), (1, 7)}]
    return {(100 * g + a, 100 * g + b) for g, edges in enumerate(made) for a, b in edges}


def test_components_and_their_cycles(spark):
    edges = graphs()
    rows = [*edges, *list(edges)[:3], (None, 1), (1, None)]
    frame = spark.createDataFrame(rows, "src long, dst long")
    members = cycles.components(frame)
    found = {(r.node, r.component, r["size"]) for r in members.collect()}
    assert found == brute_components(edges)
    got = {r.component: (r.length, r.cycle) for r in cycles.component_cycles(frame, members).collect()}
    of = {}
    for n, c, _ in found:
        of.setdefault(c, set()).add(n)
    want = {c: brute_cycle(edges, c, m) for c, m in of.items()}
    assert got == {c: (len(p) - 1, p) for c, p in want.items()}


def test_no_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    members = cycles.components(none)
    assert members.count() == 0 and cycles.component_cycles(none, members).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_order(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(40)]
    ties = {n: (rng.choice("abc"), rng.choice("xy")) for n in names}
    waits = {(names[max(i, j)], names[min(i, j)]) for i, j in ((rng.randrange(40), rng.randrange(40)) for _ in range(50)) if i != j}
    waits |= {("t3", "gone"), ("t35", "t36"), ("t36", "t35"), ("t37", "t36")}  # a need that is no task; a cycle and what waits for it
    tasks = spark.createDataFrame([(n, *ties[n]) for n in names], "node string, file string, action string")
    frame = spark.createDataFrame([*waits, *list(waits)[:4], (None, "t1")], "node string, needs string")
    got = sorted(((r.node, r.level, r.position) for r in cycles.topological_order(tasks, frame, ["file", "action"]).collect()), key=lambda r: r[2])
    assert got == brute_order(set(names), waits, ties)
    assert not {"t35", "t36", "t37"} & {r[0] for r in got}


def test_order_of_no_tasks(spark):
    none = spark.createDataFrame([], "node string, file string"), spark.createDataFrame([], "node string, needs string")
    assert cycles.topological_order(*none, ["file"]).count() == 0
