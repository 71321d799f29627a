import pytest

from rivulet.llm.chat import flat_pairs, preference_pairs

SCHEMA = "conv_id long, turn long, role string, text string"


def show(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c // 2, {0: [], 1: []})[c % 2].append(((t is not None, t or 0), r or "unknown", x or ""))
    out = []
    for pair, sides in convs.items():
        a, b = ([(r, x) for _, r, x in sorted(set(s))] for s in (sides[0], sides[1]))
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        spans = []
        for rest in (a[k:], b[k:]):
            at, own = 0, []
            for r, x in rest:
                head = len(f"<|im_start|>{r}\n")
                if r == "assistant":
                    own.append(f"{at + head}-{at + head + len(x) + len('<|im_end|>')}")
                at += len(show(r, x))
            spans.append(",".join(own))
        out.append((pair, bool(a) and bool(b), k, len(a), len(b), "".join(show(*t) for t in a[:k]), "".join(show(*t) for t in a[k:]), "".join(show(*t) for t in b[k:]), *spans))
    return sorted(out)


ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"),
    (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "é" * 5), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "é" * 5),
    (4, 0, "user", "alone"), (7, 0, "user", "alone too"), (None, 0, "user", "lost"), (8, None, "user", "n"), (8, 0, None, None), (9, None, "user", "n"), (9, 0, None, "x"),
    (8, 0, None, None), (10, 0, "user", "tie"), (10, 0, "user", "tie b"), (11, 0, "user", "tie"), (-1, 0, "user", "minus"), (-2, 0, "user", "minus"), (12, 0, "user", ""), (13, 0, "user", ""), (13, 1, "assistant", "x" * 100_000),
]


def test_brute(spark):
    got = sorted(tuple(r)[:10] for r in flat_pairs(preference_pairs(spark.createDataFrame(ROWS, SCHEMA))).collect())
    assert got == brute(ROWS)


def test_no_python_in_plan(spark):
    plan = flat_pairs(preference_pairs(spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


@pytest.mark.parametrize("extra", ["idx", "side", "pair_id", "again"])
def test_clashing_names_and_empty(spark, extra):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert preference_pairs(frame.withColumn(extra, F.lit("x"))).count() == len(brute(ROWS))
    assert preference_pairs(frame.limit(0)).collect() == []
