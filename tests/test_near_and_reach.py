"""Near rows without keys against brute force, and sizes of reach against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import diff, graph


def near(a, b, eps):
    """Whether two tuples are within tolerance, column by column; texts in any case, nulls equal."""
    for x, y in zip(a, b):
        if (x is None) != (y is None):
            return False
        if x is None:
            continue
        if isinstance(x, str):
            if x.lower() != y.lower():
                return False
        elif not abs(x - y) <= eps:
            return False
    return True


@pytest.mark.parametrize("schema", ["s string, v double", "v double", "v double, w double", "s string, v double, w double, u double", "s string"])
def test_near_rows_equal_brute_force(spark, schema):
    random.seed(len(schema))
    kinds = [c.split()[1] for c in schema.split(", ")]
    odd = [None, 0.0, -0.0, 1e18, 1e18 + 256, float("inf"), float("nan"), 0.1, 0.2, 0.30000000000000004]
    value = lambda k: random.choice(["a", "A", "b", "", None]) if k == "string" else (random.choice(odd) if random.random() < 0.15 else round(random.random() * 6, 2))
    sides = [[tuple(value(k) for k in kinds) for _ in range(n)] for n in (300, 120)]
    a, b = (spark.createDataFrame(rows + rows[:20], schema) for rows in sides)
    t = diff.Tolerances(numeric_epsilon=0.1)
    got = sorted(map(str, (tuple(r) for r in diff.near_missing(a, b, t).collect())))
    assert got == sorted(str(r) for r in sides[0] + sides[0][:20] if not any(near(r, s, 0.1) for s in sides[1]))


def test_near_rows_of_other_kinds(spark):
    a = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS at, CAST(1.00 AS DECIMAL(9,2)) AS d, 7L AS n UNION ALL SELECT timestamp'2024-01-01 00:00:05', CAST(1.00 AS DECIMAL(9,2)), 7L")
    b = a.select((F.col("at") + F.expr("interval 1 second")).alias("AT"), (F.col("d") + F.expr("0.01BD")).cast("decimal(9,2)").alias("d"), "n", F.lit(1).alias("more")).limit(1)
    assert diff.near_missing(a, b).count() == 1 and diff.near_missing(a, b.limit(0)).count() == 2
    assert diff.near_missing(a, b, diff.Tolerances(masked=("at",))).count() == 0
    assert diff.near_missing(a, b, diff.Tolerances(masked=("at", "d", "n"))).count() == 0
    assert diff.near_missing(a, a, diff.Tolerances(numeric_epsilon=0.0, temporal_seconds=0)).count() == 0


def test_near_rows_need_no_pairs(spark):
    a = spark.range(20_000).select((F.col("id") % 7 / 1000).alias("v"))
    found = diff.near_missing(a, a.select((F.col("v") + 0.004).alias("v")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 0


def served(xs, ys, near_by):
    """How many of xs can have a y of their own, by augmenting paths."""
    owner = {}

    def place(i, seen):
        for j, y in enumerate(ys):
            if j not in seen and near_by(xs[i], y):
                seen.add(j)
                if j not in owner or place(owner[j], seen):
                    owner[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(xs)))


@pytest.mark.parametrize("schema,eps", [("s string, v double", 0.125), ("v double", 0.125), ("s string, v decimal(9,2)", 0.01), ("s string, n long", 2), ("s string", 0.5)])
def test_matching_once_serves_as_many_as_can_be(spark, schema, eps):
    from decimal import Decimal

    random.seed(len(schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    kinds = [c.split()[1] for c in schema.split(", ")]
    made = {"string": lambda: random.choice(["a", "A", "b", None]), "double": lambda: random.choice([None, float("inf"), float("nan")]) if random.random() < 0.1 else random.randrange(60) / 16, "decimal(9,2)": lambda: Decimal(random.randrange(40)).scaleb(-2), "long": lambda: random.randrange(60)}
    sides = [[tuple(made[k]() for k in kinds) for _ in range(n)] for n in (120, 90)]
    by = lambda p, q: all((x is None) == (y is None) and (x is None or (x.lower() == y.lower() if isinstance(x, str) else abs(x - y) <= (Decimal(str(eps)) if isinstance(x, Decimal) else eps))) for x, y in zip(p, q))
    a, b = (spark.createDataFrame(rows, schema) for rows in sides)
    got = diff.unmatched_once(a, b, diff.Tolerances(numeric_epsilon=eps)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r["missing"] for r in got) == len(sides[0]) - served(*sides, by)
    # Rows that are told have been there so often, and the others can be served all together.
    left, out = [], {str(tuple(r)[:-1]): r["missing"] for r in got}
    for row in sides[0]:
        key = str(tuple(x.lower() if isinstance(x, str) else x for x in row))
        if out.get(key, 0):
            out[key] -= 1
        else:
            left.append(row)
    assert not any(out.values()) and served(left, sides[1], by) == len(left)


def test_matching_once_of_times_and_nothing(spark):
    a = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS at UNION ALL SELECT timestamp'2024-01-01 00:00:00' UNION ALL SELECT timestamp'2024-01-01 00:00:09'")
    b = spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS at")
    assert sorted(r["missing"] for r in diff.unmatched_once(a, b).collect()) == [1, 1]
    assert diff.unmatched_once(a.limit(0), b).count() == 0 and sum(r["missing"] for r in diff.unmatched_once(a, b.limit(0)).collect()) == 3
    with pytest.raises(ValueError):
        diff.unmatched_once(spark.sql("SELECT 1 AS x, 2 AS y"), spark.sql("SELECT 1 AS x, 2 AS y"))


def reached(pairs):
    ahead = {}
    for s, d in pairs:
        ahead.setdefault(s, set()).add(d)
    out = {}
    for root in ahead:
        seen, todo = set(), [root]
        while todo:
            for d in ahead.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        if seen - {root}:
            out[root] = len(seen - {root})
    return out


def random_edges(seed, n, m, up):
    random.seed(seed)
    return [(f"n{i}", f"n{j}") for i, j in ((random.randrange(n), random.randrange(n)) for _ in range(m)) if up or i < j]


@pytest.mark.parametrize("pairs", [random_edges(1, 40, 60, False), random_edges(2, 40, 45, True), [("a", "b"), ("b", "a"), ("a", "a"), ("b", "c"), ("c", "d")], [(f"n{i}", f"n{2 * i + k}") for i in range(1, 20) for k in (0, 1)], [("a", "a")]])
def test_reach_sizes_equal_all_pairs(spark, pairs):
    edges = spark.createDataFrame(pairs + pairs[:3] + [(None, "n1"), ("n1", None)], "src string, dst string")
    assert {r["root"]: r["reached"] for r in graph.reach_sizes(edges).collect()} == reached(pairs)
    # So few ids are counted one by one by a sketch.
    assert {r["root"]: r["reached"] for r in graph.reach_sizes(edges, 12).collect()} == reached(pairs)


def test_sketched_sizes_keep_their_error(spark):
    mids = spark.range(4_000).select(F.concat(F.lit("m"), "id").alias("dst"))
    edges = mids.select(F.lit("top").alias("src"), "dst").union(mids.select(F.lit("side"), "dst")).union(spark.sql("SELECT 'top', 'side'"))
    exact = {r["root"]: r["reached"] for r in graph.reach_sizes(edges).collect()}
    near = {r["root"]: r["reached"] for r in graph.reach_sizes(edges, 12).collect()}
    assert exact == {"top": 4_001, "side": 4_000} and all(abs(near[k] / exact[k] - 1) < 4 / 2**6 for k in exact)
