"""Overrides in their order against a replay of one at a time over plain lists."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import overrides

CONSUMER = {"VIEW": "VIEW_DEPENDS", "PROCEDURE": "SP_READS", "ETL_JOB": "ETL_READS", "SCHEDULE": "SCHEDULE_DEPENDS", "DASHBOARD": "DASHBOARD_RENDERS"}


def one_by_one(nodes, edges, over):
    nodes, edges, names, applied = dict(nodes), [list(e) for e in edges], {}, []

    def fit(e):
        if e[4]:
            if e[2] == "UNRESOLVED":
                e[2] = CONSUMER.get(nodes.get(e[1])) or {"PROCEDURE": "SP_WRITES", "ETL_JOB": "ETL_WRITES"}.get(nodes.get(e[0])) or "VIEW_DEPENDS"
            e[3], e[4] = 1.0, False

    def move(old, new):
        names.setdefault(old, old)
        for k, v in names.items():
            if v == old:
                names[k] = new
        for e in edges:
            if old in e[:2]:
                e[:2] = [new if x == old else x for x in e[:2]]
                fit(e)

    def clear(name):
        for e in edges:
            if name in e[:2]:
                fit(e)

    for subject, kind, target, sources, _ in over:
        target = target or subject
        good = kind in overrides.KINDS and bool(subject) and not (kind == "alias" and target not in nodes)
        applied.append(good)
        if not good:
            continue
        if kind == "alias":
            move(subject, target)
        elif kind == "stub":
            nodes.setdefault(target, "TABLE")
            if target != subject:
                move(subject, target)
            clear(target)
        else:
            k = {"PROCEDURE": "SP_READS", "ROUTINE": "ETL_READS"}.get(nodes.get(subject), "VIEW_DEPENDS")
            for s in sources or []:
                if s in nodes and (s, subject, k) not in {tuple(e[:3]) for e in edges}:
                    edges.append([s, subject, k, 1.0, False])
            clear(subject)
    best = {}
    for s, d, k, c, u in edges:
        best[s, d, k] = max(best.get((s, d, k), (False, -1.0)), (not u, c))
    return set(nodes.items()), {(*k, c, not sure) for k, (sure, c) in best.items()}, {k: v for k, v in names.items() if k != v}, applied


def made(seed):
    random.seed(seed)
    pool = [f"N{i}" for i in range(9)]
    nodes = [(n, random.choice(["TABLE", "VIEW", "PROCEDURE", "ETL_JOB", "ROUTINE"])) for n in pool[:5]]
    edges = list({(random.choice([*pool, None]), random.choice(pool), random.choice(["VIEW_DEPENDS", "SP_READS", "UNRESOLVED"]), random.choice([0.3, 0.6, 1.0]), random.random() < 0.6) for _ in range(25)})
    over = []
    for i in range(14):
        kind = random.choice(["alias", "alias", "alias", "stub", "runtime_sources", "other"] if i else ["alias"])
        over.append((random.choice([*pool, "", None]) if random.random() < 0.2 else random.choice(pool), kind, None if random.random() < 0.1 else random.choice(pool), random.sample(pool, 3) + [None] if kind == "runtime_sources" else None, i))
    return nodes, edges, over


@pytest.mark.parametrize("seed", (2, 4, 5))
def test_overrides_in_order_equal_one_by_one(spark, seed):
    nodes, edges, over = made(seed)
    kinds = {"n": "fqn string, kind string", "e": "src string, dst string, kind string, confidence double, unresolved boolean", "o": "subject string, kind string, target string, sources array<string>, seq int"}
    done = overrides.replay(spark.createDataFrame(nodes, kinds["n"]), spark.createDataFrame(edges + edges[:4], kinds["e"]), spark.createDataFrame(random.sample(over, len(over)), kinds["o"]))
    want_nodes, want_edges, want_names, want_applied = one_by_one(nodes, edges, over)
    assert {tuple(r) for r in done.nodes.collect()} == want_nodes
    assert {tuple(r) for r in done.edges.collect()} == want_edges
    assert {r["name"]: r["final"] for r in done.names.collect()} == want_names
    assert [r["applied"] for r in done.notes.orderBy("seq").collect()] == want_applied
    rows = spark.createDataFrame([("N0", ["N1", None, "N2"]), ("N3", []), (None, None)], "source_table string, reads array<string>")
    at = lambda n: want_names.get(n, n)
    got = {str((r["source_table"], r["reads"])) for r in done.rename(rows, "source_table", "reads").collect()}
    assert got == {str((at("N0"), [at("N1"), None, at("N2")])), str((at("N3"), [])), str((None, None))}


def test_no_overrides_and_no_estate(spark):
    nodes, edges = spark.createDataFrame([], "fqn string, kind string"), spark.createDataFrame([], "src string, dst string, kind string, confidence double, unresolved boolean")
    over = spark.createDataFrame([], "subject string, kind string, target string, sources array<string>, seq int")
    done = overrides.replay(nodes, edges, over)
    assert done.nodes.count() + done.edges.count() + done.notes.count() + done.names.count() + done.settled.count() == 0
    stub = spark.createDataFrame([("A", "stub", None, None, 1)], over.schema)
    assert [tuple(r) for r in overrides.replay(nodes, edges, stub).nodes.collect()] == [("A", "TABLE")]
