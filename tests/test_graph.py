"""Graph operators on long chains, cycles and random graphs, against plain Python."""

from __future__ import annotations

import random

from tidemark.operators import columns, diff, graph


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_long_chain(spark):
    """Rounds go on until nothing is new; 18 of them here."""
    n = 18
    edges = frame(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(n)])
    root = spark.createDataFrame([("n000",)], "root string")
    assert {r["node"]: r["hops"] for r in graph.closure(edges, root).collect()} == {f"n{i:03}": i for i in range(1, n + 1)}
    assert graph.closure(edges, root, max_hops=3).count() == 3
    assert {r["node"]: r["level"] for r in graph.levels(edges).collect()} == {f"n{i:03}": i for i in range(n + 1)}
    (path,) = graph.simple_paths(edges).collect()
    assert path["hops"] == n + 1


def test_cycles_against_reachability(spark):
    rng = random.Random(4)
    names = [f"v{i:02}" for i in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(48)] + [("s", "s"), ("a", "b"), ("b", "a"), ("b", "c")]
    reach = {n: {n} for p in pairs for n in p}
    for _ in reach:
        for a, b in pairs:
            for r in reach.values():
                if a in r:
                    r.add(b)
    loops = {a for a, b in pairs if a == b}
    groups = {frozenset(m for m in reach if m in reach[n] and n in reach[m]) for n in reach}
    want = {min(g): len(g) for g in groups if len(g) > 1 or g & loops}
    assert {r["component"]: r["members"] for r in graph.cycles(frame(spark, pairs)).collect()} == want
    assert graph.cycles(frame(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_topological_order_and_what_lies_behind_a_cycle(spark):
    edges = frame(spark, [("c", "a"), ("a", "d"), ("x", "y"), ("y", "x"), ("y", "z")])
    assert {r["node"]: r["level"] for r in graph.levels(edges).collect()} == {"c": 0, "a": 1, "d": 2, "x": None, "y": None, "z": None}
    ordinals = spark.createDataFrame([(n, i) for i, n in enumerate("zyxwdcba")], "node string, ordinal int")
    got = [r["node"] for r in graph.topological_order(edges, ordinals).orderBy("position").collect()]
    assert got == ["w", "c", "b", "a", "d", "z", "y", "x"]


def test_versions_and_headers(spark, tmp_path):
    assert [diff.bump_version(v, c) for v, c in (("1.4.2", True), ("1.4.2", False), ("0.0.0", True), (None, False), ("odd", True))] == ["1.5.0", "1.4.3", "1.1.0", "1.0.1", "1.1.0"]
    (tmp_path / "a.csv").write_text('ID,Name,Extra\n1,"x, y",\n2,,z\n')
    a = diff.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in a.collect()] == [("1", "x, y", None), ("2", None, "z")]
    assert diff.header_mismatches(a, ["id", "NAME", "GONE"]) == {"missing": ["GONE"], "extra": ["Extra"]}


def test_continuity_by_identity_and_by_name(spark):
    old = spark.createDataFrame([("k1", "T.CUST_KEY"), ("k2", "T.ORDER_DATE"), ("k3", "T.AMOUNT"), ("k4", "T.GONE")], "k string, v string")
    new = spark.createDataFrame([("k1", "U.CUST_ID"), ("k2", "U.ORDERDATE"), ("k3", "U.REGION"), ("k5", "U.NEW")], "k string, v string")
    ids = spark.createDataFrame([("T.CUST_KEY", "cust_id"), ("U.CUST_ID", "cust_id")], "fqn string, canonical_id string")
    got = {r["k"]: (r["status"], r["confidence"]) for r in diff.continuity(old, new, "k", "v", ids).collect()}
    assert got["k1"] == ("matched", 1.0) and got["k2"][0] == "matched" and 0.85 <= got["k2"][1] < 1
    assert [got[k][0] for k in ("k3", "k4", "k5")] == ["mismatched", "missing", "extra"]


def test_names_in_paths(spark):
    df = spark.createDataFrame([("DW.A -> DW.B",), ("dw.abc, x",), ("Q",), (None,)], "n string")
    assert [r[0] for r in df.filter(columns.matches_name(df["n"], "dw.a")).collect()] == ["DW.A -> DW.B", "dw.abc, x"]
