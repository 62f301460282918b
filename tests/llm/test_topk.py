"""The Voronoi join against DuckDB and against all products."""

from __future__ import annotations

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import voronoi


def brute(rows, step=50, k=5):
    valid = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = set()
    for q in {i for i, _ in valid if i % step == 0}:
        best = {}
        for a, x in valid:
            for b, y in valid:
                if a == q and b != q and len(x) == len(y):
                    best[b] = max(best.get(b, -(10**99)), sum(s * t for s, t in zip(x, y)))
        out |= {(q, n + 1, b, s) for n, (s, b) in enumerate(sorted(((s, b) for b, s in best.items()), key=lambda t: (-t[0], t[1]))[:k])}
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "cell": F.lit(2), "least": F.lit(3)})
    got = voronoi.search(df, F.col("vec_id") % 50 == 0, **more)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()))


def test_products_of_the_table(spark, sf_dir):
    got = voronoi.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(voronoi.oracle()).fetchall())


def test_cells_that_are_left_out_hold_no_answer(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6)) * 20
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.2).tolist()) for i in range(900)]
    monkeypatch.setattr(voronoi, "PIECE", 6 * 40)
    monkeypatch.setattr(voronoi, "LEAST_ROWS", 1)
    assert found(spark, rows, pivots=12) == sorted(brute(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [-3.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]), (50, [0.0, 0.0]), (7, [-0.001, 5.0]), (8, [1.0, 2.0]), (9, [1.0, 2.0])]
    rows += [(100, []), (11, []), (150, [1.0]), (200, [1.0, 1.0, 1.0]), (12, [2.0, 2.0, 2.0])]
    assert found(spark, rows) == sorted(brute(rows))
    assert found(spark, []) == []


def test_one_vector_that_most_rows_share(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "PIECE", 3 * 50)
    monkeypatch.setattr(voronoi, "LEAST_ROWS", 1)
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, -2.0, 0.5] if i % 3 else rng.normal(size=3).tolist()) for i in range(400)]
    assert found(spark, rows) == sorted(brute(rows))


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for most in (300, 2**40, 2**62):
        q, x = rng.integers(-most, most, (4, 5)), rng.integers(-most, most, (6, 5))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(r, s)))) for s in x] for r in q]
        assert voronoi._products(q, x).tolist() == want
