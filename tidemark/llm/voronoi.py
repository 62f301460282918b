"""Exact search for the largest integer inner products: a Voronoi join of queries and data.

Pivots are fitted on a bounded sample; every row belongs to the cell of its nearest pivot. A summary of each cell
(how far its farthest row and its k + 1 nearest rows are from the pivot) bounds from above what any of its rows can
score with a query, and from below what a query's k-th score is. A query is first answered within the cell whose pivot
it likes best, which raises its bound, and then sent to those other cells alone whose upper bound reaches it. Cells are
solved locally, in pieces of bounded size, past which queries stream.

It is the queries that are replicated, for there are fewer of them than rows; no row is sent to more than one place a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, saved

#: Pivots a vector length, the most rows that they are fitted on, and rounds of fitting.
PIVOTS, SAMPLE, ROUNDS = 64, 8192, 6
#: So many vector lengths, the most frequent ones, have pivots; each other length is one cell around the origin.
LENGTHS = 4
#: Components in a piece of a cell; pieces of very long vectors have LEAST_ROWS rows.
PIECE, LEAST_ROWS = 2**21, 64
#: What rounding may do to a bound.
SLACK = 1e-9

SEED = 42
KEY = ("dims", "cell", "piece")


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs; null if the vector or a component is null or not finite."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))))


def fit(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Centres of a sample by Lloyd's method, from random rows; at most one for each four rows."""
    rng = np.random.default_rng(SEED)
    distinct = np.unique(sample, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: max(1, min(pivots, len(sample) // 4))]].astype(np.float64)
    for _ in range(ROUNDS):
        nearest = _nearest(sample, centres)
        sums, counts = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _assigned(v: Column, pivots: dict[int, np.ndarray]) -> Column:
    """cell (-1 where the length has no pivots) and dist of a vector: its nearest pivot, and how far that is."""
    kind = pa.struct([("cell", pa.int32()), ("dist", pa.float64())])

    @F.arrow_udf("struct<cell: int, dist: double>")
    def of(vectors: pa.Array) -> pa.Array:
        n = len(vectors)
        lengths = np.asarray([len(x) for x in vectors]) if n else np.zeros(0, int)
        cell, dist = np.full(n, -1, np.int32), np.zeros(n)
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            x = _matrix(vectors.take(pa.array(rows)), d).astype(np.float64)
            if d in pivots:
                cell[rows] = _nearest(x, pivots[d])
                x = x - pivots[d][cell[rows]]
            dist[rows] = np.sqrt((x * x).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(dist)], fields=list(kind))

    return of(v)


def _bounds(v: Column, pivots: dict[int, np.ndarray], cells: dict[int, tuple], k: int) -> Column:
    """Of a query: the cell it likes best, a lower bound of its k-th score, and each cell's upper bound.

    cells: by vector length, the cells that have rows, their radius and the distances of their k + 1 inmost rows.
    """
    kind = pa.struct([("home", pa.int32()), ("least", pa.float64()), ("cells", pa.list_(pa.struct([("cell", pa.int32()), ("most", pa.float64())])))])

    @F.arrow_udf("struct<home: int, least: double, cells: array<struct<cell: int, most: double>>>")
    def of(vectors: pa.Array) -> pa.Array:
        out = []
        for x in vectors:
            d = len(x)
            if d not in pivots:
                out.append({"home": -1, "least": -np.inf, "cells": [{"cell": -1, "most": np.inf}]})
                continue
            ids, radius, inmost = cells[d]
            q = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
            at, norm = pivots[d][ids] @ q, np.sqrt(q @ q)
            spare = SLACK * (1 + np.abs(at) + norm * radius)
            # Of k + 1 rows that score so much one may be the query's own.
            low = np.sort((at - spare)[:, None] - norm * inmost, axis=None)[::-1]
            most = at + norm * radius + spare
            out.append({"home": int(ids[np.argmax(at)]), "least": float(low[k]) if len(low) > k else -np.inf, "cells": [{"cell": int(c), "most": float(m)} for c, m in zip(ids, most)]})
        return pa.array(out, kind)

    return of(v)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond a long are told as its limits."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q @ x.T
    ends = np.iinfo(np.int64)
    return np.clip(q.astype(object) @ x.astype(object).T, ends.min, ends.max).astype(np.int64)


class _Piece:
    """The rows of one piece of a cell, by id; rows that share an id are one row of its best score."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray):
        order = pa.compute.sort_indices(ids)
        self.ids, self.x = ids.take(order), vectors[order.to_numpy()]
        known = self.ids.to_pylist()
        self.starts = np.asarray([i for i in range(len(known)) if not i or known[i] != known[i - 1]], np.int64)
        self.at = {known[s]: i for i, s in enumerate(self.starts)}

    def best(self, asks: list, q: np.ndarray, least: np.ndarray, k: int) -> tuple[list, list, list]:
        """Query, id and score of the k best rows of each query, not its own and not below its least score."""
        who, which, scores = [], [], []
        found = _products(q, self.x)
        if len(self.starts) < len(self.ids):
            found = np.maximum.reduceat(found, self.starts, axis=1)
        for i, ask in enumerate(asks):
            row = found[i]
            good = np.flatnonzero(row >= least[i])
            own = self.at.get(ask)
            if own is not None:
                good = good[good != own]
            if len(good) > k:
                edge = np.partition(row[good], len(good) - k)[len(good) - k]
                over = good[row[good] > edge]
                good = np.concatenate([over, good[row[good] == edge][: k - len(over)]])  # rows stand by id
            who += [ask] * len(good)
            which.append(self.starts[good])
            scores.append(row[good])
        return who, which, scores


def _solve(k: int, block: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by (dims, cell, piece, asks): a piece's rows, then the queries that reach it."""
        key, held, piece = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in (*KEY, "asks")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(edges, edges[1:]):
                part, dims, asks = batch.slice(a, b - a), int(keys[a, 0]), keys[a, 3]
                if key != tuple(keys[a, :3]):
                    key, held, piece = tuple(keys[a, :3]), [], None
                if not asks:
                    held.append(part)
                    continue
                if not held and piece is None:
                    continue  # a cell's piece may be without rows
                if piece is None:
                    table = pa.Table.from_batches(held)
                    piece, held = _Piece(table.column("id").combine_chunks(), _matrix(table.column("v").combine_chunks(), dims)), []
                q, least, ids = _matrix(part.column("v"), dims), part.column("least").to_numpy(), part.column("id").to_pylist()
                for i in range(0, len(ids), block):
                    who, which, scores = piece.best(ids[i : i + block], q[i : i + block], least[i : i + block], k)
                    if who:
                        yield pa.RecordBatch.from_arrays([pa.array(who, piece.ids.type), piece.ids.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(scores))], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """The k rows of largest integer inner product with each row that `queries` selects: query_id, rank, vec_id, score.

    Components are floor(scale * x). Candidates are all rows of the query's vector length whose id is another; equal
    scores go to the smaller id; fewer than k candidates are all told. Vectors that are null or hold null or non-finite
    components, and null ids, take no part. Rows that share an id count as one, by the best score of its vectors, as
    query and as candidate. Vectors of no component score 0 with each other. Scores beyond a long are its limits. An
    empty table gives no rows; extra columns are ignored. Nothing is approximate: pivots decide only where work is done.
    """
    spark, ids = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    plain = vectors.select(F.col(id_col).alias("id"), integers(F.col(vector_col), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter("id is not null and v is not null")
    with Scratch(spark) as work:
        plain = work.saved(plain.withColumn("dims", F.size("v")), "integers")
        lengths = {r["dims"]: r["n"] for r in plain.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(LENGTHS).collect()}
        centres = {}
        for d, n in lengths.items():
            share = max(1, round(min(1.0, SAMPLE / n) * 1_000_000))
            rows = plain.filter((F.col("dims") == d) & (F.pmod(F.xxhash64("id", "v"), F.lit(1_000_000)) < share)).limit(2 * SAMPLE).select("v").collect()
            if rows and d:
                centres[d] = fit(np.asarray([r["v"] for r in rows], np.float64), pivots)
        rows = work.saved(plain.withColumn("x", _assigned(F.col("v"), centres)).select("dims", "x.*", "id", "v", "asks"), "cells")
        size = F.greatest(F.lit(LEAST_ROWS), (F.lit(PIECE) / F.greatest("dims", F.lit(1))).cast("int"))
        pieces = work.saved(rows.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).withColumn("pieces", F.ceil(F.col("n") / size).cast("int")), "pieces")
        nth = F.row_number().over(Window.partitionBy("dims", "cell").orderBy("dist"))
        inmost = rows.filter("cell >= 0").select("dims", "cell", "dist").withColumn("nth", nth).filter(F.col("nth") <= k + 1)
        # At most LENGTHS * PIVOTS cells.
        radii = {(r["dims"], r["cell"]): r["radius"] for r in pieces.filter("cell >= 0").collect()}
        near = {(r["dims"], r["cell"]): sorted(r["near"]) for r in inmost.groupBy("dims", "cell").agg(F.collect_list("dist").alias("near")).collect()}
        known = {}
        for d in centres:
            own = sorted(c for e, c in radii if e == d)
            inner = np.full((len(own), k + 1), np.inf)
            for i, c in enumerate(own):
                inner[i, : len(near[d, c])] = near[d, c]
            known[d] = (np.asarray(own), np.asarray([radii[d, c] for c in own]), inner)
        asked = work.saved(rows.filter("asks").select("dims", "id", "v").withColumn("b", _bounds(F.col("v"), centres, known, k)).select("dims", "id", "v", "b.*"), "queries")
        at = pieces.select("dims", "cell", "pieces")
        data = rows.join(at, ["dims", "cell"]).select("dims", "cell", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "v", F.lit(0).alias("asks"), F.lit(0.0).alias("least"))

        def solved(to: DataFrame, name: str) -> DataFrame:
            """to: dims, cell, id, v, least of queries."""
            sent = to.join(at, ["dims", "cell"]).select("dims", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "id", "v", F.lit(1).alias("asks"), "least")
            ordered = data.unionByName(sent).repartition(*KEY).sortWithinPartitions(*KEY, "asks")
            return work.saved(ordered.mapInArrow(_solve(k), f"query_id {ids}, vec_id {ids}, score long"), name)

        first = solved(asked.select("dims", F.col("home").alias("cell"), "id", "v", "least"), "home")
        best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        edge = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", best).filter(F.col("nth") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("edge"))
        raised = asked.join(edge, "id", "left").withColumn("least", F.greatest("least", F.coalesce("edge", F.lit(float("-inf")))))
        others = raised.select("dims", "id", "v", "least", "home", F.explode("cells").alias("c")).filter((F.col("c.cell") != F.col("home")) & (F.col("c.most") >= F.col("least")))
        rest = solved(others.select("dims", F.col("c.cell").alias("cell"), "id", "v", "least"), "others")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        both = first.unionByName(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return saved(both.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "products")[0]


def oracle(table: str = "embeddings", step: int = 50, k: int = 5, scale: int = 256) -> str:
    """DuckDB SQL for search() over rows whose vec_id is divisible by `step`."""
    return f"""
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM {table}
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
  FROM whole q JOIN whole c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % {step} = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= {k}"""
