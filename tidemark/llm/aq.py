"""Nearest neighbours by additive quantisation: full-dimensional residual codebooks, beam-search codes, stored norms,
look-up-table scores and exact reranking.

A unit vector is approximated by a sum of one codeword of each book. The codes and the sum's norm are all that a scan
reads: a query's scores are sums over a table of its inner products with all codewords. A first scan finds some good
candidates, whose exact cosines say how good the k-th neighbour is at least. A second scan lets all candidates through
whose approximate score comes within a margin of that, and these are reranked by their exact cosine. The margin is what
held-back vectors of the sample show as errors, so that the number of candidates follows from the data and has no cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, saved

#: Codebooks, codewords in each, and kept partial sums while encoding.
BOOKS, WORDS, BEAM = 16, 256, 4
#: Share of true neighbours whose error the margin covers, and candidates of a first look.
COVERED, FIRST = 0.995, 32
#: Vectors that training reads at most, passes of k-means for each book, and joint refinements of all books.
SAMPLE, PASSES, REFINE = 16_384, 8, 1
#: Codes and queries in a block; each pair of blocks is one piece of work.
CODE_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Rows scored at once.
CHUNK = 2_048


@dataclass
class Codebooks:
    """books: BOOKS x WORDS x dimensions, float32."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) of unit vectors and the norms of what they stand for; a beam of partial sums is kept."""
        codes, norms = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x), np.float32)
        for at in range(0, len(x), CHUNK):
            rest = x[at : at + CHUNK, None, :].astype(np.float32)
            n, d = rest.shape[0], rest.shape[2]
            path = np.zeros((n, 1, 0), np.uint8)
            for book in self.books:
                error = (book**2).sum(axis=1) - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, rest.shape[1], len(book)) + (rest**2).sum(axis=2)[:, :, None]
                flat = error.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                source, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, source[:, :, None], 1) - book[word]
                path = np.concatenate([np.take_along_axis(path, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
            first = np.argmin((rest**2).sum(axis=2), axis=1)
            chosen = np.arange(n), first
            codes[at : at + n] = path[chosen]
            norms[at : at + n] = np.linalg.norm(x[at : at + n] - rest[chosen], axis=1)
        return codes, norms

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products with all codewords: queries x books x words."""
        return np.einsum("qd,bwd->qbw", queries.astype(np.float32), self.books, optimize=True)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)] + rng.standard_normal((k, x.shape[1])).astype(np.float32) * 1e-4
    for _ in range(PASSES):
        near = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        size = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        edges = np.concatenate([[0], np.cumsum(size)[:-1]])
        full = size > 0
        centres[full] = np.add.reduceat(x[order], edges[full], axis=0) / size[full][:, None]
        if not full.all():
            centres[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 42) -> Codebooks:
    """Residual k-means for each book in turn, then all books together by least squares over beam-search codes."""
    rng, rest, found = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        book = _k_means(rest, words, rng)
        found.append(book)
        rest = rest - book[np.argmin((book**2).sum(axis=1) - 2 * (rest @ book.T), axis=1)]
    model = Codebooks(np.stack(found))
    for _ in range(REFINE):
        codes, _ = model.encode(x)
        at = codes.astype(np.int64) + np.arange(books) * words
        pairs = np.zeros((books * words, books * words), np.float32)
        for a in range(books):
            for b in range(books):
                np.add.at(pairs, (at[:, a], at[:, b]), 1)
        sums = np.zeros((books * words, x.shape[1]), np.float32)
        for a in range(books):
            np.add.at(sums, at[:, a], x)
        start = model.books.reshape(books * words, -1)
        pairs[np.diag_indices(len(pairs))] += 1  # drawn to where it was
        solved = np.linalg.solve(pairs, sums + start)
        model = Codebooks(solved.reshape(model.books.shape).astype(np.float32))
    return model


def margin(model: Codebooks, x: np.ndarray, k: int) -> float:
    """How far a true neighbour's approximate score may be below its exact one, from unit vectors that training didn't see."""
    asked = x[:256]
    exact = asked @ x.T
    codes, norms = model.encode(x)
    tables, near = model.tables(asked), np.zeros(exact.shape, np.float32)
    for b in range(codes.shape[1]):
        near += tables[:, b, :][:, codes[:, b]]
    near /= norms
    own = np.arange(len(asked))
    exact[own, own] = near[own, own] = -2
    k = min(k, len(x) - 1)
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    lost = np.take_along_axis(exact, best, 1) - np.take_along_axis(near, best, 1)
    return float(max(0, np.quantile(lost, COVERED)))


def _valid(vector: Column) -> Column:
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda v: v != 0)


def _scaled(vector: Column) -> Column:
    """The vector times a power of two that brings its largest component near 1, so that no square over- or underflows."""
    most = F.array_max(F.transform(vector, F.abs))
    power = F.greatest(F.lit(-1000.0), F.least(F.lit(1000.0), -F.floor(F.log2(most)).cast("double")))
    return F.transform(vector, lambda v: v * F.pow(F.lit(2.0), power))


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v * v))


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", books: int = BOOKS) -> DataFrame:
    """The k vectors of largest cosine found for each row that `queries` selects: query_id, rank, vec_id and score.

    Candidates are all rows of the query's vector length but those of its own id. score is the exact cosine in double
    precision; of equal scores the smaller id comes first. Null, empty, zero or non-finite vectors, and null ids, take
    no part; rows that repeat id and vector count once. Equal vectors (up to a power of two) are indexed once and their
    smallest k + 1 ids stand for all of them, which loses nothing. An empty table gives no rows; extra columns are
    ignored. README.md states the recall measured at several sizes.
    """
    spark = vectors.sparkSession
    ids = vectors.schema[id_col].dataType.simpleString()
    plain = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0)).alias("v"), queries.alias("asks")).filter(_valid(F.col("v")))
    with Scratch(spark) as work:
        plain = work.saved(plain.withColumn("v", _scaled(F.col("v"))).withColumn("key", F.xxhash64("v")).dropDuplicates(["id", "v"]), "vectors")
        found = None
        for (d,) in plain.select(F.size("v")).distinct().collect():
            one = _search(plain.filter(F.size("v") == d), k, ids, books, work)
            found = one if found is None else found.unionByName(one)
        if found is None:
            return spark.createDataFrame([], f"query_id {ids}, rank int, vec_id {ids}, score double")
        return saved(found, "neighbours")[0]


def _search(plain: DataFrame, k: int, ids: str, books: int, work: Scratch) -> DataFrame:
    """search() over valid vectors of one length: id, v, asks and key."""
    nth = F.row_number().over(Window.partitionBy("key", "v").orderBy("id"))
    members = work.saved(plain.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("key", "v", "id", "nth"), "members")
    single = members.filter("nth = 1").select(F.col("id").alias("rep"), "v", F.xxhash64("id").alias("at"))
    n = single.count()
    part = min(1.0, SAMPLE / n)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    sample = single.filter(F.pmod("at", F.lit(1_000_000)) < int(part * 1_000_000) + 1).limit(2 * SAMPLE).select("v").toPandas()["v"]
    sample = unit(np.stack(sample.to_list()).astype(np.float64)).astype(np.float32)
    held = max(k + 2, len(sample) // 4) if len(sample) > 4 * WORDS else 0
    model = fit(sample[held:], books)
    spare = margin(model, sample[:held] if held else sample, k) if len(sample) > 1 else 0.0
    blocks = -(-n // CODE_BLOCK)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes, norms = model.encode(unit(x).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], names=["rep", "code", "norm"])

    codes = work.saved(single.select("rep", "v").mapInArrow(encode, f"rep {ids}, code binary, norm float"), "codes")
    asked = work.saved(plain.filter("asks").groupBy("key", "v").agg(F.min("id").alias("query")), "queries")
    askers = -(-max(1, asked.count()) // QUERY_BLOCK)
    grid = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def scan(codes: pa.Table, asked: pa.Table) -> pa.Table:
        """Pairs of a block of queries and one of codes: the FIRST best, or those above the queries' edges where known."""
        kinds = {"query": asked.column("query").type, "rep": codes.column("rep").type, "near": pa.float32()}
        if not codes.num_rows or not asked.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        codes = codes.sort_by("rep")
        c = np.frombuffer(b"".join(codes.column("code").to_pylist()), np.uint8).reshape(codes.num_rows, -1)
        norms = np.maximum(codes.column("norm").to_numpy(), np.float32(1e-12))
        v = unit(asked.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asked.num_rows, -1))
        edges = asked.column("edge").to_numpy() if "edge" in asked.column_names else None
        found = []
        for at in range(0, asked.num_rows, 128):
            tables = model.tables(v[at : at + 128])
            total = np.zeros((len(tables), len(c)), np.float32)
            for row in range(0, len(c), CHUNK):
                for b in range(c.shape[1]):
                    total[:, row : row + CHUNK] += tables[:, b, :][:, c[row : row + CHUNK, b]]
            total /= norms
            if edges is not None:
                i, j = np.nonzero(total >= edges[at : at + 128, None])
            elif len(c) > FIRST:
                j = np.sort(np.argpartition(-total, FIRST - 1, axis=1)[:, :FIRST], axis=1)
                i, j = np.repeat(np.arange(len(total)), FIRST), j.ravel()
            else:
                i, j = np.divmod(np.arange(total.size), len(c))
            found.append((i + at, j, total[i, j]))
        q, r, s = map(np.concatenate, zip(*found))
        return pa.table([asked.column("query").take(pa.array(q)), codes.column("rep").take(pa.array(r)), pa.array(s, pa.float32())], names=list(kinds))

    def scanned(queries: DataFrame, name: str) -> DataFrame:
        left, right = grid(codes, "c", blocks, "q", askers).groupBy("c", "q"), grid(queries, "q", askers, "c", blocks).groupBy("c", "q")
        return work.saved(left.cogroup(right).applyInArrow(scan, f"query {ids}, rep {ids}, near float"), name)

    of_query = asked.select("query", F.col("v").alias("qv"))
    of_rep = members.filter("nth = 1").select(F.col("id").alias("rep"), "key", F.col("v").alias("rv"))
    dot = F.aggregate(F.zip_with("qv", "rv", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    exact = lambda pairs: pairs.join(of_query, "query").join(of_rep, "rep").withColumn("score", dot / (_norm(F.col("qv")) * _norm(F.col("rv"))))
    # How good the k-th neighbour is at least; of the k + 1 best classes one may be the query's own.
    by_near = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "rep"))
    first = scanned(asked.select("query", "v"), "first").withColumn("nth", by_near).filter(F.col("nth") <= FIRST).select("query", "rep")
    by_score = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    kth = exact(first).select("query", "rep", "score").withColumn("nth", by_score).filter(F.col("nth") == k + 1).select("query", (F.col("score") - F.lit(spare)).alias("edge"))
    edged = asked.select("query", "v").join(kth, "query", "left").select("query", "v", F.coalesce("edge", F.lit(-2.0)).cast("float").alias("edge"))
    # Exact: cosines of distinct vectors, then the ids that have them, then the rows that ask.
    scored = exact(scanned(work.saved(edged, "edges"), "near").select("query", "rep"))
    # Of k + 1 nearest classes the query's own may be one that holds nothing but the query.
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))
    top = scored.withColumn("nth", best).filter(F.col("nth") <= F.lit(2 * k + 2)).select("query", "rep", "key", F.col("rv").alias("v"), "score")
    expanded = top.join(members.select("key", "v", "id"), ["key", "v"]).select("query", "id", "score")
    kept = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    expanded = expanded.withColumn("nth", kept).filter(F.col("nth") <= k + 1).select("query", "id", "score")
    rows = plain.filter("asks").select("key", "v", F.col("id").alias("query_id")).join(asked, ["key", "v"]).select("query", "query_id")
    final = rows.join(expanded, "query").filter(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return final.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def brute_force(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, k: int = 5) -> dict[int, list[int]]:
    """For measuring recall on a small table: the exact neighbours of each asking row."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for i in np.flatnonzero(asks):
        s = x @ x[i]
        order = np.lexsort((ids, -s))
        found[int(ids[i])] = [int(ids[j]) for j in order if j != i][:k]
    return found
