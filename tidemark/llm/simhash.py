"""SimHash near-duplicates: fingerprints, a binary-trie self-join under a Hamming error budget, and components.

The self-join has to stay parallel, so some choices of bits each head one trie whose top levels, the chosen bits, have a
budget of zero errors. Spark deals the fingerprints out by (choice, agreeing bits), and each task walks its tries
pairwise. There are two ways to choose:

- by pigeonhole (near_duplicates): the 64 bits are cut into blocks; when at most `max_bits` bits differ, some choice of
  `blocks - max_bits` blocks agrees completely, so no link is lost.
- by sampling (similar): a Jaccard similarity of LEAST lets a bit differ with a known probability. Fingerprints have
  BITS bits, and random choices of bits are so many that a pair at LEAST agrees on one of them with a probability of
  RECALL, at every table size; pairs above LEAST do so more often.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, forget, saved

WORDS, MAX_BITS, SEED = 4, 4, 42
#: Shingles hashed at once, nodes compared at once, and fingerprints that one group keeps in one task.
CHUNK, FRONTIER, GROUP = 200_000, 1_000_000, 20_000
LEAF, PIVOTS = 64, 16
#: Similar documents: words in a shingle, the least Jaccard similarity, bits of a fingerprint, share of pairs at that
#: similarity that the choices of bits find, and fingerprints that agree by chance on one choice, about.
SIMILAR_WORDS, LEAST, BITS, RECALL, BY_CHANCE = 5, 0.8, 512, 0.99, 512
#: Standard deviations by which a distance may exceed the one expected at LEAST, in two steps: pairs that are alike almost
#: surely are joined before doubtful ones.
SLACK = (-1.0, 2.5)
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _fingerprint(text: bytes, k: int) -> bytes:
    import xxhash

    words = text.lower().split()
    if not words:
        return bytes(8)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    n = max(1, len(words) - k + 1)
    ends = ends[len(words) - n :] if len(words) >= k else [len(joined)]
    starts = [0, *(e + 1 for e in accumulate(map(len, words), lambda a, m: a + 1 + m))][:n]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """The 64-bit SimHash of a text's word shingles as a long; null and wordless texts give zero.

    A-Z are lower-cased, words are runs without ASCII white space, and a bit is set when over half of the XXH64
    values (seed 42) of all shingles, repeats included, have it. Fewer words than a shingle form one shingle.
    """

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).to_pylist()
        found = b"".join([_fingerprint(t, words) if t else bytes(8) for t in raw])
        return pa.array(np.frombuffer(found, ">i8").astype(np.int64))

    return of(text)


def _split(lo: np.ndarray, hi: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Where the bit turns to one in sorted ranges; ones: running count of set bits."""
    return hi - (ones[hi] - ones[lo])


def _cross(lo1, hi1, lo2, hi2) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of many small range pairs."""
    n2 = hi2 - lo2
    size = (hi1 - lo1) * n2
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    return lo1[owner] + at // n2[owner], lo2[owner] + at % n2[owner]


def trie_links(fps: np.ndarray, pairs: np.ndarray, budget: int, parent: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints that differ in at most `budget` bits, and in how many.

    fps (rows of uint64 words, the first bits highest) is sorted within each range; a range is a trie node. pairs has
    rows lo1, hi1, lo2, hi2: node pairs to walk together, a node with itself where both are equal. Each level splits
    both nodes on the next bit, adds one error where the branches differ, and drops pairs over the budget; small pairs
    are compared directly. parent, which the caller may change meanwhile, names the root of each fingerprint's tree:
    node pairs that are in one tree altogether are dropped, too.
    """
    deep, most = fps.shape[1] * 64, FRONTIER // fps.shape[1]
    stack = [(0, pairs, np.zeros(len(pairs), np.int64))]
    while stack:
        depth, nodes, errors = stack.pop()
        if len(nodes) > FRONTIER:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half], errors[:half]), (depth, nodes[half:], errors[half:])]
            continue
        if parent is not None:
            turns = np.cumsum(np.concatenate([[0], parent[1:] != parent[:-1]]))
            lo1, hi1, lo2, hi2 = nodes.T
            one = (turns[lo1] == turns[hi1 - 1]) & (turns[lo2] == turns[hi2 - 1]) & (parent[lo1] == parent[lo2])
            nodes, errors = nodes[~one], errors[~one]
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        small = (size <= LEAF * fps.shape[1]) | (depth == deep)
        if small.any():
            leaves, room = nodes[small], np.cumsum(size[small])
            begin = 0
            while begin < len(leaves):  # no more than about `most` comparisons at once
                end = max(begin + 1, int(np.searchsorted(room, (room[begin - 1] if begin else 0) + most)))
                a, b = _cross(*leaves[begin:end].T)
                apart = np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1, dtype=np.int64)
                near = (a != b) & (apart <= budget)
                yield a[near], b[near], apart[near]
                begin = end
        nodes, errors = nodes[~small], errors[~small]
        if not len(nodes):
            continue
        bit = (fps[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        lo1, hi1, lo2, hi2 = nodes.T
        mid1, mid2, own = _split(lo1, hi1, ones), _split(lo2, hi2, ones), lo1 == lo2
        rows = [
            (lo1, mid1, lo2, mid2, errors, None),
            (mid1, hi1, mid2, hi2, errors, None),
            (lo1, mid1, mid2, hi2, errors + 1, None),
            (mid1, hi1, lo2, mid2, errors + 1, ~own),  # a node with itself: the same pair as the line above
        ]
        kept, cost = [], []
        for a, b, c, d, e, only in rows:
            keep = (a < b) & (c < d) & (e <= budget)
            keep = keep if only is None else keep & only
            kept.append(np.stack([a[keep], b[keep], c[keep], d[keep]], axis=1))
            cost.append(e[keep])
        stack.append((depth + 1, np.concatenate(kept), np.concatenate(cost)))


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] in a forest whose roots are the smallest members."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, above := parent[parent]):
            parent[:] = above


Accept = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _forest(fps: np.ndarray, task: np.ndarray, piece: np.ndarray, budget: int, accept: Accept | None = None) -> np.ndarray:
    """The parent of each fingerprint in a forest that spans all links of complete groups.

    Rows are sorted by task (columns choice, key, i, j), piece and fingerprint. accept decides on index pairs within the
    budget and their distances. Large groups are compared with some pivots first: a group of near copies is then one
    tree, and the walk passes by its pairs.
    """
    edge = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]).any(axis=1), [True]]))
    lo, hi = edge[:-1], edge[1:]
    split = task[lo, -2] != task[lo, -1]
    second = (piece == task[:, -1]).astype(np.int64)
    mid = np.where(split, hi - np.add.reduceat(second, lo), lo)
    nodes = np.stack([lo, np.where(split, mid, hi), mid, hi], axis=1)
    nodes = nodes[(nodes[:, 1] > nodes[:, 0]) & (nodes[:, 3] > nodes[:, 2]) & (hi - lo > 1)]
    parent = np.arange(len(fps))
    for a, _, _, b in nodes[nodes[:, 3] - nodes[:, 0] > 64 * PIVOTS]:
        for pivot in np.linspace(a, b - 1, PIVOTS).astype(np.int64):
            apart = np.bitwise_count(fps[a:b] ^ fps[pivot]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero((apart <= budget) & (parent[a:b] != parent[pivot]))
            other, from_ = near + a, np.full(len(near), pivot)
            if accept is not None:
                fits = accept(from_, other, apart[near])
                other, from_ = other[fits], from_[fits]
            _union(parent, from_, other)
    for a, b, apart in trie_links(fps, nodes, budget, parent):
        new = parent[a] != parent[b]
        if accept is not None and new.any():
            at = np.flatnonzero(new)
            new[at] = accept(a[at], b[at], apart[at])
        _union(parent, a[new], b[new])
    return parent


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], n: int = 4) -> Iterator[dict[str, np.ndarray]]:
    """Columns of complete groups; rows come sorted by the first n columns, which name a group."""
    held: dict[str, list[np.ndarray]] = {c: [] for c in names}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
        last = tuple(now[c][-1] for c in names[:n])
        same = reduce(np.logical_and, (now[c] == v for c, v in zip(names, last)))
        cut = int(np.argmax(same))  # the last group may go on in the next batch
        if cut or (held[names[0]] and tuple(held[c][-1][-1] for c in names[:n]) != last):
            yield {c: np.concatenate([*held[c], now[c][:cut]]) for c in names}
            held = {c: [] for c in names}
        for c in names:
            held[c].append(now[c][cut:])
    if held[names[0]]:
        yield {c: np.concatenate(held[c]) for c in names}


TASK = ("choice", "key", "i", "j")


def _tasks(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, (*TASK, "piece", "fp")):
            fps = columns["fp"].view(np.uint64) ^ np.uint64(1 << 63)  # Spark sorts longs as signed
            parent = _forest(fps[:, None], np.stack([columns[c] for c in TASK], axis=1), columns["piece"], budget)
            child = np.flatnonzero(parent != np.arange(len(fps)))
            yield pa.RecordBatch.from_arrays([pa.array(columns["fp"][child]), pa.array(columns["fp"][parent[child]])], ["a", "b"])

    return run


def _dealt(keyed: DataFrame, by: str, work: Scratch) -> DataFrame:
    """Rows with columns choice and key, as tasks: sorted by choice, key, i, j, piece and `by`.

    Groups beyond GROUP rows are dealt out as pairs of pieces, each to a task of its own. Such groups are few; they go
    to all executors only where they are, and meet the rows in a shuffle join else.
    """
    large = work.saved(keyed.groupBy("choice", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") > GROUP), "large")
    large = F.broadcast(large) if large.count() <= 10_000 else large.hint("merge")
    pieces = F.coalesce(F.ceil(F.col("rows") / GROUP), F.lit(1)).cast("int")
    dealt = (
        keyed.join(large, ["choice", "key"], "left")
        .withColumn("pieces", pieces)
        .withColumn("piece", F.pmod(F.xxhash64(by), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumns({"i": F.least("piece", "other"), "j": F.greatest("piece", "other")})
        .drop("rows", "pieces", "other")
    )
    return dealt.repartition(*TASK).sortWithinPartitions(*TASK, "piece", by)


def _choices(n: int, budget: int) -> list[int]:
    """Masks of agreeing bits: all choices of blocks - budget blocks, with blocks so many that groups stay small."""
    for blocks in range(budget + 1, budget + 5):
        agree = blocks - budget
        if n >> (64 * agree // blocks) < 2_000:
            break
    edges = [64 * b // blocks for b in range(blocks + 1)]
    part = [((1 << (edges[b + 1] - edges[b])) - 1) << (64 - edges[b + 1]) for b in range(blocks)]
    masks = [sum(part[b] for b in chosen) for chosen in combinations(range(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(fps: DataFrame, work: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that span all pairs of distinct fingerprints `fp` differing in at most max_bits bits.

    Every such pair ends up connected, though within a group only the links of a spanning forest are returned, so
    that a large group of near copies doesn't give all its pairs.
    """
    masks = _choices(fps.count(), max_bits)
    keyed = fps.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])).alias("k"), "fp"
    ).select("k.choice", "k.key", "fp")
    return _dealt(keyed, "fp", work).mapInArrow(_tasks(max_bits), "a long, b long")


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """(node, root): the smallest node of the connected component of every node in links (a, b).

    Alternates large-star and small-star steps. Each is a minimum per node, combined before its shuffle, and a join
    whose other side has one row per node, so that a hub's links are never gathered in one task.
    """
    spark = links.sparkSession
    edges, path = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(u, v) as decimal(20,0)))")).first()
    before = state(edges)
    for _ in range(100):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        following, new_path = saved(small.filter("u <> v").distinct(), "links")
        now = state(following)
        forget(spark, path)
        edges, path = following, new_path
        if now == before:
            work.paths.append(path)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, `fingerprint` (long), `text_hash` (XXH64 of the text) and `component_id`.

    component_id is the smallest id that links reach, the document's own included. Null and wordless texts have
    fingerprint zero, linked like any other. Null ids never are a smallest id unless all of a component are null.
    Repeated rows stay repeated; an empty table gives no rows; other columns of docs are ignored.
    """
    rows, _ = saved(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), words).alias("fp"), F.xxhash64(F.col(text_col)).alias("text_hash")), "fingerprints")
    with Scratch(docs.sparkSession) as work:
        classes = work.saved(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
        found = components(near_links(classes.select("fp"), work, max_bits), work)
        member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        first = member.join(classes, member["node"] == classes["fp"]).groupBy("root").agg(F.min("first").alias("component"))
        linked = member.join(first, "root").select(F.col("node").alias("fp"), "component")
        of_class, _ = saved(classes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id")), "members")
    return rows.join(of_class, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "text_hash", "component_id")


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; A-Z are lower-cased, fewer than k words are one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest, n = b" ".join(words), xxhash.xxh64_intdigest, max(1, len(words) - k + 1)
    ends = list(accumulate(map(len, words), lambda a, m: a + 1 + m))
    starts = [0, *(e + 1 for e in ends)][:n]
    ends = ends[len(words) - n :] if len(words) >= k else [len(joined)]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def wide_fingerprint(found: np.ndarray) -> bytes:
    """The SimHash of BITS bits of a set of shingles, whose hashes are mixed to so many bits; zero of an empty set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 255 * 32):
        mixed = found[at : at + 255 * 32, None] * _FACTORS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1)
        full = len(bits) // 255 * 255  # so many bytes add up within a byte
        ones += bits[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).tobytes()


def _signed(text: Column, words: int) -> Column:
    """fp (binary), n (distinct shingles) and node (a hash of the set of shingles) of a text."""
    import xxhash

    kind = pa.struct([("fp", pa.binary()), ("n", pa.int64()), ("node", pa.int64())])

    @arrow_udf("struct<fp: binary, n: long, node: long>")
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for raw in texts.cast(pa.binary()):
            found = shingles(raw.as_py() or b"", words)
            rows.append({"fp": wide_fingerprint(found), "n": len(found), "node": int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))})
        return pa.array(rows, kind)

    return of(text)


def _differing(least: float) -> float:
    """The probability that a bit differs between equally large sets of that Jaccard similarity."""
    return math.acos(2 * least / (1 + least)) / math.pi


def _sampled(n: int, least: float, recall: float) -> np.ndarray:
    """Choices of bits, one a row: so many bits that about BY_CHANCE of n agree on them, so many choices that recall holds."""
    bits = max(4, math.ceil(math.log2(max(2, n) / BY_CHANCE)))
    times = math.ceil(math.log(1 - recall) / math.log(1 - (1 - _differing(least)) ** bits))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(BITS, bits, replace=False) for _ in range(times)])


def _nearest_first(parent: np.ndarray, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which pairs join trees of a forest, those of the smallest key first (as Boruvka chooses them); parent is changed.

    Where keys are equal some pairs may be chosen besides that close a circle.
    """
    chosen, left = [], np.flatnonzero(parent[a] != parent[b])
    while len(left):
        x, y = parent[a[left]], parent[b[left]]
        ends, at = np.concatenate([x, y]), np.concatenate([np.arange(len(left))] * 2)
        order = np.lexsort((key[left][at], ends))
        first = order[np.concatenate([[True], ends[order][1:] != ends[order][:-1]])]
        best = left[np.unique(at[first])]
        chosen.append(best)
        _union(parent, a[best], b[best])
        left = left[parent[a[left]] != parent[b[left]]]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


class _Alike:
    """Decides on pairs at a distance, by that and the sizes of their sets, and keeps those that span what it decides."""

    def __init__(self, sizes: np.ndarray, nodes: np.ndarray, least: float):
        self.sizes, self.nodes, self.least, self.parent, self.kept = sizes, nodes, least, np.arange(len(sizes)), []

    def within(self, slack: float) -> Accept:
        p = _differing(self.least)
        spare = slack * math.sqrt(BITS * p * (1 - p))

        def accept(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
            n, m = self.sizes[a], self.sizes[b]
            both = np.minimum(np.cos(np.maximum(0, apart - spare) / BITS * math.pi) * np.sqrt(n * m), np.minimum(n, m))
            fits = (both >= self.least * (n + m - both) - 1e-9) & (np.minimum(n, m) >= self.least * np.maximum(n, m) - 1e-9)
            x, y = a[fits], b[fits]
            # Of equal distances the same pair in every task, so that tasks agree on links.
            tie = (np.minimum(self.nodes[x], self.nodes[y]) >> 1) / 2.0**63
            i = _nearest_first(self.parent, x, y, apart[fits] + tie)
            self.kept.append((x[i], y[i]))
            return fits

        return accept

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([k[i] for k in self.kept]) for i in (0, 1)) if self.kept else (np.zeros(0, int),) * 2
        return self.nodes[a], self.nodes[b]


def similar_links(classes: DataFrame, work: Scratch, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """Links (a, b) of the column `node` that span all pairs of classes (fp, n) that may be alike, the likeliest first."""
    choices = _sampled(classes.count(), least, recall)
    p = _differing(least)
    budget = int(BITS * max(p, 3 / 16) + 3 * math.sqrt(BITS * p * (1 - p)))  # 3/16: five shingles, four of them shared

    @arrow_udf("array<long>")
    def keys(fps: pa.Array) -> pa.Array:
        bits = np.unpackbits(np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1), axis=1)
        found = np.stack([bits[:, c] @ (1 << np.arange(len(c), dtype=np.int64)) for c in choices], axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, len(choices), dtype=np.int32)), pa.array(found.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, (*TASK, "piece", "fp", "n", "node")):
            fps = np.frombuffer(b"".join(columns["fp"]), ">u8").astype(np.uint64).reshape(-1, BITS // 64)
            alike, task = _Alike(columns["n"].astype(np.float64), columns["node"], least), np.stack([columns[c] for c in TASK], axis=1)
            for slack in SLACK:
                _forest(fps, task, columns["piece"], min(budget, int(BITS * p + slack * math.sqrt(BITS * p * (1 - p)))) if slack < 0 else budget, alike.within(slack))
            a, b = alike.links()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    keyed = classes.select(F.posexplode(keys(F.col("fp"))).alias("choice", "key"), "fp", "n", "node")
    return _dealt(keyed, "fp", work).mapInArrow(run, "a long, b long").distinct()


def _confirmed(links: DataFrame, docs: DataFrame, words: int, least: float, work: Scratch) -> DataFrame:
    """The links (a, b) whose sets have a Jaccard similarity of `least` and more, by the sets themselves.

    docs: node and text of the documents that links name; texts of a node may be repeated, for they have the same set.
    """
    @arrow_udf("binary")
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py() or b"", words).tobytes() for t in texts.cast(pa.binary())], pa.binary())

    @arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(both >= least * (len(p) + len(q) - both) - 1e-9)
        return pa.array(out, pa.bool_())

    taken = docs.select("node", sets(F.coalesce("text", F.lit(""))).alias("s"))
    known = work.saved(taken.groupBy("node").agg(F.min("s").alias("s")), "sets")
    of = lambda end, name: known.select(F.col("node").alias(end), F.col("s").alias(name))
    return links.join(of("a", "p"), "a").join(of("b", "q"), "b").filter(alike("p", "q")).select("a", "b")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(id, th, component): each document's id, XXH64 of its text, and its component of linked documents.

    Two documents are linked when their sets of word shingles have a Jaccard similarity of `least`. Fingerprints of BITS
    bits tell which pairs may have, within SLACK standard deviations; of these, links that span them, the likeliest
    first, are confirmed by the sets themselves, at every size. Equal sets are one node. Null and wordless texts have the
    empty set. Repeated rows stay repeated; no rows give none; other columns are ignored. README.md states the recall
    measured against exact similarities; what is linked is linked by confirmed links alone.
    """
    kinds = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), _signed(F.col(text_col), words).alias("s"))
    with Scratch(docs.sparkSession) as work:
        signed = work.saved(kinds.select("id", "th", "s.*"), "signed")
        rows, _ = saved(signed.select("id", "th", "node"), "rows")
        classes = work.saved(signed.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n")), "classes")
        links = work.saved(similar_links(classes, work, least, recall), "maybe")
        wanted = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        of_text = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"))
        texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).join(of_text, "th")
        sure = _confirmed(links, texts, words, least, work)
        found, _ = saved(components(sure, work), "components")
    return rows.join(found, "node", "left").select("id", "th", F.coalesce("root", "node").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """The documents without those similar to another: of each component the one with the smallest id (then text hash).

    All columns are kept. Of rows that repeat both id and text one stays. Documents with a null id lose to those that
    have one. Null and wordless texts are copies of each other.
    """
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"))
    best = similar(docs, id_col, text_col, words, least, recall).groupBy("component").agg(F.min(order).alias("w"))
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    # Keys without nulls, so that one shuffle of the documents serves the join and the choice among repeated rows.
    keyed = lambda id_, th: [F.coalesce(id_, zero).alias("_tm_id"), id_.isNull().alias("_tm_none"), th.alias("_tm_hash")]
    names = ["_tm_id", "_tm_none", "_tm_hash"]
    kept, _ = saved(best.select(*keyed(F.col("w.id"), F.col("w.th"))).distinct(), "kept")
    marked = docs.select("*", *keyed(F.col(id_col), F.xxhash64(text_col)))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(1)))
    return marked.join(kept.hint("merge"), names, "left_semi").withColumn("_tm_nth", nth).filter("_tm_nth = 1").select(*docs.columns)
