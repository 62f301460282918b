"""Names that are most alike among many, ranked as Python's difflib does.

Blocks of names meet ranges of others, a task for each two. difflib's matching blocks are a common subsequence, so that
its longest length bounds the ratio from above; it is told along a trie of the range's names, for all names of a block
at once, and a branch ends for a name that nothing below can come near to. Only what is left, the most promising first,
is compared by difflib.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from itertools import groupby
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut

#: Names in a block or range, and how many pairs a task holds before it ranks them.
BLOCK, HELD = 8192, 500_000
_ones = np.frompyfunc(int.bit_count, 1, 1)


class _Asked:
    """The names of a block, their nearest so far, and the letters of a name that they have in common with others."""

    def __init__(self, names: list[str], least: float, most: int):
        self.names, self.least, self.most = names, least, most
        self.lengths = np.array([len(n) for n in names])
        self.long = bool(len(names)) and int(self.lengths.max()) > 63  # then bits are those of Python's integers
        self.kind = object if self.long else np.uint64
        found = {}
        for i, name in enumerate(names):
            own = {}
            for j, c in enumerate(name):
                own[c] = own.get(c, 0) | 1 << j
            for c, bits in own.items():
                at, masks = found.setdefault(c, ([], []))
                at.append(i)
                masks.append(bits)
        self.letters = {c: (np.array(at), np.array(masks, self.kind)) for c, (at, masks) in found.items()}
        self.best = [[] for _ in names]

    def bits(self, count: np.ndarray) -> np.ndarray:
        """So many low bits set."""
        return np.array([(1 << int(n)) - 1 for n in count], object) if self.long else (np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)

    def ahead(self, live: np.ndarray, v: np.ndarray, letter: str) -> np.ndarray:
        """Bits that are zero where the longest common subsequence grows, one letter further (Hyyrö)."""
        if letter not in self.letters:
            return v
        at, masks = self.letters[letter]
        place = np.minimum(np.searchsorted(at, live), len(at) - 1)
        u = v & np.where(at[place] == live, masks[place], self.kind(0) if not self.long else 0)
        v = (v + u) | (v - u)
        return v & self.bits(self.lengths[live]) if self.long else v

    def reachable(self, live: np.ndarray, v: np.ndarray, rest: int) -> np.ndarray:
        """The most letters in common when `rest` more follow: those of the name before its last `rest`, and these."""
        head = np.maximum(self.lengths[live] - rest, 0)
        ones = v & self.bits(head)
        ones = _ones(ones).astype(np.int64) if self.long else np.bitwise_count(ones).astype(np.int64)
        return head - ones + np.minimum(rest, self.lengths[live])

    def floors(self, length: int, name: str) -> np.ndarray:
        """Letters in common with names of that length, not above `name`, from which on they may be among the nearest."""
        out = np.ceil(self.least * (self.lengths + length) / 2 - 1e-9).astype(np.int64)
        for i, best in enumerate(self.best):
            if len(best) == self.most:
                half = best[-1][0] * (len(self.names[i]) + length) / 2
                out[i] = max(out[i], math.floor(half + 1e-9) + 1 if name <= best[-1][1] else math.ceil(half - 1e-9))
        return out

    def rank(self, live: np.ndarray, at: np.ndarray, common: np.ndarray, length: int, names: list[str]) -> None:
        """Compares pairs (names in descending order), the most promising first, until no other can be nearer."""
        order = np.lexsort((at, -common, live))
        live, at, common = live[order], at[order], common[order]
        starts = np.flatnonzero(np.diff(live, prepend=-1)).tolist() + [len(live)]
        matcher = SequenceMatcher()
        for start, stop in zip(starts, starts[1:]):
            i = int(live[start])
            matcher.set_seq2(self.names[i])
            best, total = self.best[i], len(self.names[i]) + length
            for j in range(start, stop):
                other = names[at[j]]
                if len(best) == self.most and (2.0 * int(common[j]) / total, other) <= best[-1]:
                    break
                matcher.set_seq1(other)
                ratio = matcher.ratio()
                if ratio >= self.least:
                    best.append((ratio, other))
                    best.sort(reverse=True)
                    del best[self.most :]

    def meet(self, length: int, names: list[str]) -> None:
        """Goes along the trie of names of one length, in descending order."""
        floor = self.floors(length, names[0])
        every = np.arange(len(self.names))
        stack, before, held, size = [(every, self.bits(self.lengths))], "", [], 0
        for at, name in enumerate(names):
            del stack[len(commonprefix((before, name))) + 1 :]
            before = name
            while len(stack) <= length and len(stack[-1][0]):
                live, v = stack[-1]
                v = self.ahead(live, v, name[len(stack) - 1])
                near = self.reachable(live, v, length - len(stack)) >= floor[live]
                stack.append((live[near], v[near]))
            live, v = stack[-1]
            if len(stack) > length and len(live):
                held.append((live, np.full(len(live), at), self.reachable(live, v, 0)))
                size += len(live)
            if size >= HELD:
                self.rank(*map(np.concatenate, zip(*held)), length, names)
                floor, held, size = self.floors(length, name), [], 0
        if held:
            self.rank(*map(np.concatenate, zip(*held)), length, names)


def _met(least: float, most: int):
    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = sorted(right["b"].to_pylist(), key=lambda b: (len(b), b), reverse=True)
        rows, asked = [], left["a"].to_pylist()
        for names in ([a for a in asked if len(a) < 64], [a for a in asked if len(a) >= 64]):
            block = _Asked(names, least, most)
            for length, group in groupby(ordered, key=len) if names else ():
                block.meet(length, list(group))
            rows += [(a, b, ratio) for a, best in zip(names, block.best) for ratio, b in best]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("a", pa.string()), ("b", pa.string()), ("ratio", pa.float64())))})

    return of


def ranged(names: DataFrame) -> DataFrame:
    """(b, range): distinct names (b) in ranges by length and alphabet, for nearest()."""
    parts = max(1, -(-names.count() // BLOCK))
    return cut(names.select("b", F.length("b").alias("n")).repartitionByRange(parts, "n", "b").select("b", F.spark_partition_id().alias("range")))


def nearest(left: DataFrame, right: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b, ratio): of each distinct name a of left the `most` names of ranged() b with the greatest ratios of `least`
    and more, ties to the larger name."""
    blocks = max(1, -(-left.count() // BLOCK))
    ends = right.groupBy(F.col("range").alias("among")).agg(F.min(F.length("b")).alias("low"), F.max(F.length("b")).alias("high"))
    n, far = F.length("a"), (2 - least) / least
    fits = (F.col("high") * far >= n - 1e-6) & (F.col("low") <= n * far + 1e-6)
    asked = left.select("a", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int").alias("block")).join(F.broadcast(ends), on=fits)
    known = right.select("b", "range", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    cells = min(blocks * max(1, right.select("range").distinct().count()), 4096)
    dealt = [df.repartition(cells, "block", key).groupBy("block", key) for df, key in ((asked.select("a", "block", "among"), "among"), (known, "range"))]
    met = dealt[0].cogroup(dealt[1]).applyInArrow(_met(least, most), "a string, b string, ratio double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("ratio"), F.desc("b")))
    return met.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")
