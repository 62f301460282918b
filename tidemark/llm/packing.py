"""Hierarchical packing: documents go to context-size tiers, each tier is packed, long windows are filled from shorter
tiers, and full sequences are dealt to balanced step groups.

Packing needs no shuffle: each task packs the documents of its own input partition, in pools of bounded size, and only
the last windows of a task can stay partly empty. A task that is run again gives the same sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import TOKENIZER, tokenizer_path

#: Window sizes, shortest first, and tokens of a step group. Powers of two need no padding of their own.
TIERS, STEP_TOKENS, END_ID = (256, 512, 1024), 16_384, 0
#: Tokens that wait in a task's pool before they are packed.
POOL_TOKENS = 2_000_000
#: Rows of one result batch, and texts encoded at once.
OUT_ROWS, TEXTS = 20_000, 64


def encoder(path: str):
    """The ids of a text under a tokenizers file with byte-level BPE, by tiktoken's faster engine over its ranks.

    The vocabulary and merges must be such that ids follow the merge order; special tokens in a text count as such.
    The engine's regular expressions give up on runs of about a million white-space characters; such texts go to the
    tokenizers library.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from .bpe import PATTERN, _byte_alphabet

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    found = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    slower = cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        try:
            return found.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return np.array(slower().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


class _Pool:
    """Remainders of one tier by length; the longest that fits is found by bisection."""

    def __init__(self):
        self.lengths: list[int] = []
        self.by_length: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> None:
        n = piece[2]
        if not self.by_length[n]:
            insort(self.lengths, n)
        self.by_length[n].append(piece)

    def take(self, at: int) -> tuple:
        n = self.lengths[at]
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.lengths.pop(at)
        return piece

    def fitting(self, room: int) -> tuple | None:
        at = bisect_right(self.lengths, room) - 1
        return self.take(at) if at >= 0 else None

    def __bool__(self) -> bool:
        return bool(self.lengths)

    def drain(self) -> Iterator[tuple]:
        while self.lengths:
            yield self.take(-1)


def pack(pieces: list[tuple], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[tuple[int, list[tuple]]], list[tuple]]:
    """Packs pieces (doc, start, length, ids), none longer than the longest tier, into windows.

    Returns (window size, pieces) per sequence and the pieces left over. A piece belongs to the shortest tier that holds
    it. Windows are filled with the longest pieces that fit, own tier first, then shorter ones; what still gapes is
    closed by cutting the longest shorter piece, whose rest goes back to its tier. Windows that can't be filled are left
    over, or with `last` share windows of the longest tier, which alone may stay partly empty.
    """
    pools = {t: _Pool() for t in tiers}

    def add(piece: tuple) -> None:
        pools[next(t for t in tiers if piece[2] <= t)].add(piece)

    for p in pieces:
        add(p)
    done: list[tuple[int, list[tuple]]] = []
    left: list[tuple] = []
    for n, tier in reversed(list(enumerate(tiers))):
        while pools[tier]:
            held, room = [pools[tier].take(-1)], tier
            room -= held[0][2]
            for source in reversed(tiers[: n + 1]):
                while room and (p := pools[source].fitting(room)):
                    held.append(p)
                    room -= p[2]
            if room:
                for source in reversed(tiers[: n + 1]):
                    if pools[source]:  # all of its pieces are longer than the room
                        doc, start, length, ids = pools[source].take(-1)
                        held.append((doc, start, room, ids[:room]))
                        add((doc, start + room, length - room, ids[room:]))
                        room = 0
                        break
            if room:
                left += held
            else:
                done.append((tier, held))
    if not last:
        return done, left
    most, window, room = tiers[-1], [], tiers[-1]
    for doc, start, length, ids in left:
        while length:
            n = min(room, length)
            window.append((doc, start, n, ids[:n]))
            start, length, ids, room = start + n, length - n, ids[n:], room - n
            if not room:
                done.append((most, window))
                window, room = [], most
    if window:
        done.append((most, window))
    return done, []


def deal(sequences: list[tuple[int, list[tuple]]], tokens: int, last: bool) -> tuple[list[list[tuple[int, list[tuple]]]], list]:
    """Step groups of equally many tokens from sequences of equal window size, and what waits for the next call.

    Sequences are dealt out to and fro by their attention cost (the sum of squared piece lengths), so that groups cost
    about the same. With `last` none waits: the sequences of a size are dealt to as few groups as hold them.
    """
    by_size: dict[int, list] = defaultdict(list)
    for s in sequences:
        by_size[s[0]].append(s)
    groups, rest = [], []
    for size, own in sorted(by_size.items()):
        each = max(1, tokens // size)
        count = -(-len(own) // each) if last else len(own) // each
        own.sort(key=lambda s: -sum(p[2] ** 2 for p in s[1]))
        kept, spare = own[: count * each], own[count * each :]
        rest += spare  # none with `last`
        dealt = [[] for _ in range(count)]
        for i, s in enumerate(kept):
            lap, at = divmod(i, count)
            dealt[at if lap % 2 == 0 else count - 1 - at].append(s)
        groups += dealt
    return groups, rest


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document in a training sequence.

    A document is the ids of its whole text (null: none) and END_ID. Returns the id, start, length, ids_crc32 (of the
    piece's little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset, window (the tier of its sequence) and
    step_group. Pieces of a sequence lie gapless from offset 0; a sequence that its pieces don't fill has the longest
    window. Each row of docs is a document of its own, also when ids repeat or are null. Other columns are ignored; an
    empty table gives no rows.
    """
    path, most, kind = tokenizer_path(tokenizer), tiers[-1], docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path), TaskContext.get().partitionId() << 33
        pool, pooled, waiting, counts, out = [], 0, [], [0, 0], []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool, pooled, waiting, out
            packed, pool = pack(pool, tiers, last)
            pooled = sum(p[2] for p in pool)
            groups, waiting = deal(waiting + packed, step_tokens, last)
            for group in groups:
                for window, held in group:
                    offset = 0
                    for (doc, total), start, length, ids in held:
                        out.append((doc, start, length, zlib.crc32(ids.tobytes()), total, base + counts[0], offset, window, base + counts[1]))
                        offset += length
                    counts[0] += 1
                counts[1] += 1
                if len(out) >= OUT_ROWS:
                    yield rows()
            if last and out:
                yield rows()

        def rows() -> pa.RecordBatch:
            nonlocal out
            columns, out = list(zip(*out)), []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], batch_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=names)

        batch_type = None
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                batch_type = batch.column(0).type
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), END_ID).astype("<u4")
                    key, full = (doc, len(ids)), len(ids) // most * most
                    waiting += [(most, [(key, s, most, ids[s : s + most])]) for s in range(0, full, most)]
                    if full < len(ids):
                        pool.append((key, full, len(ids) - full, ids[full:].copy()))
                    pooled += len(ids)
                    if pooled >= POOL_TOKENS:
                        yield from flush(False)
        if batch_type is not None:
            yield from flush(True)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in names[1:])
    return docs.select(id_col, text_col).mapInArrow(run, schema)
