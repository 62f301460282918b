"""Repairing the turn structure of conversations by the cheapest edits.

Messages of a conversation must have roles of the form (system? (user assistant)+)?. What may be done to them is a
lattice whose nodes are (messages done, state of that grammar) and whose edges are edits; Dijkstra's algorithm walks it
without building it, by the key (cost, audit), and stops at the first end node that it takes up. Two paths into a node
have done the same messages, so that the better key stays the better whatever follows, and inserting is put off to just
before the next message, so that no audit of a node is the beginning of another.

A long conversation is cut into stretches of so many messages, and so is one that lies in several partitions: a stretch
is solved from each state that it may begin in, and the solutions are joined in order, which gives the same edits. So the
work on one conversation is dealt out, but for the hash of its repaired text, which one task takes up message by message.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, saved

#: States: nothing yet, system, user, assistant; those in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What a kept message's initial (s, u, a, other) leads to from each state; None: it may not be kept.
KEEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: What an inserted message or one of a new role leads to.
FORCED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a message, the first that fits; costs of edits.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Messages in a stretch.
STRETCH = 512

#: White space here is \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\f\r"


def solve(codes: bytes, start: int, finish: bool) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) by the state that it ends in, of messages (initial + 4 * fault) taken up in a state.

    finish: the conversation ends here, and only the first end node taken up is told.
    """
    n, done, found = len(codes), set(), {}
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == n and finish and q in ENDS:
            return {q: (cost, audit)}
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n and not finish:
            found[q] = (cost, audit)
            continue  # what is inserted here stands before the next stretch's first message
        heapq.heappush(heap, (cost + INSERT_COST, audit + "I", i, FORCED[q]))
        if i == n:
            continue
        initial, fault = codes[i] % 4, codes[i] // 4
        heapq.heappush(heap, (cost + DELETE_COST, audit + "D", i + 1, q))
        if fault in (FINE, TRUNCATED):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            if KEEP[q][initial] is not None:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEP[q][initial]))
            heapq.heappush(heap, (cost + REROLE_COST + more, audit + "R", i + 1, FORCED[q]))
    return found


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32(`conv_id:turn`) % 20 does; nulls are a space there."""
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    spot = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    plain = plain.withColumn("spot", spot).filter("spot <> 0")
    text_ = F.when(F.col("spot") == 1, "").when(F.col("spot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("spot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return plain.select("conv_id", "turn", F.when(F.col("spot") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), F.explode(times).alias("copy")).drop("copy")


def _code(role: Column, text: Column, repeats: Column) -> Column:
    """initial + 4 * fault."""
    last = F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(repeats, DUPLICATE).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    letter = F.left(role, F.lit(1))
    return F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3) + 4 * fault


_LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A solved stretch; the edits chosen for it, with what is told of the conversation at its last one.
_SOLVED = "conv_id {id}, pos long, first int, last int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, whole boolean, exits array<struct<enter: int, leave: int, cost: long, audit: string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_CHOSEN = f"conv_id {{id}}, pos long, state int, audit string, {', '.join(f'{c} long' for c in _COUNTS)}"
_TOLD = f"conv_id {{id}}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"
#: Rows that are sent from a task at once.
BATCH = 4096


class _Rows:
    """Rows gathered into batches of a schema."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows = schema, []

    def full(self, least: int = BATCH) -> Iterator[pa.RecordBatch]:
        if self.rows and len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)
            self.rows = []


def _stretch(held: list[tuple], whole: bool) -> tuple:
    codes = bytes(c for _, _, _, c in held)
    turns = [t for _, t, _, _ in held if t is not None]
    exits = [{"enter": q, "leave": e, "cost": c, "audit": a} for q in ((START,) if whole else range(4)) for e, (c, a) in solve(codes, q, whole).items()]
    initials, faults = [c % 4 for c in codes], [c // 4 for c in codes]
    return (*held[0][:1], held[0][2], initials[0], initials[-1], min(turns, default=None), max(turns, default=None), len(set(turns)), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), sum(p not in _LEGAL for p in zip(initials, initials[1:])), whole, exits)


def _stretches(schema: pa.Schema, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Messages (conv_id, turn, pos, code) in order: a row for each stretch.

        A conversation that begins and ends within a partition and is no longer than a stretch is solved at once; the
        others from every state. What is counted is of the stretch alone.
        """
        out, held, cut = _Rows(schema), [], True  # cut: the conversation may have stretches elsewhere
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "pos", "code"))):
                if held and row[0] != held[0][0]:
                    out.rows.append(_stretch(held, not cut))
                    held, cut = [], False
                elif len(held) == most:
                    out.rows.append(_stretch(held, False))
                    held, cut = [], True
                held.append(row)
            yield from out.full()
        if held:
            out.rows.append(_stretch(held, False))
        yield from out.full(1)

    return run


def _joined(stretches: list[dict]) -> Iterator[tuple]:
    """The edits chosen for each stretch of a conversation, in order."""
    best, back = {START: (0, 0)}, []
    for s in stretches:
        found = {}
        for e in s["exits"]:
            if e["enter"] in best:
                cost, rank = best[e["enter"]]
                key = (cost + e["cost"], rank, e["audit"])
                if e["leave"] not in found or key < found[e["leave"]][0]:
                    found[e["leave"]] = (key, e["enter"])
        # No audit of a stretch begins another of it, so that the order of audits so far is all that counts from here on.
        order = sorted(found, key=lambda q: found[q][0][1:])
        best = {q: (found[q][0][0], i) for i, q in enumerate(order)}
        back.append({q: (enter, key[2]) for q, (key, enter) in found.items()})
    tail = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
    last = min(best, key=lambda q: (best[q][0] + INSERT_COST * len(tail[q]), best[q][1], tail[q]))
    cost, state, chosen = best[last][0] + INSERT_COST * len(tail[last]), last, []
    for i, b in reversed(list(enumerate(back))):
        state, audit = b[state]
        chosen.append((state, audit + (tail[last] if i == len(back) - 1 else "")))
    chosen.reverse()
    counted = [sum(s[c] for s in stretches) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
    for a, b in zip(stretches, stretches[1:]):
        counted[0] -= a["high"] is not None and a["high"] == b["low"]
        counted[4] += (a["last"], b["first"]) not in _LEGAL
    low, high = (f((s[c] for s in stretches if s[c] is not None), default=None) for f, c in ((min, "low"), (max, "high")))
    gaps = 0 if low is None else min(high - low + 1 - counted[0], 2**63 - 1)
    for i, (s, (state, audit)) in enumerate(zip(stretches, chosen)):
        yield (s["conv_id"], s["pos"], state, audit, *((gaps, *counted[1:], cost) if i == len(chosen) - 1 else (None,) * 6))


def _choose(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches by conversation, in order: the edits of each."""
        out, held = _Rows(schema), []
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    out.rows += _joined(held)
                    held = []
                held.append(row)
            yield from out.full()
        if held:
            out.rows += _joined(held)
        yield from out.full(1)

    return run


def _rewrite(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By conversation: a row of its id, then, by position, the edits of each stretch and its messages."""
        out, conv = _Rows(schema), None

        class Conversation:
            def __init__(self, conv_id):
                self.id, self.digest, self.said, self.state, self.audit, self.at, self.counts = conv_id, hashlib.sha256(), False, START, [], 0, (0,) * 6

            def put(self, role: bytes, text: bytes) -> None:
                self.digest.update((b"\n" if self.said else b"") + role + b":")
                self.digest.update(text)
                self.said = True

            def inserts(self) -> None:
                """Messages that are inserted before the next one."""
                edits = self.audit[-1] if self.audit else ""
                while self.at < len(edits) and edits[self.at] == "I":
                    self.state, self.at = FORCED[self.state], self.at + 1
                    self.put(ROLE[self.state].encode(), b"")

            def message(self, role: bytes, text: bytes, initial: int) -> None:
                self.inserts()
                edit, self.at = self.audit[-1][self.at], self.at + 1
                if edit == "K":
                    self.state = KEEP[self.state][initial]
                    self.put(role, text)
                elif edit == "R":
                    self.state = FORCED[self.state]
                    self.put(ROLE[self.state].encode(), text)

            def told(self) -> tuple:
                self.inserts()
                return (self.id, *self.counts, "".join(self.audit), self.digest.hexdigest())

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "state", "audit", *_COUNTS, "initial")]
            roles, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text"))
            for (id_, kind, state, audit, *counts, initial), role, text in zip(zip(*columns), roles, texts):
                if kind == 0:
                    if conv is not None:
                        out.rows.append(conv.told())
                    conv = Conversation(id_)
                elif kind == 1:
                    conv.audit.append(audit)
                    conv.state, conv.at = state, 0
                    conv.counts = tuple(counts) if counts[0] is not None else conv.counts
                else:
                    conv.message(role, text, initial)
            yield from out.full()
        if conv is not None:
            out.rows.append(conv.told())
        yield from out.full(1)

    return run


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", stretch: int = STRETCH) -> DataFrame:
    """Each conversation of the rows after damage(): its faults, the cheapest edits and the hash of its repaired text.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; a row for each id, null included.
    Messages stand by turn, nulls first, then by role and text; repeated rows are messages like any other. A role's
    initial is its first character; one that is none of s, u, a (an empty or null role, too) is never kept. What has no
    message after damage has zeros, an empty audit and the hash of nothing; an empty table gives no rows; other columns
    are ignored. Gaps beyond a long are its limit.
    """
    spark, ids = rows.sparkSession, rows.schema[conv].dataType.simpleString()
    schema = lambda kind: spark.createDataFrame([], kind.format(id=ids)).toArrow().schema
    with Scratch(spark) as work:
        # No text is a key of the ranges, whose bounds the driver samples.
        broken = damaged(rows, conv, turn, role, text)
        placed = broken.repartitionByRange("conv_id", "turn", F.left("role", F.lit(16))).sortWithinPartitions("conv_id", "turn", "role", "text")
        same = F.unhex(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
        ordered = work.saved(placed.select("*", F.monotonically_increasing_id().alias("pos"), _code(F.col("role"), F.col("text"), F.lit(False)).alias("code"), same.alias("same")), "messages")
        first = ordered.groupBy(F.col("same").alias("key")).agg(F.min("pos").alias("first"))
        marked = ordered.select("conv_id", "turn", "pos", "code", "same").join(first, F.col("same") == F.col("key"))
        again = (F.col("pos") > F.col("first")) & (F.floor(F.col("code") / 4) != BLANK)
        coded = marked.select("conv_id", "turn", "pos", F.when(again, F.col("code") % 4 + 4 * DUPLICATE).otherwise(F.col("code")).cast("int").alias("code"))
        solved = coded.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(_stretches(schema(_SOLVED), stretch), _SOLVED.format(id=ids))
        chosen = solved.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_choose(schema(_CHOSEN)), _CHOSEN.format(id=ids))
        none = lambda kind, *cs: [F.lit(None).cast(kind).alias(c) for c in cs]
        known = rows.select(F.col(conv).alias("conv_id")).distinct().select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("kind"), *none("int", "state"), *none("string", "audit"), *none("long", *_COUNTS), *none("int", "initial"), *none("string", "role", "text"))
        edits = chosen.select("conv_id", "pos", F.lit(1).alias("kind"), "state", "audit", *_COUNTS, *none("int", "initial"), *none("string", "role", "text"))
        messages = ordered.select("conv_id", "pos", F.lit(2).alias("kind"), *none("int", "state"), *none("string", "audit"), *none("long", *_COUNTS), (F.col("code") % 4).cast("int").alias("initial"), "role", "text")
        both = known.unionByName(edits).unionByName(messages).repartition("conv_id").sortWithinPartitions("conv_id", "pos", "kind")
        return saved(both.mapInArrow(_rewrite(schema(_TOLD)), _TOLD.format(id=ids)), "repaired")[0]
