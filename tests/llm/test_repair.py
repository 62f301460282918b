"""Repaired conversations against dynamic programming over whole edit scripts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def broken(rows):
    """Messages by conversation after damage."""
    out = {r[0]: [] for r in rows}
    sp = lambda x: " " if x is None else x
    for c, t, role, text in rows:
        role, text = sp(role), sp(text)
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: sorted(m, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, m in out.items()}


def faults(messages):
    seen, out = set(), []
    for _, role, text in messages:
        body = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(messages):
    """(cost, audit, repaired) by the best script for each prefix and each string of initials modulo its grammar state."""
    state = lambda s: {"": 0, "s": 1}.get(s, 2 if s[-1:] == "u" else 3)
    legal = lambda s: any(GRAMMAR.fullmatch(s + t) for t in ("", "a", "ua"))
    best = {0: (0, "", "", ())}

    def inserted(best):
        for _ in range(4):
            for c, a, s, m in list(best.values()):
                for role in ("user", "assistant"):
                    add(best, (c + 2, a + "I", s + role[0], (*m, f"{role}:")))
        return best

    def add(into, x):
        if legal(x[2]) and (state(x[2]) not in into or x[:2] < into[state(x[2])][:2]):
            into[state(x[2])] = x

    for (_, role, text), fault in zip(messages, faults(messages)):
        following = {}
        for c, a, s, m in inserted(best).values():
            add(following, (c + 3, a + "D", s, m))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in ("s", "u", "a"):
                    add(following, (c + more, a + "K", s + role[0], (*m, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    add(following, (c + 2 + more, a + "R", s + new[0], (*m, f"{new}:{text}")))
        best = following
    return min((x for x in inserted(best).values() if GRAMMAR.fullmatch(x[2])), key=lambda x: x[:2])


def brute(rows):
    out = []
    for c, messages in broken(rows).items():
        f, turns, initials = faults(messages), [t for t, _, _ in messages if t is not None], [r[:1] for _, r, _ in messages]
        cost, audit, _, made = cheapest(messages)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, f.count("blank"), f.count("duplicate"), f.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return sorted(out, key=str)


def repaired(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("pos", "code", "same", "kind", "audit", "copy")})
    return sorted(map(tuple, repair.repair(df, **more).collect()), key=str)


def test_repairs_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert repaired(spark, rows) == brute(rows)


def random_rows(rng, conversations, most):
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "", None], ["Yes.", "No", " ", None, "", "Why?\n", "…", "Well! ", "né.", "cut,"]
    return [(c, rng.choice([t, t, t, rng.randrange(5), None]), rng.choice(roles), rng.choice(texts)) for c in [*range(conversations), None] for t in range(rng.randrange(most))]


@pytest.mark.parametrize("stretch", [1, 3, 512])
def test_repairs_of_random_conversations(spark, stretch):
    rows = random_rows(random.Random(stretch), 120, 14)
    assert repaired(spark, rows, stretch=stretch) == brute(rows)


def test_the_search_is_exact_by_all_scripts():
    """Against every script of edits with two insertions before each message at most."""
    rng = random.Random(3)
    costs = {"K": 0, "R": 2, "D": 3, "I": 2}
    for _ in range(150):
        codes = bytes(rng.randrange(4) + 4 * rng.choice([0, 0, 1, 2, 3]) for _ in range(rng.randrange(4)))
        best = []
        for letters in product("KRD", repeat=len(codes)):
            for puts in product(range(3), repeat=len(codes) + 1):
                audit = "".join("I" * p + e for p, e in zip(puts, [*letters, ""]))
                cost, made, ok, rest = 0, "", True, iter(codes)
                for e in audit:
                    cost += costs[e]
                    if e != "I":
                        code = next(rest)
                        ok &= e == "D" or code // 4 in (0, 3)
                        cost += e in "KR" and code // 4 == 3
                    made += "saut"[[0, 2, 1, 3][code % 4]] if e == "K" else "?" if e in "RI" else ""
                if ok and any(GRAMMAR.fullmatch("".join(m)) for m in product(*["ua" if m == "?" else m for m in made])):
                    best.append((cost, audit))
        assert list(repair.solve(codes, repair.START, True).values()) == [min(best)]


def test_a_conversation_of_very_many_messages(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"{i}.") for i in range(5000)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    assert repaired(spark, rows) == brute(rows)
    same = [(7, 3, "user", "a.")] * 900 + [(7, None, "assistant", "b.")] * 900
    assert repaired(spark, same) == brute(same)


def test_nothing_to_repair(spark):
    assert repaired(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = [(5, -(2**63), "user", "a."), (5, 2**63 - 1, "assistant", "b.")]
    assert repaired(spark, rows)[0][1] == min(brute(rows)[0][1], 2**63 - 1)
