"""Phrases against DuckDB and against counting every n-gram."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import phrases


def brute(rows, least, longest=5, best=2000, within=100):
    counts, totals, out = {}, Counter(), []
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts.setdefault(lang or "und", Counter()).update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, c in counts.items():
        c = {p: f for p, f in c.items() if f >= least}
        held = lambda p: any(len(q) > len(p) and 100 * f >= within * c[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in c.items())
        found = []
        for p, a in c.items():
            if len(p) > 1 and not held(p):
                score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:best])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("n", "word", "words", "phrase", "part")})
    return sorted(map(tuple, phrases.collocations(df, **more).collect()))


def test_phrases_of_the_table(spark, sf_dir):
    got = phrases.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(phrases.oracle()).fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_phrases_against_counting(spark, monkeypatch):
    rng = random.Random(5)
    some = "a b c d e f the the the of of x y z A B été ÉTÉ   naïve".split(" ")
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(some) + rng.choice([" "] * 8 + ["\t ", ". ", ",", "\n", "!?"]) for _ in range(rng.randrange(60)))) for _ in range(300)]
    mine = phrases._mine
    for bytes_, width, bits, hot, held in ((phrases.BYTES, 2**20, 2**22, 2**16, phrases.HELD), (23, 4, 64, 20, 5)):
        monkeypatch.setattr(phrases, "_mine", lambda *a, held=held: mine(*a, most=held))
        got = mined(spark, rows, least=6, best=40, width=width, bits=bits, hot=hot, at_once=bytes_)
        assert got == brute(rows, 6, best=40) and len(got) > 60
    assert mined(spark, rows, least=6, within=60) == brute(rows, 6, within=60)


def test_parts_of_a_long_text_lose_no_phrase(spark):
    rng = random.Random(6)
    rows = [("en", " ".join(rng.choice("a b c dd eee".split()) for _ in range(4000)))]
    assert mined(spark, rows, least=20, at_once=50) == brute(rows, 20)


def test_phrases_of_odd_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("en", ""), ("en", " \t.,"), ("de", "one")]) == []
    rows = [("en", "to be or not to be")] * 7 + [(None, "to be or not to be")] * 7
    assert mined(spark, rows, least=7) == brute(rows, 7)
    long = [("en", "ha " * 60_000)]
    assert mined(spark, long) == brute(long, 100)


def test_scores_past_64_bits(spark):
    assert spark.sql("SELECT (CAST(1000 * CAST(9000000000000 AS DECIMAL(16,0)) AS DECIMAL(19,0)) * CAST(900000000000000 AS DECIMAL(19,0))) div (CAST(9000000000001 AS DECIMAL(19,0)) * CAST(9000000000002 AS DECIMAL(19,0)))").first()[0] == 1000 * 9000000000000 * 900000000000000 // (9000000000001 * 9000000000002)
