"""The pipeline's near copies against exact similarities of all pairs."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

from tidemark.llm import simhash


def brute_shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def roots(n, pairs):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        p, q = sorted((root(i), root(j)))
        parent[q] = p
    return [root(i) for i in range(n)]


def edited(texts, shares, rng):
    for t in texts:
        for share in shares:
            words = t.split(" ")
            for i in rng.choice(len(words), max(1, round(share * len(words))), replace=False):
                words[i] = f"other{rng.integers(1 << 30)}"
            yield " ".join(words)


def test_similar_documents_against_all_pairs(spark, sf_dir):
    rng = np.random.default_rng(5)
    base = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    base = [t for t in base if t and 60 <= len(t.split()) <= 3000]
    texts = base + list(edited(base, (0.005, 0.01, 0.015, 0.02, 0.03, 0.1), rng))
    texts += ["", None, " \n", "one two three", "one two  THREE", "one two four", "a b c d e f g h i", "a b c d e f g h i j", "a b c d e f g h x", "9 b c d e f g h x"]
    sets = [brute_shingles(t) for t in texts]
    near = {(i, j): s for j in range(len(sets)) for i in range(j) if (s := jaccard(sets[i], sets[j])) >= 0.6}
    want = roots(len(texts), [p for p, s in near.items() if s >= 0.8])
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n long, component string").repartition(3)
    component = {r["id"]: r["component"] for r in simhash.similar(docs).collect()}
    linked = [p for p, s in near.items() if s >= 0.8]
    assert len(linked) > 300
    assert np.mean([component[i] == component[j] for i, j in linked]) > 0.97
    groups = defaultdict(set)
    for i, c in component.items():
        groups[c].add(want[i])
    assert all(len(g) == 1 for g in groups.values())  # nothing is linked but by similarities of 0.8 and more
    n = len(texts)
    assert component[n - 10] == component[n - 9] == component[n - 8]  # no words
    assert [component[n - 7] == component[n - k] for k in (6, 5)] == [True, False]
    assert [component[n - 4] == component[n - k] for k in (3, 2, 1)] == [True, False, False]  # 5 of 6, 4 of 6
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    first = defaultdict(lambda: n)
    for i, c in component.items():
        first[c] = min(first[c], i)
    assert sorted(ids) == sorted(first.values())
    assert len(set(ids) - set(want)) < 0.03 * n  # removed by exact similarities, kept here


def test_large_groups_of_similar_documents(spark, monkeypatch):
    """Groups beyond one task's pieces, repeated rows and null ids."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(simhash, "GROUP", 300)
    base = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    texts = list(edited([base], [0.004] * 1500, rng)) + list(edited([other], [0.004] * 700, rng)) + [base, base]
    rows = [(i if i % 100 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string").repartition(8)
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs).collect())
    assert kept == [1, 1501]
    assert simhash.keep_first(docs.filter("false")).count() == 0
    assert simhash.keep_first(docs.limit(1)).count() == 1


def test_wide_fingerprints_tell_the_similarity():
    rng = np.random.default_rng(7)
    for share in (0.95, 0.8, 0.6, 0.3):
        n = 2000
        same = int(n * 2 * share / (1 + share))
        found = []
        for _ in range(20):
            a = rng.integers(0, 1 << 63, 2 * n - same, dtype=np.uint64)
            x, y = (np.frombuffer(simhash.wide_fingerprint(np.unique(p)), np.uint64) for p in (a[:n], a[n - same :]))
            found.append(np.bitwise_count(x ^ y).sum() / simhash.BITS)
        assert abs(np.mean(found) - simhash._differing(share)) < 0.015
