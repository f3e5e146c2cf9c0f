"""The n-gram join against all pairs by brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docspark.llm import ngram_join


def sets_of(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)])


def brute(rows, percent=85):
    sets = [(i, sets_of(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(seed, n=140):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows, bases = [], []
    for i in range(n):
        if bases and r.random() < 0.5:
            words = list(r.choice(bases))
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                words[r.randrange(len(words))] = r.choice(vocab)
        else:
            words = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 20, 80, 150]))]
            if r.random() < 0.5:
                words[r.randrange(len(words)) : 0] = passage
            bases.append(words)
        rows.append((i * 7 % 1009, " ".join(words).replace("w1", "W1") + r.choice(["", "\n", " "])))
    return rows + [(5000, None), (5001, ""), (5002, " \t")]


@pytest.mark.parametrize(("seed", "bounds", "broadcast"), [(1, (32, 1024), 1000), (2, (2, 6), 10**6), (3, (1, 2), 0), (4, (0, 1), 10**6)])
def test_join(spark, monkeypatch, seed, bounds, broadcast):
    monkeypatch.setattr(ngram_join, "CLASS_BOUNDS", bounds)
    monkeypatch.setattr(ngram_join, "BROADCAST_TOKENS", broadcast)
    if seed > 2:  # lists are compared in many blocks
        monkeypatch.setattr(ngram_join, "LIST_BLOCK", 5)
        monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    rows = corpus(seed)
    assert len({c for _, _, c in brute(rows)}) < len(rows) - 20
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (1, "A b\nc d"), (9, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == {(None, 1): 1, (3, 1): 2, (1, 1): 1, (9, 9): 1}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs.withColumnRenamed("text", "text").selectExpr("*", "1 as a", "2 as comp"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 9]


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    """Any two sets that link share a key on which at most one is a guest, whatever the classes."""
    rng = np.random.default_rng(percent)
    for trial in range(400):
        n = int(rng.integers(1, 12) if trial % 2 else rng.integers(1, 300))
        universe = rng.integers(1, 2**63, 3 * n + 8).astype(np.uint64)
        kinds = rng.choice([1, 2, 3], len(universe), p=[(1, 0, 0), (0.1, 0.5, 0.4), (0, 1, 0), (0, 0, 1), (0.1, 0.1, 0.8)][trial % 5])
        a = rng.choice(len(universe), n, replace=False)
        m = int(rng.integers(math.ceil(percent * n / 100), 100 * n // percent + 1))
        both = math.ceil(percent * (n + m) / (100 + percent))
        if both > min(n, m):
            continue
        rest = np.setdiff1d(np.arange(len(universe)), a)
        b = np.concatenate([rng.choice(a, both, replace=False), rng.choice(rest, m - both, replace=False)])
        if set(a) == set(b):
            continue
        found = []
        for x in (a, b):
            order = np.argsort(universe[x])
            found.append({(k, g) for keys, g in ngram_join.index_keys(universe[x][order], kinds[x][order], percent) for k in keys.tolist()})
        assert any((k, 1 - g) in found[1] or (k, 0) in found[1] for k, g in found[0])


def test_frequent_tokens_are_combined():
    """At production bounds, a set of frequent tokens gives combinations, in proportion to its size."""
    s = np.sort(np.random.default_rng(1).integers(1, 2**63, 4000).astype(np.uint64))
    for kind in (2, 3):
        keys = np.concatenate([k for k, _ in ngram_join.index_keys(s, np.full(len(s), kind), 85)])
        assert not np.isin(keys, s).any()
        assert 0 < len(keys) < 4 * len(s)


def test_long_text_and_boilerplate(spark):
    """A passage in more texts than the bound of class 1, and a text of half a megabyte with its near copy."""
    r = random.Random(9)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    passage = [words(30) for _ in range(5)]
    rows = []
    for i in range(80):
        parts = [p for p in passage if r.random() < 0.9]
        rows.append((i, " ".join(w for p in parts for w in p) + " " + " ".join(words(r.choice([0, 0, 3, 40])))))
    long = words(60_000)
    rows += [(200, " ".join(long)), (201, " ".join([*long[:30_000], "x", *long[30_000:]]))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)


def test_group_that_the_first_round_leaves_apart(spark, monkeypatch):
    """Near copies that the first round doesn't link give candidates in proportion to their number, in the lists and in all."""
    monkeypatch.setattr(ngram_join, "LOOK", 0)
    r, made, whole = random.Random(3), [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda docs, pairs, *a: (made.append(pairs.count()), whole(docs, pairs, *a))[1])
    base, n = [f"w{i}" for i in range(200)], 150
    rows = []
    for i in range(n):
        words = list(base)
        words[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows)
    assert {c for _, _, c in brute(rows)} == {0}
    assert sum(made) < 40 * n < n * (n - 1) // 2
