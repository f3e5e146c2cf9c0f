"""The edit join against plain dynamic programming."""

import random

import pyarrow as pa
import pytest

from docspark.llm import line_dedup
from docspark.llm.common import bounded_lists


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, s, k):
    s = list(s)
    for _ in range(k):
        at, what = r.randrange(len(s) + 1), r.randrange(3)
        s[at : at + (what > 0)] = [] if what == 1 else [r.choice("abcde")]
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_within(tau):
    r = random.Random(tau)
    pairs = []
    for _ in range(400):
        a = "".join(r.choice("abcde") for _ in range(r.choice([0, 1, 5, 30, 90])))
        pairs.append((a.encode(), edited(r, a, r.randint(0, 5)).encode()))
    got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], tau)
    assert got.tolist() == [distance(a, b) <= tau for a, b in pairs]


@pytest.mark.parametrize(("tau", "block"), [(1, 4096), (2, 7)])
def test_near_lines(spark, monkeypatch, tau, block):
    monkeypatch.setattr(line_dedup, "LIST_BLOCK", block)
    r = random.Random(5)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(8, 40))) for _ in range(25)]
    docs = [(i, "\n".join(edited(r, r.choice(base), r.randint(0, 3)) for _ in range(r.randint(0, 5)))) for i in range(40)] + [(90, None), (91, "\n\n")]
    lines = [(i, k, s) for i, t in docs for k, s in enumerate((t or "").split("\n")) if len(s) >= 10]
    distinct = sorted({s for _, _, s in lines})
    links = [(a, b) for x, a in enumerate(distinct) for b in distinct[:x] if distance(a, b) <= tau]
    up = {s: s for s in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    first = {}
    for i, k, s in sorted(lines):
        first.setdefault(find(s), (i, k))
    want = sorted((i, k, *first[find(s)], sum(s in e for e in links), (i, k) == first[find(s)]) for i, k, s in lines)
    got = line_dedup.near_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tau=tau, least=10)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert len(links) > 10


def test_lists_are_compared_in_one_pass(spark):
    """Segments are sorted once: no window numbers them, and lists within the limit don't pass through a second shuffle."""
    docs = spark.createDataFrame([(i, f"the same line but for {i % 9}\nanother one, number {i}") for i in range(60)], "doc_id long, text string")
    pairs = line_dedup.candidate_pairs(line_dedup.segment_keys(docs, 10, 2), 2)
    assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() > 36


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_bounded_lists(limit):
    r = random.Random(limit)
    keys = [k for k in range(60) for _ in range(r.choice([1, 1, 2, 3, 4, 7, 25]))]
    table = pa.table({"key": keys, "row": list(range(len(keys)))})
    short, long = [], {}
    for batch, block in bounded_lists((b for b in table.to_batches(max_chunksize=r.choice([1, 2, 5, 11]))), limit):
        rows = batch.to_pylist()
        if block is None:
            short += rows
            assert all(x["key"] not in long for x in rows)
        else:
            for x, b in zip(rows, block.tolist(), strict=True):
                long.setdefault(x["key"], []).append((x["row"], b))
    count = {k: keys.count(k) for k in keys}
    assert [x["row"] for x in short] == [i for i, k in enumerate(keys) if count[k] <= limit]
    assert long == {k: [(i, n // limit) for n, i in enumerate(j for j, x in enumerate(keys) if x == k)] for k in count if count[k] > limit}
