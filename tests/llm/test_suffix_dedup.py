"""Repeated passages against a direct search of every string."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import suffix_dedup


def brute(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], hashlib.sha256((r[1] or "").encode()).hexdigest())):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2), (3, 5)])
def test_repeats(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = ["".join(word() for _ in range(40)) for _ in range(5)] + ["ab" * 90, "x" * 300]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            a = r.randrange(len(p) // 2)
            parts.append(r.choice([p, p[a:], p[: a + 100], p[a : a + 99], p[a : a + r.randint(90, 120)], "".join(word() for _ in range(20))]))
        rows.append((i * 13 % 71, "".join(parts)))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1])]
    rows += [(5, rows[7][1]), (5, passages[0] + "q"), (5, "z" + passages[0]), (5, "z" + passages[0]), (104, "y" * 250), (104, "y" * 250)]  # one id with several texts, repeated rows
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute(rows, 100))


def test_null_ids_and_extra_columns(spark):
    """Null ids come last; repeated rows keep one copy; columns named like inner ones are not read."""
    a = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(None, a + "1"), (None, a + "1"), (7, a), (8, "k" * 99), (8, "k" * 99)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, tie int, doc string, at int")
    got = sorted((tuple(x) for x in suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert got == sorted(brute(rows, 100), key=str)


def test_longest_previous_factor():
    """Against the definition, with runs, periods and zero bytes."""
    rng = np.random.default_rng(3)
    for text in (b"abab" * 40, bytes(200), bytes(rng.integers(0, 2, 300).astype(np.uint8)), b"x" * 50 + b"y" + b"x" * 80):
        n, wide = len(text), -(-len(text) // 8) * 8
        rows = np.frombuffer(b"".join(text[i:].ljust(wide, b"\0") for i in range(n)), ">u8").reshape(n, -1).astype(np.uint64)
        got = suffix_dedup.longest_previous(rows, n - np.arange(n), np.zeros(n, np.int64), np.arange(n))

        def common(i, j):
            return next((t for t in range(n - i) if text[i + t] != text[j + t]), n - i)

        assert got.tolist() == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]


def test_empty(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string, id int, at int")).count() == 0


def test_only_repeated_strings_are_sorted(monkeypatch):
    """Of contexts that share a gram, suffixes go to the sort if their first ``length`` bytes recur; a block's sums are taken once."""
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n)).encode()
    gram, shared = word(40), word(130)
    contexts = [*((1, word(60) + gram + word(60)) for _ in range(20)), (2, shared + b"x" + word(20)), (2, shared + b"y" + word(20))]
    n = len(contexts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in contexts]), pa.array([0] * n), pa.array(range(n)), pa.array([0] * n), pa.array([0] * n, pa.int32()), pa.array([c for _, c in contexts])],
        suffix_dedup.PLACES,
    )

    class Rows:
        sparkSession = None

        def __init__(self, batch):
            self.batch = batch

        def repartition(self, *_):
            return self

        select = sortWithinPartitions = repartition

        def mapInArrow(self, run, _):
            return list(run(iter([self.batch])))

    sizes, sums, sort, prefix = [], [], suffix_dedup.longest_previous, suffix_dedup.K.prefix
    monkeypatch.setattr(suffix_dedup, "shuffle_width", lambda _: 4)
    monkeypatch.setattr(suffix_dedup, "longest_previous", lambda suffix, *rest: sizes.append(len(suffix)) or sort(suffix, *rest))
    monkeypatch.setattr(suffix_dedup.K, "prefix", lambda data: sums.append(len(data)) or prefix(data))
    (out,) = suffix_dedup.removed_runs(Rows(batch), 100)
    assert out.to_pylist() == [{"doc": n - 1, "tie": 0, "begin": 0, "end": 130}]
    assert sum(sizes) == 2 * 31
    sums.clear()
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0]), pa.array([(shared + gram).decode()] * 2)], ["doc", "tie", "text"])
    (out,) = suffix_dedup.all_anchors(Rows(docs), 100)
    of = lambda doc: [x["at"] for x in out.to_pylist() if x["doc"] == doc]
    assert of(1) == of(2) != [] and len(sums) == 1
