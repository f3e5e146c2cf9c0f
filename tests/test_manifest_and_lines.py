"""Manifest trees against plain Python, numbered lines of split files, and bursts over range borders."""

import hashlib
import json
import random

from docspark.operators import catalog, incremental
from docspark.sources import files as S

FILE = "file_id long, content_sha256 string"


def tree(rows, leaf):
    """(shift, node) -> (files, digest), top down."""
    out, sha = {}, lambda x: hashlib.sha256("\n".join(x).encode()).hexdigest()
    ids = [i for i, _ in rows]
    top = 0
    while top < 64 and min(ids) >> top != max(ids) >> top:
        top += 4

    def grow(shift, node, own):
        if len(own) <= leaf or shift == 0:
            digest = sha([f"{i}:{h}" for i, h in sorted(own)])
        else:
            parts = {}
            for i, h in own:
                parts.setdefault(i >> (shift - 4), []).append((i, h))
            digest = sha([f"{n}:{grow(shift - 4, n, parts[n])}" for n in sorted(parts)])
        out[shift, node] = len(own), digest
        return digest

    grow(top, min(ids) >> top if top < 64 else 0, rows)
    return out


def listing(seed):
    r = random.Random(seed)
    ids = [*range(100, 700), *(10**12 + 3 * i for i in range(500)), *(r.randrange(-(10**15), 10**15) for _ in range(50)), 5, 5]
    return [(i, f"h{r.randrange(10**6)}") for i in ids]


def test_tree(spark):
    rows = listing(1)
    df = spark.createDataFrame(rows, FILE)
    for leaf, parts in ((16, 1), (16, 7), (2000, 3)):
        got = catalog.manifest_tree(df.repartition(parts), leaf).collect()
        assert {(r["shift"], r["node"]): (r["files"], r["digest"]) for r in got} == tree(rows, leaf)
        assert max(r["files"] for r in got if r["leaf"]) <= leaf
    assert catalog.manifest_tree(df.limit(0)).collect() == []
    assert [r["files"] for r in catalog.manifest_tree(df.filter("file_id = 5"), 1).collect()] == [2]


def test_changed_ranges(spark):
    rows = listing(1)
    later = [(i, "new" if i == 333 else h) for i, h in rows if i != 10**12 + 300] + [(650_000, "x")]
    a, b = (catalog.manifest_tree(spark.createDataFrame(x, FILE), 16) for x in (rows, later))
    got = catalog.changed_ranges(a, b).collect()
    for i in (333, 10**12 + 300, 650_000):
        assert any(r["low"] <= i <= r["high"] for r in got)
    assert all(any(r["low"] <= i <= r["high"] for i in (333, 10**12 + 300, 650_000)) for r in got) and len(got) == 3
    assert catalog.changed_ranges(a, a).count() == 0


def test_lines_of_split_files(spark, tmp_path):
    r, want, bad = random.Random(2), [], []
    for name in ("one", "two"):
        with (tmp_path / f"{name}.jsonl").open("w") as f:
            for n in range(1, 4001):
                line = r.choice([json.dumps({"case_id": f"{name}{n}"}), json.dumps({"case_id": f"{name}{n}"}), "", "# note", "{broken"])
                f.write(line + r.choice(["\n", "\n", "\r\n"]))
                if line.startswith("{b"):
                    bad.append((name, n))
                elif line.startswith("{"):
                    want.append(f"{name}{n}")
    (tmp_path / "three.json").write_text('\n [{"case_id": "a"},\n {"case_id": "b"}]')
    (tmp_path / "four.json").write_text('[{"case_id": "a"')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        good, rejected = S.read_eval_cases(spark, str(tmp_path), "case_id string")
        assert sorted(x.case_id for x in good.collect()) == sorted([*want, "a", "b"])
        got = sorted((x.file.rpartition("/")[2].partition(".")[0], x.line_no) for x in rejected.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([*bad, ("four", 1)])


def test_bursts_over_range_borders(spark):
    r, rows, t = random.Random(3), [], 1_700_000_000_000
    for i in range(400):
        t += r.choice([0, 1, 500, 1999, 2000, 2001, 30_000])
        rows.append((r.choice(["a", "b"]), r.choice(["created", "modified", "removed", "renamed"]), f"p{r.randrange(5)}", t, i))
    df = spark.createDataFrame(rows, "root_id string, event_type string, path string, ms long, event_id long").selectExpr("root_id", "event_type", "path", "timestamp_millis(ms) ts", "event_id")
    key = ["root_id", "burst", "path", "event_type", "last_ts", "events"]
    want = sorted(tuple(x) for x in incremental.coalesce_events(df, range_seconds=1e9).select(*key).collect())
    for width in (0.5, 3.0, 60.0):
        assert sorted(tuple(x) for x in incremental.coalesce_events(df, range_seconds=width).select(*key).collect()) == want
    bursts, last = {}, {}
    for root, _, _, ms, _ in rows:
        bursts[root] = bursts.get(root, 0) + (ms - last.get(root, -(10**9)) >= 2000)
        last[root] = ms
    assert {root: max(b for r_, b, *_ in want if r_ == root) for root in bursts} == bursts
