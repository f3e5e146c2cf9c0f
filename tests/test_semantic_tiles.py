"""Pairs of like files with parts that travel in tiles, against all pairs; how often a vector is sent."""

import numpy as np
import pytest

from docspark.operators import topics
from test_relations_named import shuffled


@pytest.mark.parametrize("kind", ["float", "double"])
def test_tiles_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(topics, "TILE", 40)
    x = np.random.default_rng(8).standard_normal((260, 5)).astype(np.float32)
    rows = [(i, "ab"[i % 7 == 0], v.tolist()) for i, v in enumerate(x)] + [(300, "a", x[1].tolist()), (301, None, x[1].tolist()), (302, "a", None)]
    got = topics.semantic_pairs(spark.createDataFrame(rows, f"file_id long, bucket string, vector array<{kind}>"), 0.7, part=8).collect()
    unit = {i: (b, np.array(v, np.float64) / np.linalg.norm(v)) for i, b, v in rows if b and v}
    want = {(i, j, round(float(u @ w), 6)) for i, (b, u) in unit.items() for j, (c, w) in unit.items() if i < j and b == c and round(float(u @ w), 6) >= 0.7}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_a_vector_is_sent_once_for_each_tile(spark):
    x = np.random.default_rng(9).standard_normal((3000, 4))
    df = topics.semantic_pairs(spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "file_id long, bucket string, vector array<double>"), 0.99, part=32)
    df.collect()
    assert shuffled(df._jdf.queryExecution()) <= 6000  # before: a copy for each other part that is near
