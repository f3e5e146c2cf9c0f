"""Whitened embeddings against an eigendecomposition of the whole covariance."""

from decimal import Decimal

import numpy as np
import pytest

from docspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def expected(vectors, k):
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(axis=1), c @ u / np.sqrt(e), e / np.trace(v)


def compare(rows, out, k):
    deviation, white, explained = expected([v for _, v in rows], k)
    got = {(r["vec_id"], r["component"]): r for r in out.collect()}
    assert len(got) == len(rows) * k
    values = np.array([[got[i, j]["whitened"] for j in range(1, k + 1)] for i, _ in rows])
    sign = np.sign((values * white).sum(axis=0))
    assert np.abs(values * sign - white).max() < 1e-8
    for p, (i, _) in enumerate(rows):
        r = got[i, 1]
        assert r["n"] == len(rows) and r["deviation"] == deviation[p]
    for j in range(1, k + 1):
        assert got[rows[0][0], j]["explained"] == pytest.approx(explained[j - 1], rel=1e-9)
    assert {r["identity_error"] for r in got.values()} == {got[rows[0][0], 1]["identity_error"]} and got[rows[0][0], 1]["identity_error"] < 1e-9


@pytest.mark.parametrize("dims,strong", [(64, 1), (48, 40), (12, 3), (3, 1)])
def test_against_whole_covariance(spark, dims, strong):
    random = np.random.default_rng(dims)
    v = (random.standard_normal((700, dims)) * np.linspace(1, 0.6, dims)).astype(np.float32)
    v[:, 0] *= strong
    rows = list(enumerate((v / 8).tolist()))
    df = spark.createDataFrame([(i, x, "a", "b") for i, x in rows], SCHEMA).repartition(5)
    compare(rows, whitening.whiten(df), min(8, dims))


def test_rows_left_out_and_repeated(spark):
    random = np.random.default_rng(1)
    rows = list(enumerate(random.standard_normal((50, 5)).astype(np.float32).tolist()))
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [1.0, float("nan"), 1.0, 1.0, 1.0]), (104, [1.0, float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, None, "b") for i, x in rows + bad], SCHEMA)
    compare(rows, whitening.whiten(df), 5)
    twice = whitening.whiten(df.unionByName(df.filter("vec_id = 3")).unionByName(spark.createDataFrame([(None, rows[0][1], None, None)], SCHEMA))).collect()
    assert sum(r["vec_id"] == 3 for r in twice) == 10 and sum(r["vec_id"] is None for r in twice) == 5
    assert {r["n"] for r in twice} == {52}


def test_without_variance(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], "", "") for i in range(4)], SCHEMA)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "", "") for i in range(9)], SCHEMA)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], "", ""), (2, [1.0, 2.0], "", "")], SCHEMA)).collect()


def test_exact_beyond_64_bits():
    m = whitening.Moments(4_000_000_000, [4_000_000_000 * 100_000 + 1] * 2, 4_000_000_000 * 2)
    x = np.array([[100_001, 100_000]], np.int64)
    with pytest.raises(OverflowError):
        m.deviations(x)
    m = whitening.Moments(2_000_000_000, [2_000_000_000 * 100_000 - 5] * 2, 2_000_000_000 * 2)
    want = sum((Decimal(2_000_000_000) * v - s) ** 2 for v, s in zip([100_001, 100_000], m.sums, strict=True))
    assert m.deviations(x).tolist() == [int(want)]
