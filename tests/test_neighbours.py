"""Approximate neighbours against exact ones, on the supplied vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import neighbours, topics, vectors
from docspark.storage import fresh_folder


def table(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_supplied_vectors(spark, sf):
    e, q = table(spark, sf)
    exact = vectors.vector_topk(q, e, 10).select("query_id", "id").toPandas()
    exact = spark.createDataFrame(exact)
    path = fresh_folder(spark, "index")
    assert neighbours.write_index(e, path, 64) == e.count()
    by_cells, by_planes = neighbours.search_index(spark, path, q, 64, 10), topics.vector_topk_lsh(q, e, 10, 64)
    for found in (by_cells, by_planes):
        r = neighbours.recall_of(found, exact).first()
        assert r.wanted == 10 * q.count() and r.hits >= 0.9 * r.wanted
    assert neighbours.scored_share(spark, path, q, 64) < 0.65
    everything = neighbours.search_index(spark, path, q, 64, 10, probes=10**6, block=16, part=64)
    assert {tuple(r) for r in everything.select("query_id", "id", "place").collect()} == {tuple(r) for r in vectors.vector_topk(q, e, 10).select("query_id", "id", "place").collect()}


def test_probed_folders_only(spark):
    random = np.random.default_rng(3)
    centres = random.standard_normal((12, 8)) * 4
    rows = [(i, (centres[i % 12] + random.standard_normal(8) * 0.1).tolist()) for i in range(600)]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    path = fresh_folder(spark, "index")
    neighbours.write_index(e, path, 8, cells=12)
    q = e.filter("id < 12").withColumnRenamed("id", "query_id")
    assert neighbours.scored_share(spark, path, q, 8) < 0.35
    found = neighbours.search_index(spark, path, q, 8, 5)
    r = neighbours.recall_of(found, vectors.vector_topk(q, e, 5)).first()
    assert r.hits >= 0.9 * r.wanted


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, [0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    path = fresh_folder(spark, "index")
    assert neighbours.write_index(e, path, 2) == 4
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, None), (9, [1.0])], "query_id long, vector array<double>")
    got = neighbours.search_index(spark, path, q, 2, 3, probes=9).orderBy("place").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(7, 1, 1.0), (7, 1, 1.0), (7, 5, 0.5)]
    empty = fresh_folder(spark, "index")
    assert neighbours.write_index(e.limit(0), empty, 2) == 0
    assert neighbours.search_index(spark, empty, q, 2, 3).collect() == []


def test_planes_against_plain_python(spark):
    random = np.random.default_rng(5)
    x = random.standard_normal((300, 6))
    x[7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (400, None), (401, [1.0])]
    e = spark.createDataFrame(rows, "id long, vector array<double>")
    normals = np.random.default_rng(7).standard_normal((3 * 5, 6))
    sign = (x @ normals.T > 0).reshape(len(x), 3, 5)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = []
    for q in range(0, 300, 9):
        near = [i for i in [*range(300), 5] if (sign[q] == sign[i]).all(axis=1).any()]
        want += [(q, i) for _, i in sorted((-round((1 + float(unit[q] @ unit[i])) / 2, 6), i) for i in near)[:4]]
    for block, part in ((4096, 16_384), (10, 25)):
        found = topics.vector_topk_lsh(e.filter("id % 9 = 0").withColumnRenamed("id", "query_id"), e, 4, 6, planes=5, tables=3, block=block, part=part)
        assert sorted((r.query_id, r.id) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("keys=[query_id") == 0  # before: all pairs of a bucket were made distinct by a shuffle
