"""Approximate neighbours from a stored index: a trained coarse quantiser, vectors clustered on disk by cell, nearest cells probed.

The index is a folder with two tables: ``cells`` (a centroid each, and how many cells to probe) and ``vectors``, partitioned
by cell, so that a search lists and reads the folders of the cells it probes and no others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.vectors import block_best

#: Vectors at most that the quantiser is trained on, and of them those that tell how many cells to probe.
SAMPLE, ASKED = 20_000, 500


def _good(df: DataFrame, id_col: str, dimension: int) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) == dimension)).filter(finite).select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def train_cells(x: np.ndarray, cells: int, rounds: int = 25, seed: int = 7) -> np.ndarray:
    """Unit centroids of ``cells`` clusters of unit vectors: k-means on the sphere. A cluster that loses its vectors restarts at the vector
    that fits its own worst; clusters that hold a single vector's copies end at equal centroids, which does no harm."""
    random = np.random.default_rng(seed)
    c = x[random.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(lost):
            sums[lost] = x[np.argsort(near[np.arange(len(x)), own])[: len(lost)]]
        c = unit(sums)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells to probe by which the first vectors of the sample find ``recall`` of their ``k`` nearest in it."""
    asked = x[:ASKED]
    near = asked @ x.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    k = min(k, len(x) - 1)
    if k < 1:
        return len(c)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cell = (x @ c.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # how near a cell is to an asked vector
    needed = np.sort(rank[np.arange(len(asked))[:, None], cell[best]].reshape(-1)) + 1
    return int(needed[math.ceil(recall * len(needed)) - 1])


def write_index(vectors: DataFrame, path: str, dimension: int, cells: int | None = None, k: int = 10, recall: float = 0.95, sample: int = SAMPLE) -> int:
    """Write the index of ``vectors`` (``id, vector``) to ``path``; returns the number of vectors in it.

    Vectors of another dimension, null or not finite are left out, repeated ids are kept. The quantiser is trained on
    ``sample`` vectors at most, those whose hashed ids are smallest; every vector is indexed. ``cells`` is about the root
    of the number of vectors times four where it isn't given, 1,024 at most and an eighth of the sample at most. The number of probes is
    the least that reaches ``recall`` within the sample, where neighbours lie farther than in the whole. Rows are dealt by cell and
    id, so a cell that holds most vectors is written by several tasks.
    """
    spark = vectors.sparkSession
    good = _good(vectors, "id", dimension)
    n = good.count()
    picked = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = unit(np.array([r["vector"] for r in picked], np.float64).reshape(-1, dimension))
    c = train_cells(x, max(1, min(cells or min(4 * math.isqrt(n), 1024), max(len(x) // 8, 1)))) if n else np.zeros((1, dimension))
    probes = probes_for(x, c, k, recall) if n else 1
    rows = [(i, v.tolist(), probes) for i, v in enumerate(c)]
    spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/cells")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((unit(own) @ c.T).argmax(axis=1).astype(np.int32))], ["id", "vector", "cell"])

    placed = good.mapInArrow(assign, "id long, vector array<double>, cell int")
    placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").option("compression", "zstd").parquet(f"{path}/vectors")
    return n


def search_index(spark: SparkSession, path: str, queries: DataFrame, dimension: int, k: int, probes: int | None = None, block: int = 1024, part: int = 4096) -> DataFrame:
    """``query_id, id, score, place``: the ``k`` best by cosine among the vectors of each query's nearest cells, score (1 + cos) / 2, ties by id.

    ``queries`` have ``query_id, vector``; those of another dimension, null or not finite have no rows. In a cell, blocks of queries
    meet parts of vectors, each pair as one matrix product in one task, so a task's memory follows neither the cell nor the queries.
    """
    told = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])  # 1,024 rows at most
    c = np.array([r["centroid"] for r in told])
    probes = min(probes or told[0]["probes"], len(c))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            near = np.argsort(-(unit(own) @ c.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            rows = pa.array(np.repeat(np.arange(len(own)), probes))
            yield pa.RecordBatch.from_arrays([*(x.take(rows) for x in batch.columns), pa.array(near.reshape(-1))], ["id", "vector", "cell"])

    q = _good(queries, "query_id", dimension).mapInArrow(probe, "id long, vector array<double>, cell int")
    v = spark.read.schema("id long, vector array<double>, cell int").parquet(f"{path}/vectors")
    sizes = v.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")).join(q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "cell")
    sizes = F.broadcast(sizes)  # a row for each cell
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n)
    q = q.join(sizes, "cell").select("cell", dealt("blocks").alias("b"), spread("parts").alias("p"), F.lit(True).alias("asks"), "id", "vector")
    v = v.join(sizes, "cell").select("cell", spread("blocks").alias("b"), dealt("parts").alias("p"), F.lit(False).alias("asks"), "id", "vector")
    found = q.unionByName(v).groupBy("cell", "b", "p").applyInArrow(block_best(k), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``hits`` and ``wanted``, the exact ``query_id, id`` pairs found and all of them."""
    hits = exact.select("query_id", "id").distinct().join(found.select("query_id", "id", F.lit(1).alias("hit")).distinct(), ["query_id", "id"], "left")
    return hits.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("wanted"))


def scored_share(spark: SparkSession, path: str, queries: DataFrame, dimension: int) -> float:
    """The share of the indexed vectors that an average query of ``queries`` is held against: what a search costs next to the exact one."""
    told = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r["cell"])
    c, probes = np.array([r["centroid"] for r in told]), told[0]["probes"]
    sizes = {r["cell"]: r["count"] for r in spark.read.schema("id long, vector array<double>, cell int").parquet(f"{path}/vectors").groupBy("cell").count().collect()}  # a row for each cell
    weight = np.array([sizes.get(i, 0) for i in range(len(c))], np.float64)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            near = np.argsort(-(unit(own) @ c.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([pa.array(weight[near].sum(axis=1) / max(weight.sum(), 1.0))], ["share"])

    return _good(queries, "query_id", dimension).mapInArrow(share, "share double").agg(F.avg("share")).first()[0] or 0.0
