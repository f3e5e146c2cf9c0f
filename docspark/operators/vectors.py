"""Vector tables: checks, normalising, means, exact neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def l2_normalize(df: DataFrame, col: str = "vector") -> DataFrame:
    norm = F.greatest(F.sqrt(dot(F.col(col), F.col(col))), F.lit(1e-12))
    return df.withColumn("__norm", norm).withColumn(col, F.transform(col, lambda x: x.cast("double") / F.col("__norm"))).drop("__norm")


def validate_vectors(df: DataFrame, id_col: str, col: str, dimension: int) -> DataFrame:
    """``id, problem`` of rejected rows: null or zero key, other dimension, a value that isn't finite."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.when(F.col(id_col).isNull() | (F.col(id_col) == 0), "key").when(F.col(col).isNull() | (F.size(col) != dimension), "dimension").when(~finite, "not finite")
    return df.select(F.col(id_col).alias("id"), problem.alias("problem")).filter("problem is not null")


def mean_vector(df: DataFrame, key: str, col: str) -> DataFrame:
    """Element-wise mean by key; sums are combined before the shuffle, position by position."""
    parts = df.select(key, F.posexplode(col).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def block_best(k: int, may_meet=None, rows_at_once: int = 256):
    """For ``applyInArrow``: of rows ``asks, id, vector`` of one dimension, the ``k`` best of each asking vector among the others.

    ``may_meet``, if given, makes of the asking and the other vectors a function that tells of a range of the asking ones which others
    each may meet, as a Boolean matrix. ``rows_at_once`` asking vectors have their scores in memory.
    """

    def best(table: pa.Table) -> pa.Table:
        def unit(asks: bool) -> tuple[np.ndarray, np.ndarray]:
            own = table.filter(pa.array(table.column("asks").to_numpy() == asks))
            x = own.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1)
            return own.column("id").to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

        if not 0 < sum(table.column("asks").to_pylist()) < table.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (ids, x), (own, y) = unit(True), unit(False)
        meet = may_meet(x, y) if may_meet else None
        at, top, scores = [], [], []
        for low in range(0, len(ids), rows_at_once):
            score = np.round((1 + x[low : low + rows_at_once] @ y.T) / 2, 6)
            allowed = meet(low, low + len(score)) if meet else None
            # All that may be among the best by score, then those by score and id.
            for i in range(len(score)):
                near = np.flatnonzero(allowed[i]) if meet else np.arange(len(own))
                mine = score[i, near]
                if k < len(near):
                    best = mine >= np.partition(mine, -k)[-k]
                    near, mine = near[best], mine[best]
                order = np.lexsort((own[near], -mine))[:k]
                at.append(np.full(len(order), low + i))
                top.append(near[order])
                scores.append(mine[order])
        return pa.table({"query_id": ids[np.concatenate(at)], "id": own[np.concatenate(top)], "score": np.concatenate(scores)})

    return best


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 1024, part: int = 4096) -> DataFrame:
    """``query_id, id, score, place``: exact cosine neighbours, score (1 + cos) / 2, ties by id.

    Queries (``query_id, vector``) are dealt to blocks and vectors (``id, vector``) to parts; a task holds one block against one
    part as a matrix product and keeps the ``k`` best of each query, so neither table goes through the driver or whole
    to a task. Queries meet vectors of their own dimension; null vectors meet none.
    """
    vector = F.col("vector").cast("array<double>")
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull())
    q = queries.filter(good).select(F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"), vector.alias("vector"), F.size("vector").alias("dim"))
    v = vectors.filter(good).select(F.lit(False).alias("asks"), F.col("id").cast("long").alias("id"), vector.alias("vector"), F.size("vector").alias("dim"))
    return in_blocks(q, v, "dim", k, block, part, block_best(k))


def in_blocks(q: DataFrame, v: DataFrame, kind: str, k: int, block: int, part: int, best) -> DataFrame:
    """The ``k`` best of each query, where blocks of queries and parts of vectors (``asks, id, vector``) of one ``kind`` meet in ``best``."""
    counts = q.groupBy(kind).agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")).join(v.groupBy(kind).agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")), kind)  # a row for each kind
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), n)
    q = q.join(F.broadcast(counts), kind).select(kind, dealt("blocks").alias("b"), spread("parts").alias("p"), "asks", "id", "vector")
    v = v.join(F.broadcast(counts), kind).select(kind, spread("blocks").alias("b"), dealt("parts").alias("p"), "asks", "id", "vector")

    found = q.unionByName(v).groupBy(kind, "b", "p").applyInArrow(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def vector_summary(df: DataFrame, id_col: str, col: str, dimension: int) -> DataFrame:
    """One row: ``rows``, ``dimensions`` (different sizes), ``rejected`` rows as in ``validate_vectors``, and whether none is."""
    bad = validate_vectors(df, id_col, col, dimension).agg(F.count(F.lit(1)).alias("rejected"))
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.size(col)).alias("dimensions")).crossJoin(bad)  # one row each
    return out.withColumn("passed", F.col("rejected") == 0)
