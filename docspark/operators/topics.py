"""Files of like meaning: pairs, topic groups, suggestions, approximate neighbours, and ranking by a given scorer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.components import connected_components
from docspark.operators.neighbours import train_cells
from docspark.operators.neighbours import unit as _unit
from docspark.operators.vectors import block_best, dot, in_blocks, l2_normalize
from docspark.storage import cut


#: Vectors at most that the pivots of ``semantic_pairs`` are fitted on, and pivots at most.
PIVOT_SAMPLE, MOST_PIVOTS = 8192, 256
#: Files of a tile, in which parts go through the shuffle together.
TILE = 4096


def _floats(df: DataFrame) -> Column:
    """The vectors as they are if they are single numbers, which take half the room; else as doubles."""
    return F.col("vector") if dict(df.dtypes)["vector"] == "array<float>" else F.col("vector").cast("array<double>")


def _parts(profiles: DataFrame, part: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Files by nearest pivot (``bucket, file_id, vector, pivot, angle, own``), each bucket's parts (``bucket, pivot, own, radius``), and the pivots.

    A part holds about ``part`` files of one bucket and pivot; its radius is the largest angle to the pivot. The pivots are
    k-means centroids of a sample of ``PIVOT_SAMPLE`` vectors at most, those of the smallest hashed ids.
    """
    p = profiles.filter("vector is not null and bucket is not null").select("bucket", F.col("file_id").cast("long").alias("file_id"), _floats(profiles).alias("vector"))
    sample = np.array([r["vector"] for r in p.orderBy(F.xxhash64("file_id"), "file_id").limit(PIVOT_SAMPLE).select("vector").collect()], np.float64)
    if not len(sample):
        sample = np.zeros((1, 1))
    size = p.count()
    pivots = train_cells(_unit(sample), int(np.clip(2 * size // max(part, 1), 1, min(MOST_PIVOTS, max(len(sample) // 8, 1)))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = _unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)) @ pivots.T
            own = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], [*batch.schema.names, "pivot", "angle"])

    kinds = dict(p.dtypes)
    placed = cut(p.mapInArrow(near, f"bucket {kinds['bucket']}, file_id long, vector {kinds['vector']}, pivot int, angle double"))
    sizes = placed.groupBy("bucket", "pivot").agg(F.ceil(F.count(F.lit(1)) / part).alias("parts"))
    placed = placed.join(sizes, ["bucket", "pivot"]).withColumn("own", F.pmod(F.xxhash64("file_id"), "parts")).drop("parts")
    return placed, placed.groupBy("bucket", "pivot", "own").agg(F.max("angle").alias("radius")), pivots


def _blocks(parts: DataFrame, pivots: np.ndarray, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of parts of a bucket that may hold a pair of files, and all pairs of parts.

    Files at angles r and s from pivots at an angle d are at least d - r - s apart. Scores are rounded before they are compared.
    """
    between = parts.sparkSession.createDataFrame([(i, j, float(a)) for i, row in enumerate(np.arccos(np.clip(pivots @ pivots.T, -1, 1))) for j, a in enumerate(row)], "p1 int, p2 int, apart double")
    side = lambda n: parts.select("bucket", F.col("pivot").alias(f"p{n}"), F.col("own").alias(f"o{n}"), F.col("radius").alias(f"r{n}"))
    every = side(1).join(side(2), "bucket").filter("p1 < p2 or (p1 = p2 and o1 <= o2)")
    most = math.acos(max(min(threshold - 1e-6, 1.0), -1.0)) + 1e-9
    return every.join(F.broadcast(between), ["p1", "p2"]).filter((F.col("p1") == F.col("p2")) | (F.col("apart") - F.col("r1") - F.col("r2") <= most)), every  # at most MOST_PIVOTS squared rows


def semantic_pairs(profiles: DataFrame, threshold: float = 0.8, part: int = 1024) -> DataFrame:
    """``left_file_id, right_file_id, confidence``: files of one bucket (``file_id, bucket, vector``) of at least this cosine.

    Files are dealt to parts of about ``part`` by bucket and nearest pivot. Two parts are multiplied as matrices, unless the
    angle between their pivots shows by the triangle inequality that none of their files are near enough. Parts travel in tiles of some
    ``TILE`` files, a task has two tiles, so a vector is sent as often as its bucket has tiles and a task's memory doesn't grow with
    the bucket. Vectors of a bucket have one length; null buckets and vectors have no pairs.
    """
    placed, parts, pivots = _parts(profiles, part)
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("pivot", "own")) - 1
    parts = cut(parts.withColumn("tile", F.floor(at / max(TILE // part, 1)).cast("int")))
    kept = _blocks(parts, pivots, threshold)[0].select("bucket", "p1", "o1", "p2", "o2")
    for n in (1, 2):
        kept = kept.join(parts.select("bucket", F.col("pivot").alias(f"p{n}"), F.col("own").alias(f"o{n}"), F.col("tile").alias(f"t{n}")), ["bucket", f"p{n}", f"o{n}"])
    kept = cut(kept.select("bucket", "t1", "t2").distinct())
    tiled = placed.join(parts, ["bucket", "pivot", "own"]).drop("angle")
    sides = [tiled.join(kept.withColumn("tile", F.col(f"t{n}")), ["bucket", "tile"]).select("bucket", "t1", "t2", F.lit(n).alias("side"), "pivot", "own", "radius", "file_id", "vector") for n in (1, 2)]
    blocks = sides[0].unionByName(sides[1].filter("t1 != t2"))
    apart, most = np.arccos(np.clip(pivots @ pivots.T, -1, 1)), math.acos(max(min(threshold - 1e-6, 1.0), -1.0)) + 1e-9

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "pivot", "own"], ignore_index=True)
        v, ids = _unit(np.stack(pdf["vector"].to_numpy()).astype(np.float64)), pdf["file_id"].to_numpy()
        side, pivot, own, radius = (pdf[c].to_numpy() for c in ("side", "pivot", "own", "radius"))
        first = np.flatnonzero(np.concatenate([[True], (side[1:] != side[:-1]) | (pivot[1:] != pivot[:-1]) | (own[1:] != own[:-1])]))
        part_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        apart_tiles = side[-1] != side[0]
        found = []
        for a in np.flatnonzero(side[first] == 1):
            others = side[first] == 2 if apart_tiles else np.arange(len(first)) >= a
            near = (pivot[first] == pivot[first[a]]) | (apart[pivot[first], pivot[first[a]]] - radius[first] - radius[first[a]] <= most)
            left, right = np.flatnonzero(part_of == a), np.flatnonzero((others & near)[part_of])
            if not len(right):
                continue
            score = np.round(v[left] @ v[right].T, 6)
            i, j = np.nonzero(score >= threshold)
            x, y, s = ids[left[i]], ids[right[j]], score[i, j]
            keep = np.where(part_of[right[j]] == a, x < y, x != y)
            found.append((np.minimum(x, y)[keep], np.maximum(x, y)[keep], s[keep]))
        x, y, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pd.DataFrame({"left_file_id": x, "right_file_id": y, "confidence": s})

    return blocks.groupBy("bucket", "t1", "t2").applyInPandas(match, "left_file_id long, right_file_id long, confidence double")


def block_share(profiles: DataFrame, threshold: float = 0.8, part: int = 1024) -> tuple[int, int]:
    """How many pairs of parts ``semantic_pairs`` multiplies, and how many there are."""
    _, parts, pivots = _parts(profiles, part)
    kept, every = _blocks(cut(parts), pivots, threshold)
    return kept.count(), every.count()


#: Seeds of a component that one round works on.
SEEDS = 256


def seed_expand_groups(profiles: DataFrame, consumed: DataFrame, threshold: float = 0.8, k: int = 8, cap: int | None = None, seeds: int = SEEDS) -> DataFrame:
    """``seed_file_id, file_id, similarity, confidence``: exclusive groups around seeds, by bucket (``file_id, bucket, vector``).

    Files already ``consumed`` are left out; with ``cap`` only a bucket's first files by id take part. Files become seeds in the order of their
    nearest neighbour's similarity, then the mean to their bucket, then id; a seed takes its ``k`` nearest free files of at least
    ``threshold``. Confidence is their mean, in whole millionths.

    Similar files form a graph, whose components don't touch each other. Each round gives a task the ``seeds`` best free files of a component, each with
    its nearest free neighbours, as many as could be taken before its turn and ``k`` more; so the task takes what one pass
    over the whole bucket would, and holds rows of that number only. A file has one turn: what it couldn't take then it can't later. A round
    reads the pairs and writes only the files that were taken and those that still wait, so what is written doesn't grow with pairs times rounds.
    """
    free = profiles.join(consumed.select("file_id"), "file_id", "left_anti").filter("vector is not null and bucket is not null")
    if cap is not None:
        free = free.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("file_id"))).filter(F.col("place") <= cap)
    free = cut(free.select("bucket", F.col("file_id").cast("long").alias("file_id"), _floats(free).alias("vector")))
    pairs = cut(semantic_pairs(free, threshold))
    both = pairs.select(F.col("left_file_id").alias("file_id"), F.col("right_file_id").alias("other"), F.col("confidence").alias("similarity"))
    both = both.union(pairs.select("right_file_id", "left_file_id", "confidence"))
    order = both.groupBy("file_id").agg(F.max("similarity").alias("nearest")).join(_bucket_means(free), "file_id")
    parts = connected_components(pairs, "left_file_id", "right_file_id").select(F.col("node").alias("file_id"), "component")
    order = cut(order.join(parts, "file_id"))
    most = k + seeds * (k + 1)

    def expand(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["nearest", "mean", "file_id", "similarity", "other"], ascending=[False, False, True, False, True])
        taken, out = set(), []
        for seed, own in pdf.groupby("file_id", sort=False):
            if seed in taken:
                continue
            got = [(o, s) for o, s in zip(own["other"], own["similarity"], strict=True) if o not in taken][:k]
            if got:
                taken.update(o for o, _ in got)
                taken.add(seed)
                millionths = sum(round(s * 1e6) for _, s in got)
                mean = (2 * millionths + len(got)) // (2 * len(got)) / 1e6
                out += [(seed, o, s, mean) for o, s in got]
        return pd.DataFrame(out, columns=["seed_file_id", "file_id", "similarity", "confidence"])

    schema = "seed_file_id long, file_id long, similarity double, confidence double"
    groups, waiting, taken = profiles.sparkSession.createDataFrame([], schema), order, None
    best = Window.partitionBy("component").orderBy(F.desc("nearest"), F.desc("mean"), "file_id")
    while True:
        turn = cut(waiting.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= seeds).drop("turn"))
        if not turn.limit(1).count():
            return groups
        near = both.join(turn, "file_id")
        if taken is not None:
            near = near.join(taken, F.col("other") == F.col("used"), "left_anti")
        lists = near.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("similarity"), "other"))).filter(F.col("r") <= most).drop("r")
        found = cut(lists.groupBy("component").applyInPandas(expand, schema))
        groups = groups.unionByName(found)
        used = found.select(F.explode(F.array("seed_file_id", "file_id")).alias("used")).distinct()
        taken = cut(used if taken is None else taken.unionByName(used))
        rest = waiting.join(turn.select("file_id"), "file_id", "left_anti")
        waiting = cut(rest.join(taken, F.col("file_id") == F.col("used"), "left_anti"))


def _bucket_means(free: DataFrame) -> DataFrame:
    """``file_id, mean``: the mean cosine to the other files of the bucket, from the bucket's sum of unit vectors."""
    u = l2_normalize(free)
    sums = u.select("bucket", F.posexplode("vector").alias("pos", "x")).groupBy("bucket", "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = sums.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sum"), F.max("n").alias("n"))
    mean = (dot(F.col("vector"), F.col("sum")) - dot(F.col("vector"), F.col("vector"))) / F.greatest(F.lit(1), F.col("n") - 1)
    return u.join(sums, "bucket").select("file_id", F.round(mean, 6).alias("mean"))


def refresh_suggestions(groups: DataFrame, decided: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The ``n`` best topic groups with no file of a ``decided`` suggestion (``file_id``), as ``place, seed_file_id, file_id, confidence,
    reason``, and one row ``remaining`` with the number of groups left over. Best: most confident, then smallest seed."""
    files = groups.select("seed_file_id", "file_id").union(groups.select("seed_file_id", F.col("seed_file_id"))).distinct()
    used = files.join(decided.select("file_id"), "file_id", "left_semi").select("seed_file_id").distinct()
    fresh = groups.select("seed_file_id", "confidence").distinct().join(used, "seed_file_id", "left_anti")
    top = fresh.orderBy(F.desc("confidence"), "seed_file_id").limit(n)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), "seed_file_id")))  # n rows
    members = files.join(F.broadcast(placed), "seed_file_id").join(groups.select("seed_file_id", "file_id", "similarity"), ["seed_file_id", "file_id"], "left")
    reason = F.when(F.col("file_id") == F.col("seed_file_id"), "seed").otherwise("similar to the seed")
    out = members.select("place", "seed_file_id", "file_id", F.coalesce("similarity", "confidence").alias("confidence"), reason.alias("reason"))
    return out, fresh.agg(F.greatest(F.lit(0), F.count(F.lit(1)) - n).alias("remaining"))


def vector_topk_lsh(queries: DataFrame, vectors: DataFrame, k: int, dimension: int, planes: int = 4, tables: int = 24, seed: int = 7, block: int = 4096, part: int = 16_384) -> DataFrame:
    """``query_id, id, score, place``: approximate neighbours; candidates share one of ``tables`` buckets, and are then ranked exactly.

    A bucket is the signs of ``planes`` random projections. Score (1 + cos) / 2, ties by id; recall grows with ``tables`` and falls with
    ``planes``. With few planes most pairs share a bucket, so pairs aren't shuffled: a block of queries meets a part of the vectors in one task,
    which compares their buckets and keeps each query's best. A pair is compared once, whether or not it shares a bucket.
    Vectors of another dimension, null or not finite meet none.
    """
    normals = np.random.default_rng(seed).standard_normal((tables * planes, dimension))

    def share_a_bucket(x: np.ndarray, y: np.ndarray) -> Callable[[int, int], np.ndarray]:
        weights = 1 << np.arange(planes)
        a, b = (((u @ normals.T > 0).reshape(len(u), tables, planes) @ weights).astype(np.min_scalar_type(1 << planes)).T.copy() for u in (x, y))

        def share(low: int, high: int) -> np.ndarray:
            out = a[0, low:high, None] == b[0]
            for t in range(1, tables):
                out |= a[t, low:high, None] == b[t]
            return out

        return share

    vector = F.col("vector").cast("array<double>")
    good = (F.size(vector) == dimension) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sides = lambda df, i, asks: df.filter(good).select(F.lit(asks).alias("asks"), F.col(i).cast("long").alias("id"), vector.alias("vector"), F.size("vector").alias("dim"))
    return in_blocks(sides(queries, "query_id", True), sides(vectors, "id", False), "dim", k, block, part, block_best(k, share_a_bucket))


def rerank(candidates: DataFrame, scorer: Callable[[list[str], list[str]], np.ndarray], batch: int = 30) -> DataFrame:
    """``candidates`` (``query_id, query, text, chunk_id``) with ``score, place`` from a given model.

    ``scorer(queries, texts)`` gets at most ``batch`` rows and returns logits: one a row goes through a sigmoid, two or more
    through a softmax of which the last column counts. Rows whose score isn't finite fail the task.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            out = []
            for lo in range(0, len(q), batch):
                x = np.asarray(scorer(q[lo : lo + batch].tolist(), t[lo : lo + batch].tolist()), np.float64)
                x = x.reshape(len(x), -1)
                e = np.exp(x - x.max(axis=1, keepdims=True))
                out.append(1 / (1 + np.exp(-np.clip(x[:, 0], -30, 30))) if x.shape[1] == 1 else e[:, -1] / e.sum(axis=1))
            s = np.concatenate(out) if out else np.zeros(0)
            if len(s) != len(q) or not np.isfinite(s).all():
                raise ValueError("the scorer returned too few scores, or some that aren't finite")
            yield pd.Series(s)

    scored = candidates.withColumn("score", F.round(score("query", "text"), 6))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
