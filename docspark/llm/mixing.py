"""Mixing sources to target weights by entropy balancing.

Rates r of documents minimise the relative entropy of the mix's token distribution to the corpus's under linear
token constraints: documents of source s give T_s tokens, and the tokens' mean logarithm of document length stays
near the corpus's, so that favouring sources of short documents doesn't make the mix short (a soft constraint: sources'
targets are met whatever it costs). No rate exceeds the most copies. The solution is r = min(most, exp(multiplier of the source + multiplier of length * log length)), the convex
dual's exponential tilt. Newton iterations on the dual take gradient and Hessian from Spark aggregations over cells
(source and length class, not documents); rates are then rounded to whole copies by order sampling that meets each
source's tokens.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Length classes to a doubling of length.
CLASSES = 4
#: Sums of tokens are taken of whole numbers of this share of one, so that they hang on no order.
GRAIN = 1 << 20
#: How soft the length constraint is: the price of its multiplier's square, in the square deviation of the corpus.
RIDGE = 1.0
#: A multiplier that takes every rate to its bound.
ALL = 500.0


def targets_by_weight(sizes: dict[str | None, int], weights: tuple[int, ...], max_repeat: int) -> dict[str | None, float]:
    """Target of each source: shares of all sizes by weight, none above ``max_repeat`` times its size.

    Weights go round the sources in code-point order, null last. Sources are filled in the order of cap over weight: those
    whose cap is under an even share of what is left get the cap, the others share the rest by weight, which is where
    repeated resharing ends.
    """
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_weight, targets = sum(sizes.values()), sum(weight.values()), {}
    rising = sorted(order, key=lambda s: max_repeat * sizes[s] / weight[s])
    while rising and max_repeat * sizes[rising[0]] / weight[rising[0]] <= rest / open_weight:
        s = rising.pop(0)
        targets[s] = float(max_repeat * sizes[s])
        rest, open_weight = rest - max_repeat * sizes[s], open_weight - weight[s]
    return targets | {s: rest / open_weight * weight[s] for s in rising}


def _exact(x) -> F.Column:
    return F.sum(F.round(x * GRAIN).cast("decimal(38,0)"))


def solve_dual(cells: DataFrame, targets: dict, mean: float, most: float, rounds: int = 100, tolerance: float = 1e-9) -> tuple[dict, float]:
    """The multiplier of each source and that of length, for ``cells`` (``source, level, mass``; written).

    Each round is one joint Newton step: its Hessian has a diagonal for the sources and a full row and column for
    length, and is solved by its Schur complement. A step that lowers the (concave) dual is halved. Cells at the bound of
    the rates don't move with the multipliers, so they count in the gradient alone. The driver holds a few numbers for
    each source, as many as there are constraints.
    """
    spark = cells.sparkSession
    total = sum(targets.values())
    sources = [s for s, t in targets.items() if t > 0]
    if not sources:
        return {}, 0.0
    source_mass = {r.source: float(r.mass) for r in cells.groupBy("source").agg(F.sum("mass").alias("mass")).collect()}
    goal, mass = np.array([targets[s] for s in sources]), np.array([source_mass[s] for s in sources])
    full = goal >= most * mass  # every rate is the bound
    lam, mu = np.where(full, ALL, np.log(goal / mass)), 0.0
    z = F.col("level") - mean
    u = F.col("lam") + F.col("mu") * z
    free, cap = F.exp(F.least(u, F.lit(math.log(most)))), F.lit(math.log(most))
    moving = F.when(u < cap, F.col("mass") * free).otherwise(0.0)
    sums = {"tokens": F.col("mass") * free, "length": F.col("mass") * free * z, "a": moving, "b": moving * z, "c": moving * z * z, "phi": F.col("mass") * (free + most * F.greatest(F.lit(0.0), u - cap))}
    best, step, at = -math.inf, None, (lam, mu)
    for _ in range(rounds):
        now = spark.createDataFrame([(s, x, mu) for s, x in zip(sources, lam.tolist(), strict=True)], "s string, lam double, mu double")
        rated = cells.join(F.broadcast(now), F.col("source").eqNullSafe(F.col("s")))  # a row for each source
        found = {r.source: [float(x) / GRAIN for x in r[1:]] for r in rated.groupBy("source").agg(*(_exact(x).alias(n) for n, x in sums.items())).collect()}
        tokens, length, a, b, c, phi = np.array([found[s] for s in sources]).T
        value = (goal * lam - phi)[~full].sum() - length[full].sum() * mu - RIDGE / 2 * total * mu * mu
        if step is not None and value < best - 1e-12 * total:
            step = step[0] / 2, step[1] / 2
        else:
            gap = np.where(full, 0.0, goal - tokens)
            pull = -length.sum() - RIDGE * total * mu
            if max(np.abs(gap).max(), abs(pull)) <= tolerance * total:
                return dict(zip(sources, lam.tolist(), strict=True)), mu
            best, at = value, (lam, mu)
            stuck = (a == 0) & ~full  # all its cells are at the bound, though its target isn't
            a = np.where(a > 0, a, np.inf)
            turn = float((pull - (b * gap / a).sum()) / (c.sum() + RIDGE * total - (b * b / a).sum()))
            step = np.where(stuck, -0.5, (gap - b * turn) / a), turn
        lam, mu = at[0] + step[0], at[1] + step[1]
    return dict(zip(sources, at[0].tolist(), strict=True)), at[1]


def copies_from_rates(docs: DataFrame, source_targets: DataFrame, max_repeat: int, buckets: int = 1024) -> DataFrame:
    """``docs`` (``doc_id, text_hash, row, source, size, rate``) with whole ``copies``.

    Everyone gets the whole part of its rate; the rest of a source's target goes, one more copy each, to
    documents in the order of (digest of the id) / (fraction of the rate), which takes them about in
    proportion to their fractions, until the next would pass the target by more than half its size. Running
    sums go by bucket of that order first, so a source with most of the rows is summed by many tasks.
    """
    rate = F.least(F.col("rate"), F.lit(float(max_repeat)))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))
    d = docs.withColumn("whole", F.floor(rate + 1e-9)).withColumn("fraction", F.greatest(F.lit(0.0), rate - F.col("whole")))
    d = d.withColumns({"given": F.col("whole") * F.col("size"), "turn": F.when((F.col("fraction") > 1e-9) & (F.col("size") > 0), draw / F.col("fraction"))})
    d = cut(d.withColumns({"bucket": F.least(F.floor(F.col("turn") * buckets), F.lit(1 << 20)), "open": F.when(F.col("turn").isNotNull(), F.col("size")).otherwise(0)}))
    sums = d.groupBy("source", "bucket").agg(F.sum("given").alias("given"), F.sum("open").alias("open"))
    per = Window.partitionBy("source")
    earlier = per.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.sum("given").over(per).alias("given_all"), F.coalesce(F.sum("open").over(earlier), F.lit(0)).alias("before"))
    sums = sums.filter("__b is not null").join(source_targets.select(F.col("source").alias("__t"), "target"), F.col("__s").eqNullSafe(F.col("__t"))).select("__s", "__b", "before", (F.col("target") - F.col("given_all")).alias("missing"))
    here = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    waiting = d.filter("bucket is not null").withColumn("inside", F.coalesce(F.sum("open").over(here), F.lit(0)))
    waiting = waiting.join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    extra = (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("missing")).cast("int")
    columns = [*docs.columns, F.col("whole").cast("long").alias("copies")]
    settled = d.filter("bucket is null").select(*columns)
    return settled.unionByName(waiting.withColumn("whole", F.col("whole") + extra).select(*columns))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    max_repeat: int = 3,
) -> DataFrame:
    """One row per input row: ``doc_id, text_hash, source, size, source_size, target, rate, copies, taken``.

    Null texts have size 0 and are never taken; null sources are a source of their own, last in order.
    Repeated rows are mixed row by row. No rows give no rows; other columns are not read. Draws hang on the
    id alone, and ties go by the text, so reruns agree.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"), F.monotonically_increasing_id().alias("row"),
    )
    sized = cut(sized)
    level = F.floor(F.log2(F.greatest("size", F.lit(1))) * CLASSES) / CLASSES
    cells = cut(sized.groupBy("source", level.alias("level")).agg(F.sum("size").alias("mass")))
    sizes = {r.source: r.mass for r in cells.groupBy("source").agg(F.sum("mass").alias("mass")).collect()}  # a row for each source
    targets = targets_by_weight(sizes, weights, max_repeat)
    mean = cells.agg(_exact(F.col("mass") * F.col("level")).alias("m")).first().m
    mean = float(mean or 0) / GRAIN / max(1, sum(sizes.values()))
    lam, mu = solve_dual(cells.filter("mass > 0"), targets, mean, float(max_repeat))
    rows = [(s, sizes[s], targets[s], lam.get(s)) for s in sizes]
    table = spark.createDataFrame(rows, "__s string, source_size long, target double, lam double")
    # Rates have nine decimals, which is more than the dual's tolerance and hides the last bits of its sums.
    rate = F.round(F.least(F.lit(float(max_repeat)), F.coalesce(F.exp(F.col("lam") + mu * (level - mean)), F.lit(0.0))), 9)
    rated = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("__s"))).withColumn("rate", rate).drop("__s", "lam")
    out = copies_from_rates(rated.withColumnRenamed("target", "goal"), table.select(F.col("__s").alias("source"), "target"), max_repeat)
    return out.select("doc_id", "text_hash", "source", "size", "source_size", F.col("goal").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, each row as often as ``mix`` takes it.

    Rows that are equal in id and text share their copies evenly.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    copies = mix(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    same = docs[id_col].eqNullSafe(copies["__id"]) & (F.xxhash64(docs[text_col]) == copies["__hash"])
    taken = docs.join(copies.filter("__copies > 0"), same)
    number = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.lit(0)))
    single = taken.filter("__rows = 1")
    share = F.floor(F.col("__copies") / F.col("__rows")) + (number <= F.col("__copies") % F.col("__rows")).cast("int")
    shared = taken.filter("__rows > 1").withColumn("__copies", share).filter("__copies > 0")
    out = single.unionByName(shared)
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies").cast("long")))).select(*docs.columns)
