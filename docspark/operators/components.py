"""Connected components of an edge table by large-star / small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.storage import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node around it: larger ones (large), or no larger ones."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("b").alias("u"), F.col("m").alias("v")).union(least.select(F.col("a").alias("u"), F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", most_rounds: int = 40) -> DataFrame:
    """``node, component`` for every node with an edge; the component is its smallest node.

    Rounds contract the graph to stars in a logarithmic number of rounds; a round's edges are written to
    the shared folder. Edges with a null end and loops are left out. A hub's edges are joined to one row,
    which Spark splits when the hub is skewed. Raises if ``most_rounds`` don't suffice.
    """
    now = cut(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null and u != v").distinct())
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        got = print_of(now)
        if tuple(got) == tuple(seen):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = got
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
