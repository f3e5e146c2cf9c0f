"""Fused ranking of hits from several channels. Hits: ``query_id, channel, place, file_id, chunk_id, reason, score``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a channel's reciprocal rank; others weigh 0.7.
WEIGHTS = {"filename": 1.3, "path": 1.3, "semantic": 1.15, "fulltext": 1.0}


def rrf_fuse(hits: DataFrame, k: int = 60) -> DataFrame:
    """``query_id, item, fused, place``: sum of 1 / (k + place) over lists, places from 1."""
    fused = hits.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("fused"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "item")))


def fuse_channels(hits: DataFrame, k: int = 60, per_file: int = 3) -> DataFrame:
    """Candidates ``query_id, file_id, chunk_id, fused, reasons, best_score``.

    A chunk's first sight, in channel and place order, counts only for the first ``per_file`` new chunks of
    its file; later sights count always. One repartition by query serves every window.
    """
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("reason")], F.lit(0.7))
    sight = Window.partitionBy("query_id", "file_id", "chunk_id").orderBy("channel", "place")
    h = hits.repartition("query_id").withColumn("sight", F.row_number().over(sight))
    news = Window.partitionBy("query_id", "file_id").orderBy("channel", "place", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("new", F.sum((F.col("sight") == 1).cast("int")).over(news))
    counts = (F.col("sight") > 1) | (F.col("new") <= per_file)
    h = h.withColumn("part", F.when(counts, weight / (k + F.col("place"))))
    out = h.groupBy("query_id", "file_id", "chunk_id").agg(F.sum("part").alias("fused"), F.array_join(F.array_sort(F.collect_set(F.when(counts, F.col("reason")))), ",").alias("reasons"), F.max(F.when(counts, F.col("score"))).alias("best_score"))
    return out.filter("fused is not null").withColumn("fused", F.round("fused", 9))


def boost_names(candidates: DataFrame) -> DataFrame:
    """2 more for a file name match, else 1 more for a path match."""
    has = lambda r: F.array_contains(F.split("reasons", ","), r)
    return candidates.withColumn("fused", F.round(F.col("fused") + F.when(has("filename") | has("filename_fuzzy"), 2.0).when(has("path"), 1.0).otherwise(0.0), 9))


def collapse_to_files(candidates: DataFrame, n: int) -> DataFrame:
    """The best candidate of each file, the ``n`` best files of each query; ties by id."""
    one = Window.partitionBy("query_id", "file_id").orderBy(F.desc("fused"), "chunk_id")
    best = candidates.withColumn("r", F.row_number().over(one)).filter("r = 1").drop("r")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "file_id"))).filter(F.col("place") <= n)


def evidence_filter(candidates: DataFrame, semantic: bool = True) -> DataFrame:
    """Keeps semantic >= 0.70, or >= 0.60 with fulltext >= 0.05; without a semantic engine fulltext >= 0.05."""
    s, f = F.coalesce("semantic", F.lit(0.0)), F.coalesce("fulltext", F.lit(0.0))
    return candidates.filter((s >= 0.70) | ((s >= 0.60) & (f >= 0.05)) if semantic else f >= 0.05)


def query_gate(candidates: DataFrame) -> DataFrame:
    """Queries with a semantic score >= 0.80 or a full-text score >= 0.30 anywhere."""
    best = candidates.groupBy("query_id").agg(F.max("semantic").alias("max_semantic"), F.max("fulltext").alias("max_fulltext"))
    return best.withColumn("passed", (F.coalesce("max_semantic", F.lit(0.0)) >= 0.80) | (F.coalesce("max_fulltext", F.lit(0.0)) >= 0.30))


def page_results(ranked: DataFrame, offset: int, size: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``size`` of every query's ranking."""
    return ranked.filter((F.col("place") > offset) & (F.col("place") <= offset + size))


def sorted_files(candidates: DataFrame, sort: str, n: int) -> DataFrame:
    """The best candidate of each file, the first ``n`` files of each query: by ``relevance`` (then newest), ``modified`` or ``name``; ties by id."""
    orders = {"relevance": [F.desc("fused"), F.desc_nulls_last("modified_at")], "modified": [F.desc_nulls_last("modified_at")], "name": [F.asc_nulls_last(F.lower("display_name"))]}
    one = Window.partitionBy("query_id", "file_id").orderBy(F.desc("fused"), "chunk_id")
    best = candidates.withColumn("r", F.row_number().over(one)).filter("r = 1").drop("r")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*orders[sort], "file_id"))).filter(F.col("place") <= n)


def ranking_digest(ranked: DataFrame) -> DataFrame:
    """One row ``fingerprint``: a digest of a ranking (``query_id, item, place``) that doesn't hang on the order of its rows."""
    return ranked.agg(F.sha2(F.coalesce(F.sum(F.xxhash64("query_id", "item", "place").cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).substr(1, 16).alias("fingerprint"))


def cursor_page(ranked: DataFrame, cursor: str | None, size: int, most: int = 100_000) -> DataFrame:
    """A page of every query's ranking from a cursor ``v1:offset:fingerprint`` (None: the first), with the ``cursor`` of the next one.

    A cursor of another form or beyond ``most`` is an error; one of another ranking gives no rows.
    """
    offset, digest = 0, None
    if cursor is not None:
        version, _, rest = cursor.partition(":")
        number, _, digest = rest.partition(":")
        if version != "v1" or not number.isdigit() or not digest or int(number) > most:
            raise ValueError(f"not a cursor: {cursor}")
        offset = int(number)
    now = ranking_digest(ranked)
    page = page_results(ranked, offset, size).crossJoin(F.broadcast(now))  # one row
    page = page if digest is None else page.filter(F.col("fingerprint") == digest)
    return page.withColumn("cursor", F.concat_ws(":", F.lit("v1"), F.lit(str(offset + size)), "fingerprint")).drop("fingerprint")
