"""Nodes, postings and BM25 search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import normalize_terms
from docspark.storage import cut


def text_lines_to_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One paragraph node per line that isn't blank; ``ordinal`` counts blank lines too, from 1."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("pos", "line"))
    text = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("ordinal"), F.lit("paragraph").alias("node_type"), text.alias("text")).filter("text != ''")


def build_postings(chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``term, chunk_id, tf, chunk_len``. Terms are counted within their row, so the shuffle by (term, chunk)
    starts from partial counts."""
    terms = chunks.select(F.col(id_col).alias("chunk_id"), normalize_terms(F.col(text_col)).alias("terms"))
    terms = terms.select("chunk_id", F.size("terms").cast("long").alias("chunk_len"), F.explode("terms").alias("term"))
    return terms.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("chunk_len").alias("chunk_len"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """``query_id, term``: distinct terms longer than one character; all of them where none is."""
    t = queries.select(F.col(id_col).alias("query_id"), F.array_distinct(normalize_terms(F.col(text_col))).alias("all"))
    long_ones = F.filter("all", lambda x: F.length(x) > 1)
    return t.select("query_id", F.explode(F.when(F.size(long_ones) > 0, long_ones).otherwise(F.col("all"))).alias("term"))


def bm25_search(terms: DataFrame, chunks: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``query_id, chunk_id, score, place``: the ``k`` best chunks of each query (``query_id, term``), score s / (1 + s), ties by id.

    Chunks are split into terms once. Each gives a row of its length, and rows of the terms that some query has; only those
    are grouped, and written once for the three uses of them.
    """
    t = chunks.select(F.col(id_col).alias("chunk_id"), normalize_terms(F.col(text_col)).alias("terms"))
    rows = t.select("chunk_id", F.size("terms").cast("long").alias("chunk_len"), F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    wanted = terms.select("term").distinct().select(F.col("term").alias("w"))
    rows = rows.join(wanted, F.col("term") == F.col("w"), "left").filter("w is not null or term is null")
    hits = cut(rows.groupBy("term", "chunk_id", "chunk_len").agg(F.count(F.lit(1)).alias("tf")))
    sizes = hits.filter("term is null and chunk_len > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("chunk_len").alias("mean_len"))
    hits = hits.filter("term is not null")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").join(terms, "term").crossJoin(F.broadcast(sizes))  # sizes: one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("chunk_len") / F.col("mean_len")))
    total = scored.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("s"))
    total = total.select("query_id", "chunk_id", F.round(F.col("s") / (1 + F.col("s")), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return total.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
