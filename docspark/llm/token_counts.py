"""Exact length histogram of a corpus under a tokenizer, with suffix sums for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import cut


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every row; null and empty texts have 0 tokens. Other columns are not read."""
    path = tokenizer or tokens.default_path()

    def count(batches):
        encoder = tokens.encoder(path)
        for batch in batches:
            for block, part in tokens.text_blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encoder.counts(block))], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 4096) -> DataFrame:
    """One row per distinct length ``n_tokens``: documents, suffix sums, and totals at that context limit.

    ``docs_at_least`` and ``tokens_at_least`` sum over documents of this length or more, so quantiles are
    a lookup; ``truncated_tokens`` is the corpus total with every document cut to ``n_tokens``. Sums run in
    blocks of lengths with the blocks' totals added, so no task holds all lengths. An empty corpus gives
    no rows; rows without a length are left out.
    """
    histogram = cut(lengths.filter("n_tokens is not null").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    histogram = histogram.withColumns({"part": F.floor(F.col("n_tokens") / block), "mass": F.col("n_docs") * F.col("n_tokens")})
    parts = histogram.groupBy("part").agg(F.sum("n_docs").alias("d"), F.sum("mass").alias("m"))
    later = Window.partitionBy(F.lit(0)).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per 4,096 lengths
    parts = parts.select("part", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("m").over(later), F.lit(0)).alias("mass_after"))
    here = Window.partitionBy("part").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    total = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("mass"), F.lit(0)).alias("tokens"))
    out = histogram.withColumns({"docs_here": F.sum("n_docs").over(here), "mass_here": F.sum("mass").over(here)}).join(parts, "part")
    out = out.withColumns({"docs_at_least": F.col("docs_here") + F.col("docs_after"), "tokens_at_least": F.col("mass_here") + F.col("mass_after")})
    return out.crossJoin(F.broadcast(total)).select(  # total: one row
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("docs")).alias("quantile"),
    )
