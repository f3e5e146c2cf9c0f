"""Exact duplicates by content sort, in DataFrame functions only.

Normalised texts are dealt by range over (leading characters, digest, salt) with Spark's sampled
splitters and sorted externally, so equal contents stand next to each other and a window compares
whole neighbouring contents. The salt cuts a large group of copies into pieces that different tasks
sort; each piece leaves one head, and heads (a digest and a few numbers, no text) meet in a second
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_small, shuffle_width

#: What normalisation deletes, as a Java pattern.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def _pieces(docs: DataFrame, id_col: str, text_col: str, salts: int | None, columns: list[str]) -> DataFrame:
    """``docs`` in content order: ``id, row, n_chars, text_sha256, place, size`` within each piece of equal contents, and ``columns``.

    Only the text travels: the content is taken from it before and after the shuffle.
    """
    salts = salts or max(64, shuffle_width(docs.sparkSession))
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, WHITE_SPACE, "")
    rows = docs.withColumns({"__id": F.col(id_col), "__row": F.monotonically_increasing_id(), "__sha": F.sha2(content, 256), "__lead": F.substring(content, 1, 24)})
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__id", "__row"), F.lit(salts)))
    rows = rows.repartitionByRange("__lead", "__sha", "__salt").withColumns({"__content": content, "__chars": F.length(text)})
    ordered = Window.partitionBy("__lead", "__sha", "__salt", "__content").orderBy(F.desc("__chars"), "__id", "__row")
    return rows.select(
        F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("__chars").cast("long").alias("n_chars"), F.col("__sha").alias("text_sha256"),
        F.row_number().over(ordered).alias("place"),
        F.count(F.lit(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
        F.struct(*columns).alias("__all"),
    )


def _order() -> Column:
    return F.struct((-F.col("n_chars")).alias("longest"), F.col("id"), F.col("row"))


def _keepers(heads: DataFrame) -> DataFrame:
    """The row that stays of each content, among the heads of its pieces."""
    return heads.groupBy(F.col("text_sha256").alias("digest")).agg(F.min(_order()).alias("keeper"), F.sum("size").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256, n_chars``.

    Of texts equal without white space the one with most code points stays, then the smallest id (a
    null id is smallest). Null counts as empty. Rows equal in id and text are copies of each other:
    one of them stays. Other columns of ``docs`` are not read.
    """
    docs = docs.select(id_col, text_col)
    sorted_rows = cut(_pieces(docs, id_col, text_col, salts, [F.lit(0).alias("none")]).drop("__all"))
    groups = _keepers(sorted_rows.filter("place = 1"))
    return sorted_rows.join(groups, F.col("text_sha256") == F.col("digest")).select(
        F.col("id").alias("doc_id"),
        F.col("keeper.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keeper.row")).alias("kept"),
        "text_sha256",
        "n_chars",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """``docs`` with all its columns, one row of each group of equal texts, as ``exact_duplicates`` decides."""
    heads = cut(_pieces(docs, id_col, text_col, salts, [F.col(c) for c in docs.columns]).filter("place = 1"))
    # Most contents have one piece, whose head stays; of the others' heads all but the keeper go.
    groups = heads.drop("__all").groupBy(F.col("text_sha256").alias("digest")).agg(F.min(_order()).alias("keeper"), F.count(F.lit(1)).alias("pieces"))
    several = groups.filter("pieces > 1").select("digest", F.col("keeper.row").alias("stays"))
    losers = cut(heads.select("text_sha256", "row").join(several, F.col("text_sha256") == F.col("digest")).filter("row != stays").select(F.col("row").alias("gone")))
    kept = join_small(heads, losers, F.col("row") == F.col("gone"), "left_anti")
    return kept.select(*(F.col("__all")[c].alias(c) for c in docs.columns))
