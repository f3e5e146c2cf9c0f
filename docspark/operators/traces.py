"""Views of traces and logs, routing of recognised pages, failure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trace_view(nodes: DataFrame, operations: DataFrame, stages: list[str]) -> DataFrame:
    """``operation_id, place, node, record_id``: an operation's records by stage in the fixed order, then by time."""
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("node"))
    n = nodes.withColumn("stage", rank).filter("stage > 0").join(operations.select("operation_id", "correlation_id"), "correlation_id")
    place = F.row_number().over(Window.partitionBy("operation_id").orderBy("stage", "ts", "record_id"))
    return n.select("operation_id", place.alias("place"), "node", "record_id")


def query_logs(log: DataFrame, equal: dict | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """A page of log rows (``ts, record_id``, others), newest first, each with the ``total`` that the filter finds."""
    for name, value in (equal or {}).items():
        log = log.filter(F.col(name) == value)
    total = log.agg(F.count(F.lit(1)).alias("total"))
    return log.orderBy(F.desc("ts"), F.desc("record_id")).offset(page * size).limit(size).crossJoin(F.broadcast(total))  # total: one row


def ocr_routing(lines: DataFrame, threshold: float = 0.45) -> DataFrame:
    """``asset_id, page, fallback, complexity, needs_vision`` from recognised lines (``kind, text, confidence``).

    Fallback: no text, no confidence, or a mean below ``threshold``. Complexity: fewer than 48 visible characters
    (scanned pages excepted), chart-like (3 lines, a fifth digits, 600 characters at most), or a layout of short lines.
    """
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    seen = F.regexp_replace(clean, r"(?U)\s+", "")
    n = lines.withColumns({"clean": clean, "seen": seen}).groupBy("asset_id", "page").agg(
        F.min("kind").alias("kind"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("clean")).alias("chars"), F.sum(F.length("seen")).alias("compact"),
        F.sum(F.length(F.regexp_replace("seen", r"\P{Nd}", ""))).alias("digits"), F.avg("confidence").alias("mean"),
    )
    fallback = F.when(F.col("chars") == 0, "ocr_no_text").when(F.col("mean").isNull(), "ocr_confidence_missing").when(F.col("mean") < threshold, "ocr_low_confidence")
    chart = (F.col("lines") >= 3) & (F.col("digits") / F.greatest("compact", F.lit(1)) >= 0.2) & (F.col("compact") <= 600)
    layout = (F.col("lines") >= 4) & (F.col("chars") / F.col("lines") <= 12) & (F.col("compact") <= 400)
    complexity = F.when((F.col("kind") != "pdf_scanned_page") & (F.col("compact") < 48), "complex_sparse_text").when(chart, "complex_chart_like").when(layout, "complex_layout")
    return n.select("asset_id", "page", fallback.alias("fallback"), complexity.alias("complexity")).withColumn("needs_vision", F.col("fallback").isNotNull() | F.col("complexity").isNotNull())


def analyze_failures(results: DataFrame, categories: list[str], samples: int = 3, salts: int = 64) -> DataFrame:
    """``category, failed, rate, diagnoses, top`` of the failed cases (``case_id, passed, category, diagnosis``).

    ``rate`` is in per cent of all cases; unknown categories count as the last; ``top`` marks the first three that
    occur, in the order given. First diagnoses are found by part, then over the few that the parts keep.
    """
    known = F.when(F.col("category").isin(categories), F.col("category")).otherwise(categories[-1])
    bad = results.filter("not passed").withColumns({"category": known, "salt": F.pmod(F.xxhash64("case_id"), F.lit(salts))})
    total = results.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("all"))
    n = bad.groupBy("category").agg(F.count(F.lit(1)).alias("failed"))
    said = bad.filter("diagnosis is not null").select("category", "salt", "case_id", "diagnosis")
    for keys in (["category", "salt"], ["category"]):
        w = Window.partitionBy(*keys).orderBy("case_id", "diagnosis")
        said = said.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= samples)
    said = said.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "diagnosis"))), lambda s: s["diagnosis"]), "; ").alias("diagnoses"))
    order = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    out = n.join(said, "category", "left").crossJoin(F.broadcast(total)).withColumn("rate", F.round(F.col("failed") * 100 / F.col("all"), 6))  # total: one row
    return out.withColumn("top", F.row_number().over(Window.orderBy(order)) <= 3).select("category", "failed", "rate", "diagnoses", "top")  # a row a category


def query_traces(nodes: DataFrame, operations: DataFrame, flow: str | None = None, node: str | None = None, feature: str | None = None, page: int = 0, size: int = 50) -> DataFrame:
    """A page of operations (``operation_id, correlation_id, flow, feature, ts``), newest first, that have the flow, the feature and a record of the node; with ``total``."""
    found = operations
    for column, value in (("flow", flow), ("feature", feature)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    if node is not None:
        found = found.join(nodes.filter(F.col("node") == node).select("correlation_id"), "correlation_id", "left_semi")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy(F.desc("ts"), F.desc("operation_id")).offset(page * size).limit(size).crossJoin(F.broadcast(total))  # total: one row
