"""Retrieval, answer and relation quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition, among) -> Column:
    """Share of rows with ``condition`` among those with ``among``; 1 if there are none."""
    n = F.count_if(among)
    return F.round(F.when(n > 0, F.count_if(condition & among) / n).otherwise(1.0), 6)


def search_metrics(cases: DataFrame, k: int = 10) -> DataFrame:
    """One row: recall, MRR and nDCG at ``k`` over ``case_id, relevant, returned, elapsed_ms``, nearest-rank p95.

    Each case's figures come from its own arrays, so nothing is exploded or shuffled before the averages.
    """
    top = F.slice(F.array_distinct("returned"), 1, k)
    hits = F.size(F.array_intersect(top, "relevant"))
    ranks = F.filter(F.transform(top, lambda x, i: F.when(F.array_contains("relevant", x), i + 1)), lambda r: r.isNotNull())
    gain = lambda a: F.aggregate(a, F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    best = F.least(F.size("relevant"), F.lit(k))
    ideal = F.when(best > 0, gain(F.sequence(F.lit(1), F.greatest(best, F.lit(1))))).otherwise(1.0)
    c = cases.select(
        F.when(F.size("relevant") > 0, hits / F.size("relevant")).otherwise(0.0).alias("recall"),
        F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0)).alias("rr"),
        (gain(ranks) / ideal).alias("ndcg"), "elapsed_ms",
    )
    return c.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.expr("percentile_disc(0.95) within group (order by elapsed_ms)").alias("p95_ms"))


def rag_metrics(cases: DataFrame) -> DataFrame:
    """One row over answer cases; an empty subset counts as 1, but coverage is 0 without claims."""
    answered = F.col("generated") & ~F.col("refused")
    claims = F.sum("factual_claims")
    return cases.agg(
        F.round(F.when(claims > 0, F.sum("verified_claims") / claims).otherwise(0.0), 6).alias("citation_coverage"),
        share(F.col("expected_source_cited"), answered).alias("correctness"),
        share(F.col("refused"), F.col("expected_refusal")).alias("refusal_accuracy"),
        share(F.col("unauthorized_citations") == 0, F.lit(True)).alias("unauthorized_rejection"),
        F.expr("percentile_disc(0.95) within group (order by elapsed_ms)").alias("p95_ms"),
    )


def relation_metrics(cases: DataFrame) -> DataFrame:
    """One row: precision, recall, type accuracy over ``expected, predicted, expected_type, predicted_type``."""
    e, p = F.col("expected"), F.col("predicted")
    return cases.agg(share(e, p).alias("precision"), share(p, e).alias("recall"), share(F.col("expected_type").eqNullSafe(F.col("predicted_type")), e & p).alias("type_accuracy"))


def run_metrics(results: DataFrame) -> DataFrame:
    """By feature: cases, passes, pass rate, mean, upper-middle median (sorted[n / 2]) and nearest-rank p95."""
    n = results.groupBy("feature").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passes"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_ms"))
    # sorted[n / 2]: the smallest value with more than n / 2 values at or below it, from counts of values.
    counts = results.groupBy("feature", "latency_ms").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("feature").orderBy("latency_ms"))
    half = F.floor(F.sum("c").over(Window.partitionBy("feature")) / 2)
    p50 = counts.withColumns({"u": upto, "h": half}).filter("u > h").groupBy("feature").agg(F.min("latency_ms").alias("p50_ms"))
    return n.join(p50, "feature").withColumn("pass_rate", F.round(F.col("passes") / F.col("cases"), 6))


def case_rollup(results: DataFrame) -> DataFrame:
    """Passes and cases by feature and category with subtotals."""
    return results.rollup("feature", "category").agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passes"))


def trace_timings(nodes: DataFrame, stages: list[str]) -> DataFrame:
    """One row per operation with the time of each of the fixed ``stages`` (null if absent) and the total."""
    wide = nodes.groupBy("operation_id").pivot("node", stages).agg(F.round(F.sum("elapsed_ms"), 4))
    total = F.round(sum((F.coalesce(F.col(s), F.lit(0.0)) for s in stages), F.lit(0.0)), 4)
    return wide.withColumn("total_ms", total)


def scorecard(components: DataFrame, gates: DataFrame, pass_mark: float = 85) -> DataFrame:
    """``run_id, total, failed_gates, passed``: components (``score, maximum``) clamped and added; every gate must hold."""
    t = components.groupBy("run_id").agg(F.round(F.sum(F.greatest(F.lit(0.0), F.least("score", "maximum"))), 6).alias("total"))
    g = gates.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("gate")))), ",").alias("failed_gates"))
    return t.join(g, "run_id", "left").withColumn("passed", (F.col("total") >= pass_mark) & (F.coalesce("failed_gates", F.lit("")) == ""))


def metric_means(scores: DataFrame) -> DataFrame:
    """Mean and number of finite values by metric, and distinct cases scored (``case_id, metric, value``)."""
    finite = scores.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    return finite.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("cases"))


def split_three(last_byte: Column) -> Column:
    """Tuning, development or hidden by an id's last byte modulo 10 (0-5, 6-7, 8-9)."""
    d = last_byte % 10
    return F.when(d < 6, "tuning").when(d < 8, "development").otherwise("hidden")


def baseline_check(cases: DataFrame) -> DataFrame:
    """``case_id, passed``: an expected file was returned and no forbidden one; cases that need OCR are left out."""
    hit = F.arrays_overlap("expected", "returned") & ~F.arrays_overlap("forbidden", "returned")
    return cases.filter(~F.coalesce("requires_ocr", F.lit(False))).select("case_id", F.coalesce(hit, F.lit(False)).alias("passed"))


def run_rates(results: DataFrame) -> DataFrame:
    """One row of the twelve rates of a run's results, each over its own base (0 where that is empty), with cases, passes and mean time."""
    c = F.col
    rate = lambda hit, base: F.round(F.when(F.count_if(base) > 0, F.count_if(hit & base) / F.count_if(base)).otherwise(0.0), 6)
    files = F.coalesce(F.arrays_overlap("expected_file_ids", "actual_file_ids"), F.lit(False))
    top = lambda k: F.coalesce(F.arrays_overlap("expected_file_ids", F.slice("top_files", 1, k)), F.lit(False))
    named = c("expected_file_ids").isNotNull()
    wants, all_ = F.coalesce("expected_evidence", F.lit(False)), F.lit(True)
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passes"), F.coalesce(F.round(F.avg("latency_ms"), 4), F.lit(0.0)).alias("mean_ms"),
        rate(c("actual_source").eqNullSafe(c("expected_source")), c("expected_source").isNotNull()).alias("source_accuracy"),
        rate(c("actual_intent").eqNullSafe(c("expected_intent")), c("expected_intent").isNotNull()).alias("intent_accuracy"),
        rate(top(1), named).alias("top1_accuracy"), rate(top(3), named).alias("top3_recall"),
        rate(files, c("memory_used")).alias("memory_hits"), rate(~files, c("memory_used")).alias("memory_wrong"),
        rate(c("clarified"), all_).alias("clarification_rate"), rate(files, c("clarified")).alias("clarification_success"),
        rate(c("evidence_found"), wants).alias("evidence_recall"), rate(~c("evidence_found"), wants).alias("false_no_evidence"),
        rate(c("grounded"), all_).alias("grounded_rate"), rate(c("supported_claims") == c("claims"), c("claims") > 0).alias("citation_pass_rate"),
    )


def feature_metrics(results: DataFrame) -> DataFrame:
    """By feature (``feature, top, recall, precision, passed, latency_ms, source_ok, found, grounded``): the first one, three and five places, MRR, sources, evidence,
    grounded answers, mean precision and recall, passes and nearest-rank p95; a rate without a base is 0."""
    share = lambda x: F.round(F.count_if(x) / F.count(F.lit(1)), 6)
    of = lambda x: F.round(F.when(F.count(x) > 0, F.count_if(x) / F.count(x)).otherwise(0.0), 6)
    return results.groupBy("feature").agg(
        F.count(F.lit(1)).alias("cases"), share("passed").alias("pass_rate"), *(share(F.col("top") <= k).alias(f"top{k}") for k in (1, 3, 5)), F.round(F.avg(F.coalesce(1 / F.col("top"), F.lit(0.0))), 6).alias("mrr"),
        of(F.col("source_ok")).alias("source_accuracy"), of(F.col("found")).alias("evidence_rate"), of(F.col("grounded")).alias("grounded_rate"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"),
        F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p95_ms"),
    )


def structured_rate(cases: DataFrame) -> DataFrame:
    """One row: share of structured answers among those generated; 1 without any."""
    return cases.agg(share(F.col("structured"), F.col("generated")).alias("structured_rate"))
