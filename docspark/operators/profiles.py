"""Document profiles: which type they have and whether they are up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.vectors import cosine, vector_topk


def classify_types(rule: DataFrame, prototype: DataFrame, over: float = 0.72, lock: float = 0.5, alone: float = 0.65) -> DataFrame:
    """``file_id, document_type, confidence`` from the scores by rule and by prototype (``file_id, type, score``).

    Both agree: .6 + .4 * the larger score. Else a prototype of ``over`` wins, then a rule of ``lock``; without a
    rule a prototype of ``alone`` is enough. Otherwise the type is null.
    """
    r = rule.select("file_id", F.col("type").alias("rt"), F.col("score").alias("rs"))
    j = r.join(prototype.select("file_id", F.col("type").alias("pt"), F.col("score").alias("ps")), "file_id", "full_outer")
    same, by_pt, by_rt = F.col("rt") == F.col("pt"), F.col("ps") >= F.when(F.col("rt").isNull(), alone).otherwise(over), F.col("rs") >= lock
    kind = F.when(same, F.col("rt")).when(by_pt, F.col("pt")).when(by_rt, F.col("rt"))
    confidence = F.when(same, 0.6 + 0.4 * F.greatest("rs", "ps")).when(by_pt, F.col("ps")).when(by_rt, F.col("rs"))
    return j.select("file_id", kind.alias("document_type"), F.round(confidence, 6).alias("confidence"))


def stale_profiles(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, stale``: no profile, or another revision or text hash than the file's."""
    p = profiles.select("file_id", F.col("revision_id").alias("r"), F.col("text_hash").alias("h"), F.lit(True).alias("has"))
    fresh = F.col("has") & F.col("r").eqNullSafe(F.col("revision_id")) & F.col("h").eqNullSafe(F.col("text_hash"))
    return files.join(p, "file_id", "left").select("file_id", (~F.coalesce(fresh, F.lit(False))).alias("stale"))


def type_prototype_scores(vectors: DataFrame, prototypes: DataFrame, least: float = 0.55, most_types: int = 1000) -> DataFrame:
    """``file_id, type, score``: the type whose prototype (``type, vector``) is nearest, if the cosine reaches ``least``.

    Types are a short list by design: more than ``most_types`` is an error, so what goes to every task is bounded.
    """
    known = prototypes.select("type", F.col("vector").cast("array<double>").alias("vector")).limit(most_types + 1).orderBy("type").collect()
    if len(known) > most_types:
        raise ValueError(f"more than {most_types} types")
    v = F.col("vector").cast("array<double>")
    scores = F.array(*[F.struct(F.round(cosine(v, F.array(*map(F.lit, p.vector))), 4).alias("score"), F.lit(-i).alias("at"), F.lit(p.type).alias("type")) for i, p in enumerate(known)])
    if not known:
        return vectors.select("file_id", F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("score")).limit(0)
    best = vectors.select("file_id", F.array_max(scores).alias("best"))
    return best.select("file_id", "best.type", "best.score").filter(F.col("score") >= least)


def semantic_recall(questions: DataFrame, vectors: DataFrame, least: float = 0.24, k: int = 40) -> DataFrame:
    """The ``k`` nearest vectors of each question with a cosine of ``least`` or more."""
    return vector_topk(questions, vectors, k).filter(F.col("score") >= (1 + least) / 2)


def profile_counts(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files ``profiled`` (a fresh profile), ``stale`` (to be built again) and profiles ``skipped`` whose file is gone."""
    judged = stale_profiles(profiles, files).agg(F.count_if(~F.col("stale")).alias("profiled"), F.count_if("stale").alias("stale"))
    return judged.crossJoin(profiles.join(files, "file_id", "left_anti").agg(F.count(F.lit(1)).alias("skipped")))  # one row each
