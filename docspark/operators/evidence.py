"""Claims and their evidence, citations, and the memory of confirmed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import HAN

#: Trust of a memory's source, highest wins; ranks below 3 can't be confirmed.
TRUST = {"user_explicit": 6, "user_confirmed": 5, "user_selection": 4, "repeated_usage": 3, "document_inference": 2, "model_inference": 1}


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def claim_tokens(text: Column) -> Column:
    """Distinct Han bigrams and Latin or digit runs of two characters or more."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"([{HAN}]{{2,}}|[a-z0-9]{{2,}})"), 1)
    pairs = lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: F.when(run.rlike(f"^[{HAN}]"), pairs(run)).otherwise(F.array(run)))))


def claim_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """``claim_id, supported``: the claim stands in the evidence, or its numbers and most of its tokens do.

    ``evidence`` has ``claim_id, ordinal, text``, a bounded number of quotes a claim. Supported: the folded claim of
    4 characters or more is contained; or every number is present, with 3 tokens or more and 72 % of them found.
    Without evidence a claim is not supported.
    """
    joined = evidence.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda s: s["text"]), "\n").alias("evidence"))
    c = claims.select("claim_id", F.col("text").alias("claim")).join(joined, "claim_id", "left")
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1)
    tokens = claim_tokens(F.col("claim"))
    found = F.size(F.array_intersect(tokens, claim_tokens(F.col("evidence"))))
    whole = (F.length(folded(F.col("claim"))) >= 4) & F.contains(folded(F.col("evidence")), folded(F.col("claim")))
    most = (F.size(F.array_except(numbers(F.col("claim")), numbers(F.col("evidence")))) == 0) & (F.size(tokens) >= 3) & (found >= F.size(tokens) * 0.72)
    return c.select("claim_id", F.coalesce(whole | most, F.lit(False)).alias("supported"))


def validate_citations(claims: DataFrame, evidence: DataFrame, authorised: DataFrame, per_claim: int = 6, chars: int = 1000) -> DataFrame:
    """Per claim: cited ids that don't exist, cited files outside the authorised set, and whether all is valid.

    ``claims``: ``answer_id, claim_id, text, cited`` (array of evidence ids); ``evidence``: ``answer_id, evidence_id,
    file_id``. A valid claim cites 1 to ``per_claim`` known, authorised rows in at most ``chars`` characters.
    """
    cited = claims.select("answer_id", "claim_id", F.explode("cited").alias("evidence_id")).distinct()
    allowed = authorised.select("file_id", F.lit(True).alias("ok")).distinct()
    known = cited.join(evidence.select("answer_id", "evidence_id", "file_id", F.lit(True).alias("known")).distinct(), ["answer_id", "evidence_id"], "left").join(allowed, "file_id", "left")
    bad = known.groupBy("answer_id", "claim_id").agg(F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("known") & F.col("ok").isNull()).alias("unauthorised"))
    out = claims.join(bad, ["answer_id", "claim_id"], "left").fillna(0, ["unknown", "unauthorised"])
    fine = F.size("cited").between(1, per_claim) & (F.length("text") <= chars) & (F.col("unknown") == 0) & (F.col("unauthorised") == 0)
    return out.select("answer_id", "claim_id", "unknown", "unauthorised", F.coalesce(fine, F.lit(False)).alias("valid"))


def dedup_proposals(proposals: DataFrame) -> DataFrame:
    """One candidate per normalised key: the highest confidence, clamped to [0, 1], then the smallest id; incomplete ones go."""
    key = folded(F.col("alias"))
    p = proposals.filter("alias is not null and target_id is not null").withColumns({"key": key, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))), "status": F.lit("candidate")}).filter("key != ''")
    best = Window.partitionBy("key", "target_id").orderBy(F.desc("confidence"), "proposal_id")
    return p.withColumn("r", F.row_number().over(best)).filter("r = 1").select("proposal_id", "key", "target_id", "confidence", "status")


def merge_memory(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per ``key``: the row of the highest trust (the newer on ties), hit counts added.

    Rows have ``key, target_id, status, source_type, hit_count, updated_at``. A source of rank below 3 is at most candidate.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])[F.col("source_type")], F.lit(0))
    both = current.unionByName(incoming).withColumn("rank", rank)
    top = both.groupBy("key").agg(F.max(F.struct("rank", "updated_at", "target_id", "status", "source_type")).alias("m"), F.sum("hit_count").alias("hit_count"))
    status = F.when((F.col("m.rank") < 3) & (F.col("m.status") == "confirmed"), "candidate").otherwise(F.col("m.status"))
    return top.select("key", "m.target_id", status.alias("status"), "m.source_type", "hit_count", "m.updated_at")


def stale_memory(memory: DataFrame, files: DataFrame, collections: DataFrame) -> DataFrame:
    """Memory rows with ``status`` set to stale where the target file is not present or the collection is gone."""
    there = files.filter("availability = 'present'").select(F.lit("file").alias("target_type"), F.col("file_id").alias("target_id")).union(collections.select(F.lit("collection"), "collection_id")).distinct()
    m = memory.join(there.withColumn("there", F.lit(True)), ["target_type", "target_id"], "left")
    gone = (F.col("target_type") != "entity") & F.col("there").isNull()
    return m.withColumn("status", F.when(gone, "stale").otherwise(F.col("status"))).drop("there")


def merge_sub_answers(claims: DataFrame) -> DataFrame:
    """Claims of the rewritten queries of one question, duplicates on (text, file) dropped, in the order of query and rank.

    ``question_id, query_no, rank, text, file_id``; the first of equal claims stays.
    """
    first = claims.groupBy("question_id", "text", "file_id").agg(F.min(F.struct("query_no", "rank")).alias("f"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("f.query_no", "f.rank", "text", "file_id"))
    return first.select("question_id", place.alias("place"), "text", "file_id")


def answer_citations(claims: DataFrame, evidence: DataFrame, authorised: DataFrame, most: int = 12) -> DataFrame:
    """Per answer: ``claims``, ``invalid`` ones as in ``validate_citations``, and whether the answer is valid: at most ``most`` claims, all of them valid."""
    each = validate_citations(claims, evidence, authorised)
    return each.groupBy("answer_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("valid", (F.col("claims") <= most) & (F.col("invalid") == 0))


def stale_by_roots(memory: DataFrame, files: DataFrame, roots: DataFrame, collections: DataFrame) -> DataFrame:
    """``stale_memory`` where a file must also lie in an authorised root (``root_id``)."""
    return stale_memory(memory, files.join(roots.select("root_id").distinct(), "root_id", "left_semi"), collections)
