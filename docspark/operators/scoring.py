"""Scores of components, verdicts on cases, classes of errors, and cases made from a library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.recall import stem
from docspark.storage import cut

#: The class of an error by the node that failed, and by parts of an error code, in order.
BY_NODE = {
    "source_routing": "router_error", "query_parsing": "query_parse_error", "context_resolution": "context_error", "memory_resolution": "memory_error",
    "document_resolution": "document_resolution_error", "document_recall": "document_recall_error", "retrieval": "chunk_retrieval_error", "reranking": "rerank_error",
    "generation": "generation_error", "verification": "citation_error", "repair": "citation_error", "clarification_selection": "clarification_error",
}
BY_CODE = {
    "CLARIFICATION": "clarification_error", "GENERATION": "generation_error", "RERANK": "rerank_error", "EMBEDDING": "chunk_retrieval_error", "ROUT": "router_error",
    "PARSE": "query_parse_error", "RESOLV": "document_resolution_error", "RESOLUTION": "document_resolution_error", "MEMORY": "memory_error",
}
#: Parts of keys that a log must not have.
SENSITIVE = ("path", "text", "content", "body", "quote", "query", "prompt", "question", "answer", "snippet")


def _late(ms: Column, full: int, floor: float) -> Column:
    """1 up to ``full`` milliseconds, then their share of the time, at least ``floor``."""
    return F.when(ms <= full, 1.0).otherwise(F.greatest(F.lit(floor), F.lit(float(full)) / ms))


def component_scores(runs: DataFrame) -> DataFrame:
    """``run_id, component, earned, maximum, failures`` of runs with their metrics in columns.

    Search: 20 points by recall, MRR and nDCG (.4, .3, .3) and latency. RAG: 30 by coverage, correctness, refusals, rejection of
    unauthorised sources, structured output and latency. Relations: 10 by precision, recall and type accuracy. Index: 20 by
    parse, embedding and vector coverage (.5, .3, .2). Recovery and logging: 4 of 10 if no log line breaks privacy
    (``log_violations``), 2 if jobs can end or recover (``jobs_ok``), 2 if index keys are consistent (``index_keys_ok``), 1 if all files are in authorised
    roots (``authorized_ok``); the tenth stands for the latency of cancelling, which isn't measured.
    """
    c = F.col
    missed = lambda pairs: F.array_join(F.array_compact(F.array(*[F.when(x, name) for x, name in pairs])), ",")
    search = 20.0 * (0.4 * c("recall") + 0.3 * c("mrr") + 0.3 * c("ndcg")) * _late(c("search_p95_ms"), 2000, 0.5)
    rag = 30.0 * (0.25 * c("citation_coverage") + 0.25 * c("correctness") + 0.15 * c("refusal_accuracy") + 0.15 * c("unauthorized_rejection") + 0.1 * c("structured_rate") + 0.1 * _late(c("answer_p95_ms"), 30000, 0.25))
    rag_missed = missed([(c("citation_coverage") < 1, "citation_coverage_below_hard_gate"), (c("unauthorized_rejection") < 1, "unauthorized_citation_rejection_below_hard_gate"), (c("refusal_accuracy") < 1, "refusal_accuracy_below_hard_gate"), (c("correctness") < 0.85, "factual_correctness_below_target")])
    relations = 10.0 * (0.45 * c("relation_precision") + 0.4 * c("relation_recall") + 0.15 * c("type_accuracy"))
    relations_missed = missed([(c("relation_precision") < 0.85, "semantic_relation_precision_below_target"), (c("relation_recall") < 0.80, "semantic_relation_recall_below_target")])
    index = 20.0 * (0.5 * c("parse_coverage") + 0.3 * c("embedding_coverage") + 0.2 * c("vector_coverage"))
    logs_ok = c("log_violations") == 0
    runtime = 4.0 * logs_ok.cast("int") + 2.0 * c("jobs_ok").cast("int") + 2.0 * c("index_keys_ok").cast("int") + 1.0 * c("authorized_ok").cast("int")
    runtime_missed = missed([(~c("jobs_ok"), "nonrecoverable_background_jobs"), (~c("index_keys_ok"), "index_key_mapping_inconsistent"), (~c("authorized_ok"), "files_outside_authorized_roots"), (~logs_ok, "runtime_log_privacy_violation"), (F.lit(True), "runtime_cancel_latency_not_measured")])
    rows = [("search_quality", search, 20.0, F.lit("")), ("strict_rag", rag, 30.0, rag_missed), ("relations_and_collections", relations, 10.0, relations_missed), ("index_coverage", index, 20.0, F.lit("")), ("runtime_recovery_logging", runtime, 10.0, runtime_missed)]
    each = F.array(*[F.struct(F.lit(n).alias("component"), F.round(e, 6).alias("earned"), F.lit(m).alias("maximum"), f.alias("failures")) for n, e, m, f in rows])
    return runs.select("run_id", F.explode(each).alias("s")).select("run_id", "s.*")


def case_verdicts(results: DataFrame) -> DataFrame:
    """``case_id, passed, failed_fields``: only what a case expects (not null) is held against what was seen."""
    wrong = lambda e, a, name: F.when(F.col(e).isNotNull() & ~F.col(a).eqNullSafe(F.col(e)), name)
    expected, found = F.col("expected_evidence"), F.coalesce("evidence_found", F.lit(False))
    overlap = F.coalesce(F.arrays_overlap("expected_file_ids", "actual_file_ids"), F.lit(False))
    failed = F.array_compact(F.array(
        wrong("expected_source", "actual_source", "source_correct"), wrong("expected_intent", "actual_intent", "intent_correct"), wrong("expected_type", "actual_type", "target_correct"),
        F.when(F.col("expected_file_ids").isNotNull() & ~overlap, "file_correct"), F.when(expected.isNotNull() & (expected != found), "evidence_found"), F.when(expected & ~F.coalesce("answer_grounded", F.lit(False)), "answer_grounded"),
    ))
    return results.select("case_id", (F.size(failed) == 0).alias("passed"), F.array_join(failed, ",").alias("failed_fields"))


def error_class(failed_nodes: Column, code: Column, refused: Column, expected_evidence: Column, unsupported: Column) -> Column:
    """A failed node tells first, then the error code, then a refusal (unless none was expected to be found), then unsupported claims."""
    by_node = F.create_map(*[F.lit(x) for kv in BY_NODE.items() for x in kv])
    node = F.get(F.filter(F.transform(failed_nodes, lambda n: F.try_element_at(by_node, n)), lambda k: k.isNotNull()), F.lit(0))
    upper = F.upper(code)
    by_code = F.lit("unknown")
    for part, kind in reversed(BY_CODE.items()):
        by_code = F.when(F.contains(upper, F.lit(part)), kind).otherwise(by_code)
    rest = F.when(refused, F.when(~expected_evidence.eqNullSafe(F.lit(False)), "no_evidence_error")).when(unsupported, "citation_error")
    return F.coalesce(node, F.when(code.isNotNull(), by_code), rest)


def classify_errors(results: DataFrame) -> DataFrame:
    """``case_id, error``: ``error_class`` of results with ``failed_nodes, error_code, answer_mode, insufficient, expected_evidence, unsupported``."""
    refused = F.col("answer_mode").eqNullSafe(F.lit("rag_refusal")) | F.coalesce("insufficient", F.lit(False))
    return results.select("case_id", error_class(F.col("failed_nodes"), F.col("error_code"), refused, F.col("expected_evidence"), F.coalesce("unsupported", F.lit(False))).alias("error"))


def judge_cases(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """``case_id, feature, passed, top, recall, precision``: cases (``expected`` files) against what was returned for them.

    Search passes with an expected file in the first five; questions if they are grounded and cite one; collections and
    relations by the share of expected files found (all of them; relations also want the type). ``top`` is the place of the
    first expected file, null if none; a case without an observation fails.
    """
    j = cases.join(observations, "case_id", "left").withColumn("returned", F.coalesce("returned", F.array().cast("array<long>")))
    first = F.array_min(F.filter(F.transform("expected", lambda e: F.array_position("returned", e)), lambda p: p > 0))
    both = F.size(F.array_intersect("expected", "returned"))
    share = lambda n: F.when(n > 0, F.round(both / n, 6)).otherwise(0.0)
    j = j.withColumns({"top": first, "recall": share(F.size("expected")), "precision": share(F.size("returned"))})
    typed = F.col("expected_type").eqNullSafe(F.col("returned_type"))
    ok = F.when(F.col("feature") == "SEARCH", F.col("top") <= 5).when(F.col("feature") == "ASK", F.col("grounded") & (both > 0)).when(F.col("feature") == "FILE_RELATION", (F.col("recall") == 1) & typed).otherwise(F.col("recall") == 1)
    return j.select("case_id", "feature", F.coalesce(ok, F.lit(False)).alias("passed"), "top", "recall", "precision")


def search_cases(files: DataFrame) -> DataFrame:
    """``case_id, file_id, query, reason``: up to seven searches that should find a file (``display_name, title, keywords, entities, text``).

    By its whole name, its first word, its title without punctuation, a line of 8 to 120 characters, an entity, its name and
    extension, its name with the second and third characters swapped, and a keyword of three characters that is no number.
    Names of under two characters give none.
    """
    name = F.col("stem")
    f = files.withColumn("stem", stem(F.col("display_name"))).filter("length(stem) >= 2")
    word = F.regexp_extract(name, r"^[\s\-_.]*([^\s\-_.]+)", 1)
    title = F.regexp_replace(F.trim("title"), r"[!-/:-@\[-`{-~]", "")
    lines = F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    line = F.get(F.filter(lines, lambda x: F.length(x).between(8, 120)), F.lit(0))
    entity = F.get(F.filter("entities", lambda x: F.length(x) >= 2), F.lit(0))
    extension = F.regexp_extract("display_name", r"\.([^.]+)$", 1)
    swapped = F.when((F.length(name) >= 4) & (F.substring(name, 2, 1) != F.substring(name, 3, 1)), F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substring(name, F.lit(4), F.length(name))))
    keyword = F.get(F.filter("keywords", lambda x: (F.length(x) >= 3) & ~x.rlike("^[0-9]+$")), F.lit(0))
    made = {"full": name, "partial": F.when(word != "", word), "title": F.when(F.length(title) >= 2, title), "content": line, "entity": entity, "type": F.when(extension != "", F.concat_ws(" ", name, extension)), "typo": swapped, "natural": keyword}
    each = F.array(*[F.struct(F.lit(k).alias("reason"), v.alias("query")) for k, v in made.items()])
    out = f.select("file_id", F.explode(each).alias("c")).filter("c.query is not null")
    return out.select(F.concat_ws("-", F.lit("search"), "c.reason", "file_id").alias("case_id"), "file_id", "c.query", "c.reason")


def relation_cases(files: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """``case_id, left_id, right_id, expected``: neighbours by id with the same content (``exact_duplicate``) or with different contents (null).

    Neighbours of all files meet within ranges of ``bucket`` ids; the first file of a range also meets the last of the range
    before it, so no window holds all files.
    """
    f = files.filter("content_sha256 is not null").select("file_id", "content_sha256").withColumn("range", F.floor(F.col("file_id") / bucket))
    pair = lambda w: [F.lead("file_id").over(w).alias("right_id"), F.lead("content_sha256").over(w).alias("right_hash")]
    same = f.select(F.col("file_id").alias("left_id"), F.lead("file_id").over(Window.partitionBy("content_sha256").orderBy("file_id")).alias("right_id")).filter("right_id is not null")
    near = f.select(F.col("file_id").alias("left_id"), F.col("content_sha256").alias("left_hash"), *pair(Window.partitionBy("range").orderBy("file_id")))
    ends = f.groupBy("range").agg(F.min(F.struct("file_id", "content_sha256")).alias("first"), F.max(F.struct("file_id", "content_sha256")).alias("last"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("range")  # a row for each range of ids
    joints = ends.select(F.col("last.file_id").alias("left_id"), F.col("last.content_sha256").alias("left_hash"), F.lead("first.file_id").over(by_range).alias("right_id"), F.lead("first.content_sha256").over(by_range).alias("right_hash"))
    other = near.union(joints).filter("right_id is not null and left_hash != right_hash").select("left_id", "right_id")
    out = same.withColumn("expected", F.lit("exact_duplicate")).union(other.withColumn("expected", F.lit(None).cast("string")))
    return out.select(F.concat_ws("-", F.when(F.col("expected").isNull(), "relation-neg").otherwise("relation-dup"), "left_id", "right_id").alias("case_id"), "left_id", "right_id", "expected")


def no_evidence_cases(files: DataFrame, postings: DataFrame, n: int = 6) -> DataFrame:
    """``case_id, token``: ``n`` words made from a digest of all file ids, of which none is a term of the ``postings``."""
    seed = files.agg(F.sum(F.xxhash64("file_id").cast("decimal(38,0)")).cast("string").alias("seed"))  # one row
    made = seed.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "seed")
    made = made.select(F.concat(F.lit("ask-no-evidence-"), "i").alias("case_id"), F.concat(F.lit("noevidence"), F.substring(F.sha2(F.concat_ws("#", "seed", "i"), 256), 1, 12)).alias("token"))
    return made.join(postings.select(F.col("term").alias("token")), "token", "left_anti").select("case_id", "token")


def manifest_digest(cases: DataFrame) -> DataFrame:
    """``batch_id, cases, digest``: sha-256 over the batch's cases (``case_id, intent``) in the order of their ids, each as JSON."""
    rows = cases.select("batch_id", "case_id", F.to_json(F.struct("case_id", "intent")).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_id", "row"))), lambda x: x["row"]), "\n")  # a batch has a fixed size
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("cases"), F.sha2(text, 256).alias("digest"))


def validate_manifests(manifests: DataFrame, cases: DataFrame, size: int) -> DataFrame:
    """``batch_id, problem`` of manifests (``batch_id, digest``) that don't fit their cases: size, repeated cases, digest, or an id that doesn't end in the digest's first eight digits."""
    seen = manifest_digest(cases).withColumnRenamed("digest", "found").join(cases.groupBy("batch_id").agg(F.count_distinct("case_id").alias("distinct")), "batch_id")
    j = manifests.join(seen, "batch_id", "left")
    problem = F.when(F.coalesce("cases", F.lit(0)) != size, "size").when(F.col("distinct") < F.col("cases"), "repeated").when(F.col("digest") != F.col("found"), "digest").when(~F.endswith(F.col("batch_id"), F.substring("digest", 1, 8)), "id")
    return j.select("batch_id", problem.alias("problem")).filter("problem is not null")


def freeze_batches(cases: DataFrame, size: int, batches: int, version: str = "v1") -> DataFrame:
    """``case_id, file_id, intent, batch``: positive cases dealt to ``batches`` of ``size``, none of whose files is in two batches.

    Files are dealt whole, by a digest of version and file, and within its batch each intent has one case and a share of the rest
    in proportion to the batch's cases; shares are rounded by largest remainder, and cases go by digest. A batch that can't be
    filled is short; ``validate_manifests`` names it.
    """
    digest = lambda *c: F.sha2(F.concat_ws("\x1f", F.lit(version), *c), 256)
    dealt = cases.withColumn("batch", F.pmod(F.conv(F.substring(digest("file_id"), 1, 8), 16, 10).cast("long"), F.lit(batches)).cast("int"))
    counts = dealt.groupBy("batch", "intent").agg(F.count(F.lit(1)).alias("n"))
    of_batch = Window.partitionBy("batch")
    kinds, all_ = F.count(F.lit(1)).over(of_batch), F.sum("n").over(of_batch)
    share = F.greatest(F.lit(0), F.lit(size) - kinds) * F.col("n") / all_
    quota = counts.withColumns({"whole": F.floor(share) + 1, "part": share - F.floor(share)})
    left = F.lit(size) - F.sum("whole").over(of_batch)
    quota = quota.withColumn("left", left).withColumn("turn", F.row_number().over(of_batch.orderBy(F.desc("part"), "intent")))
    quota = quota.select("batch", "intent", (F.col("whole") + (F.col("turn") <= F.col("left")).cast("int")).alias("quota"))
    turn = F.row_number().over(Window.partitionBy("batch", "intent").orderBy(digest("intent", "case_id"), "case_id"))
    return dealt.withColumn("turn", turn).join(F.broadcast(quota), ["batch", "intent"]).filter("turn <= quota").select("case_id", "file_id", "intent", "batch")  # quota: a row a batch and intent


def _quotas(counts: pd.DataFrame, size: int) -> pd.DataFrame:
    """Cases that each intent gives to one batch: one, and a share of the rest in proportion, whole numbers by largest remainder.

    No intent gives more than it has; what that leaves goes round the intents in the same order until the batch is full.
    """
    c = counts.sort_values("intent")
    n = c["n"].to_numpy()
    share = max(0, size - len(n)) * n
    quota, rest = np.minimum(n, 1 + share // n.sum()), share % n.sum()
    order = np.lexsort((np.arange(len(n)), rest))[::-1]
    while quota.sum() < min(size, n.sum()):
        for i in order:
            if quota[i] < n[i] and quota.sum() < size:
                quota[i] += 1
    return c.assign(quota=quota)[["batch", "intent", "quota"]]


def freeze_splits(cases: DataFrame, size: int, dev_batches: int, version: str = "v1") -> DataFrame:
    """``case_id, file_id, intent, split, batch, batch_id``: ``dev_batches`` batches of ``DEV`` cases and one of ``HOLDOUT``, ``size`` cases each.

    ``cases`` (``case_id, file_id, intent, split``). No file is in two batches: files are dealt to the batches by a digest of version and
    file, the last batch being the holdout's. A null intent is ``unknown``. Within a batch intents have the quotas of
    ``_quotas``, and cases go by digest. A batch that can't be filled, or has more intents than cases, is an error. ``batch_id`` ends in
    the first twelve digits of the digest of the batch's cases.
    """
    if not version.strip() or size < 1 or dev_batches < 1:
        raise ValueError("a version, a size and a number of batches are asked for")
    digest = lambda *c: F.sha2(F.concat_ws("\x1f", F.lit(version), *c), 256)
    batch = F.pmod(F.conv(F.substring(digest("file_id"), 1, 8), 16, 10).cast("long"), F.lit(dev_batches + 1)).cast("int")
    c = cases.select("case_id", "file_id", F.coalesce("intent", F.lit("unknown")).alias("intent"), "split").withColumn("batch", batch)
    c = cut(c.filter(F.col("split") == F.when(F.col("batch") < dev_batches, "DEV").otherwise("HOLDOUT")))
    quota = c.groupBy("batch", "intent").agg(F.count(F.lit(1)).alias("n")).groupBy("batch").applyInPandas(lambda pdf: _quotas(pdf, size), "batch int, intent string, quota long")  # a row a batch and intent
    turn = F.row_number().over(Window.partitionBy("batch", "intent").orderBy(digest("split", "intent", "case_id"), "case_id"))
    chosen = cut(c.withColumn("turn", turn).join(quota, ["batch", "intent"]).filter("turn <= quota").drop("turn", "quota"))
    seen = {r["batch"]: (r["n"], r["intents"]) for r in chosen.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("intent").alias("intents")).collect()}  # a row a batch
    for b in range(dev_batches + 1):
        n, intents = seen.get(b, (0, 0))
        if n != size or intents > size:
            raise ValueError(f"{'DEV' if b < dev_batches else 'HOLDOUT'} batch {b % dev_batches} has {n} cases of {size}")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("case_id").cast("string"))), lambda x: x), "\n")  # size rows
    named = chosen.groupBy("batch", "split").agg(digest("split", F.col("batch").cast("string"), ids).alias("d"))
    place = F.when(F.col("split") == "DEV", F.col("batch")).otherwise(0)
    named = named.select("batch", F.concat_ws("-", F.lit(version), F.lower("split"), F.lpad(place.cast("string"), 2, "0"), F.substring("d", 1, 12)).alias("batch_id"))
    return chosen.join(F.broadcast(named), "batch").select("case_id", "file_id", "intent", "split", "batch", "batch_id")  # a row a batch


def ragas_samples(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """``case_id, user_input, response, contexts, reference`` of the questions (feature ``ASK``) that were observed."""
    c = cases.filter("feature = 'ASK'").select("case_id", F.col("question").alias("user_input"), F.col("gold").alias("reference"))
    o = observations.select("case_id", F.coalesce("answer", F.lit("")).alias("response"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"))
    return c.join(o, "case_id").select("case_id", "user_input", "response", "contexts", "reference")


def log_privacy(log: DataFrame) -> DataFrame:
    """``files, events, violations`` over log lines (``file, line``): unparsable ones, and JSON with a key that has a sensitive
    part at any depth, or a string with a drive's path in it or a network path at its beginning. Blank lines don't count."""
    lines = log.filter(F.trim("line") != "")
    # In JSON text a key is a string before a colon, at whatever depth; a backslash there is written twice.
    key = rf'(?i)"[^"\\]*(?:\\.[^"\\]*)*?(?:{"|".join(SENSITIVE)})[^"\\]*(?:\\.[^"\\]*)*"\s*:'
    value = r'"[^"\\]*(?:\\.[^"\\]*)*?[A-Za-z]:(?:\\\\|\\?/)[^"\\]*(?:\\.[^"\\]*)*"\s*(?:[,}\]]|$)|"\\\\\\\\[^"\\]*(?:\\.[^"\\]*)*"\s*(?:[,}\]]|$)'
    # As the only item of an array, so that whatever follows a value makes the line unparsable.
    alone = F.concat(F.lit("["), "line", F.lit("]"))
    bad = F.try_parse_json(alone).isNull() | (F.coalesce(F.json_array_length(alone), F.lit(0)) != 1) | F.col("line").rlike(key) | F.col("line").rlike(value)
    return lines.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("events"), F.count_if(bad).alias("violations"))
