"""Parse results, image assets, roots, the inbox, and counts for the home and activity pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import path_key
from docspark.operators.catalog import ancestors

#: The inbox filter ``error`` stands for these resolutions.
ERROR_RESOLUTIONS = ("pending_retry", "retrying")
FINISHED = ("ready", "failed", "skipped")


def parse_status_rollup(results: DataFrame) -> DataFrame:
    """Files, characters and nodes by ``outcome`` and ``format``."""
    return results.groupBy("outcome", "format").agg(F.count(F.lit(1)).alias("files"), F.sum("characters").alias("characters"), F.sum("nodes").alias("nodes"))


def warning_counts(results: DataFrame) -> DataFrame:
    """How many files carry each code of the array ``warnings``."""
    return results.select(F.explode(F.array_distinct("warnings")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("files"))


def asset_nodes(assets: DataFrame) -> DataFrame:
    """Nodes of the understood images: text, description and keywords, a line each; images without any give none."""
    parts = F.filter(F.array("text", "description", F.array_join("keywords", " ")), lambda x: x.isNotNull() & (F.trim(x) != ""))
    nodes = assets.filter("status = 'ready'").select("file_id", F.concat(F.lit("asset-"), F.col("asset_id").cast("string")).alias("node_id"), F.lit("image").alias("node_type"), F.array_join(parts, "\n").alias("text"))
    return nodes.filter("text != ''")


def promote_ready_files(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Files that wait and whose assets are all finished become parsed; waiting files without assets stay."""
    done = assets.groupBy("file_id").agg(F.bool_and(F.col("status").isin(*FINISHED)).alias("done"))
    status = F.when((F.col("parse_status") == "waiting") & F.coalesce("done", F.lit(False)), "parsed").otherwise(F.col("parse_status"))
    return files.join(done, "file_id", "left").withColumn("parse_status", status).drop("done")


def uncovered_candidates(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates (``path``) neither equal to, inside, nor above a root (``path``)."""
    c = candidates.withColumn("key", path_key(F.col("path")))
    r = roots.select(path_key(F.col("path")).alias("root")).distinct()
    inside = c.select("key", F.explode(ancestors(F.col("key"))).alias("root")).join(r, "root").select("key")
    above = r.select(F.explode(ancestors(F.col("root"))).alias("key"))
    return c.join(inside.union(above).distinct(), "key", "left_anti")


def home_summary(files: DataFrame, local_date: str, tz: str, newest: int = 10) -> DataFrame:
    """The ``newest`` files, each beside the number of files first seen on that local day."""
    local = F.to_date(F.from_utc_timestamp(F.col("first_seen_at").cast("timestamp"), tz))
    day = files.agg(F.count_if(local == F.lit(local_date).cast("date")).alias("seen_that_day"))
    top = files.select("file_id", "first_seen_at").orderBy(F.desc("first_seen_at"), "file_id").limit(newest)
    return top.crossJoin(F.broadcast(day))  # one row


def scope_index_coverage(chunks: DataFrame, vectors: DataFrame, scope: DataFrame) -> DataFrame:
    """One row: share of the scope's chunks with a vector, and of its files with at least one; 0 without any."""
    inside = chunks.select("chunk_id", "file_id").join(scope.select("file_id").distinct(), "file_id", "left_semi")
    c = inside.join(vectors.select("chunk_id", F.lit(1).alias("has")).distinct(), "chunk_id", "left")
    per_file = c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("e"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.count(F.lit(1)).alias("files"), ratio(F.sum("e"), F.sum("n")).alias("chunk_ratio"), ratio(F.count_if(F.col("e") > 0), F.count(F.lit(1))).alias("file_ratio"))


def query_inbox(inbox: DataFrame, status: str = "all", event_types=(), roots=(), since=None, until=None, before=None, page_size: int = 50, limited: bool = True) -> DataFrame:
    """A page of inbox rows, newest id first; ``before`` is the last id seen."""
    if status == "error":
        inbox = inbox.filter(F.col("resolution").isin(*ERROR_RESOLUTIONS))
    elif status != "all":
        inbox = inbox.filter(F.col("resolution") == status)
    for column, values in (("event_type", event_types), ("root_id", roots)):
        if values:
            inbox = inbox.filter(F.col(column).isin(list(values)))
    if since:
        inbox = inbox.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if until:
        inbox = inbox.filter(F.col("created_at") < F.lit(until).cast("timestamp"))
    if before is not None:
        inbox = inbox.filter(F.col("item_id") < before)
    return inbox.orderBy(F.desc("item_id")).limit(max(1, min(200, page_size))) if limited else inbox


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """Attempts, elapsed time and retryable ones by operation and status."""
    return attempts.groupBy("operation", "status").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.sum("elapsed_ms"), 2).alias("elapsed_ms"), F.count_if("retryable").alias("retryable"))


def activity_stats(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: files discovered, parsed, with chunks (searchable), and with a vector."""
    marked = chunks.select("chunk_id", "file_id").join(vectors.select("chunk_id", F.lit(1).alias("has")).distinct(), "chunk_id", "left").groupBy("file_id").agg(F.count("has").alias("e"))
    f = files.select("file_id", "parse_status").join(marked, "file_id", "left")
    return f.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("parse_status") == "parsed").alias("parsed"), F.count("e").alias("searchable"), F.count_if(F.col("e") > 0).alias("embedded"))


def apply_events(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """The catalogue (``root_id, path, availability, last_ts``) after file events; applying them twice changes nothing.

    The latest event of a path decides: removed gives ``missing``, others ``present``. Paths not yet known are added;
    an event no later than the row's ``last_ts`` is ignored.
    """
    last = events.groupBy("root_id", "path").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    m = catalog.join(last, ["root_id", "path"], "full_outer")
    fresh = F.col("e").isNotNull() & (F.col("last_ts").isNull() | (F.col("e.ts") > F.col("last_ts")))
    state = F.when(F.col("e.event_type") == "removed", "missing").otherwise("present")
    return m.select("root_id", "path", F.when(fresh, state).otherwise(F.col("availability")).alias("availability"), F.when(fresh, F.col("e.ts")).otherwise(F.col("last_ts")).alias("last_ts"))


#: The allowed changes of a job's status; staying is allowed too.
JOB_STEPS = {
    "queued": ["running", "cancelled"],
    "running": ["paused", "awaiting_user", "succeeded", "partial", "failed", "cancelled"],
    "paused": ["running", "failed", "cancelled"],
    "awaiting_user": ["running", "failed", "cancelled"],
}


def job_transition_violations(history: DataFrame, steps: dict[str, list[str]] = JOB_STEPS) -> DataFrame:
    """``job_id, seq, problem`` of a history (``job_id, seq, status, progress, processed, total``): a change of status
    that is not allowed, progress outside [0, 1], or more processed than there is."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("seq"))
    allowed = F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    h = history.withColumn("before", before)
    step = F.col("before").isNotNull() & (F.col("before") != F.col("status")) & ~F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("before")), F.col("status")), F.lit(False))
    problems = F.array_compact(F.array(F.when(step, "transition"), F.when(~F.col("progress").between(0, 1), "progress"), F.when(F.col("processed") > F.col("total"), "counts")))
    return h.select("job_id", "seq", F.explode(problems).alias("problem"))


def inbox_page(inbox: DataFrame, page_size: int = 50, before=None, **filters) -> DataFrame:
    """``query_inbox`` with the ``total`` that the filters find on all pages."""
    total = query_inbox(inbox, page_size=page_size, limited=False, **filters).agg(F.count(F.lit(1)).alias("total"))
    return query_inbox(inbox, page_size=page_size, before=before, **filters).crossJoin(F.broadcast(total))  # total: one row


def parse_sums(results: DataFrame) -> DataFrame:
    """``parse_status_rollup`` with sums of pages and of pages read by OCR (null counts as 0)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return results.groupBy("outcome", "format").agg(F.count(F.lit(1)).alias("files"), total("pages"), total("nodes"), total("characters"), total("ocr_pages"))


def engine_stats(attempts: DataFrame, assets: DataFrame) -> DataFrame:
    """``kind, operation, engine, status, n, elapsed_ms, retryable``: attempts by operation, engine and status, and assets by status."""
    a = attempts.groupBy(F.lit("attempt").alias("kind"), "operation", "engine", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("elapsed_ms"), 2).alias("elapsed_ms"), F.count_if("retryable").alias("retryable"))
    none = F.lit(None).cast("string")
    s = assets.groupBy(F.lit("asset").alias("kind"), none.alias("operation"), none.alias("engine"), "status").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("elapsed_ms"), F.lit(None).cast("long").alias("retryable"))
    return a.unionByName(s)


def activity_with_ocr(files: DataFrame, chunks: DataFrame, vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """``activity_stats`` with the pages that OCR has read (``file_id, page, engine``; a page counts once)."""
    ocr = pages.filter("engine is not null").select("file_id", "page").distinct().agg(F.count(F.lit(1)).alias("ocr_pages"))
    return activity_stats(files, chunks, vectors).crossJoin(ocr)  # one row each


def apply_renames(catalog: DataFrame, events: DataFrame) -> DataFrame:
    """``apply_events`` after renames (``previous_path`` not null) have moved catalogue rows to their new paths.

    The last rename from a path moves its row; a move onto a known path takes that row's place. A rename no later than its row's
    ``last_ts`` does nothing, so applying events twice changes nothing.
    """
    last = events.filter("event_type = 'renamed' and previous_path is not null").groupBy("root_id", F.col("previous_path").alias("from")).agg(F.max(F.struct("ts", "event_id", "path")).alias("e"))
    moves = last.select(F.col("root_id").alias("moved_root"), "from", F.col("e.path").alias("to"), F.col("e.ts").alias("moved_at"))
    m = catalog.join(moves, (F.col("root_id") == F.col("moved_root")) & (F.col("path") == F.col("from")) & (F.col("last_ts").isNull() | (F.col("moved_at") > F.col("last_ts"))), "left")
    moved = m.select("root_id", F.coalesce("to", "path").alias("path"), "availability", F.greatest("last_ts", "moved_at").alias("last_ts"), F.col("to").isNotNull().alias("came"))
    first = F.row_number().over(Window.partitionBy("root_id", "path").orderBy(F.desc("came"), F.desc_nulls_last("last_ts")))
    placed = moved.withColumn("r", first).filter("r = 1").drop("r", "came")
    return apply_events(placed, events)


#: Degradation levels and those that may follow each; a level may also stay.
LEVEL_STEPS = {"full": ["balanced"], "balanced": ["full", "core"], "core": ["balanced"]}


def level_violations(history: DataFrame, steps: dict[str, list[str]] = LEVEL_STEPS) -> DataFrame:
    """``job_id, seq, problem`` of a history of degradation levels (``job_id, seq, level``): an unknown level or a change that isn't allowed."""
    h = history.select("job_id", "seq", F.col("level").alias("status"), F.lit(0.0).alias("progress"), F.lit(0).alias("processed"), F.lit(0).alias("total"))
    wrong = h.filter(~F.coalesce(F.col("status").isin(list(steps)), F.lit(False))).select("job_id", "seq", F.lit("unknown level").alias("problem"))
    return job_transition_violations(h, steps).union(wrong)


def level_state_problems(states: DataFrame) -> DataFrame:
    """``job_id, seq, problem`` of degradation states (``job_id, seq, level, triggers, disabled_features, entered_at, recover_after``).

    A full level keeps no triggers or disabled features, any other has triggers and the time it was entered, and recovery isn't
    looked for before that. Null lists are empty.
    """
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    full = F.col("level").eqNullSafe("full")
    problems = F.array_compact(F.array(
        F.when(full & (some("triggers") | some("disabled_features")), "full with causes"), F.when(~full & (~some("triggers") | F.col("entered_at").isNull()), "no cause or time"), F.when(F.col("recover_after") < F.col("entered_at"), "recovery too early"),
    ))
    return states.select("job_id", "seq", F.explode(problems).alias("problem"))
