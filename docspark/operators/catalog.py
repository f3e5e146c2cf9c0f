"""The file catalogue: exclusions, scopes, listings, coverage and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.text import path_key
from docspark.storage import cut


def ancestors(key: Column) -> Column:
    r"""The path itself and every folder above it, from a normalised key."""
    parts = F.split(key, r"\\")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\\"))


def _holds(test, core: Column):
    return lambda part: test(part, core)


def apply_exclusions(files: DataFrame, names: list[str], globs: list[str], extensions: list[str]) -> DataFrame:
    """Files that no rule excludes. A name or glob that hits a folder takes its whole subtree.

    Rules are a parameter list, so they become expressions of the scan's filter and nothing is joined.
    """
    parts = F.split(path_key(F.col("canonical_path")), r"\\")
    hit = F.lit(False)
    for name in names:
        hit = hit | F.array_contains(parts, name.lower())
    for glob in globs:
        core = F.lit(glob.lower().strip("*"))
        test = F.contains if glob.startswith("*") and glob.endswith("*") else F.endswith if glob.startswith("*") else F.startswith
        hit = hit | F.exists(parts, _holds(test, core))
    if extensions:
        hit = hit | F.lower("extension").isin([e.lower() for e in extensions])
    return files.filter(~F.coalesce(hit, F.lit(False)))


def drop_protected(files: DataFrame, protected: DataFrame) -> DataFrame:
    """Files neither equal to nor below a path of ``protected`` (``path``)."""
    exploded = files.select("file_id", F.explode(ancestors(path_key(F.col("canonical_path")))).alias("k"))
    inside = exploded.join(protected.select(path_key(F.col("path")).alias("k")).distinct(), "k").select("file_id").distinct()
    return files.join(inside, "file_id", "left_anti")


def assign_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``file_id, root_id, relative_path, is_primary`` for each root that contains a file; the longest is primary."""
    f = files.select("file_id", path_key(F.col("canonical_path")).alias("key"))
    up = f.select("file_id", "key", F.explode(ancestors(F.col("key"))).alias("k"))
    r = roots.select("root_id", path_key(F.col("path")).alias("k"))
    hit = up.join(r, "k")
    first = Window.partitionBy("file_id").orderBy(F.desc(F.length("k")), "root_id")
    return hit.select("file_id", "root_id", F.expr("substring(key, length(k) + 2)").alias("relative_path"), (F.row_number().over(first) == 1).alias("is_primary"))


def apply_scope(files: DataFrame, roots=(), extensions=(), modified_from=None, modified_to=None, availability=()) -> DataFrame:
    """Filters; an empty list does not restrict."""
    for column, values in (("root_id", roots), ("extension", extensions), ("availability", availability)):
        if values:
            files = files.filter(F.col(column).isin(list(values)))
    if modified_from:
        files = files.filter(F.col("modified_at") >= F.lit(modified_from).cast("timestamp"))
    if modified_to:
        files = files.filter(F.col("modified_at") < F.lit(modified_to).cast("timestamp"))
    return files


def query_files(files: DataFrame, name_contains: str = "", extensions=(), statuses=(), after=None, page_size: int = 50) -> DataFrame:
    """A keyset page by file id: ``after`` is the last id seen; sizes go from 1 to 200."""
    if name_contains:
        files = files.filter(F.lower("display_name").contains(name_contains.lower()))
    if extensions:
        files = files.filter(F.col("extension").isin(list(extensions)))
    if statuses:
        files = files.filter(F.col("parse_status").isin(list(statuses)))
    if after is not None:
        files = files.filter(F.col("file_id") > after)
    return files.orderBy("file_id").limit(max(1, min(200, page_size)))


def status_counts(files: DataFrame) -> DataFrame:
    """Counts by parse status, by extension, and in all, in one pass over grouping sets."""
    return files.groupingSets([["parse_status"], ["extension"], []], "parse_status", "extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


def coverage_snapshot(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: discovered, parsed, failed, chunk and embedded counts and the two ratios (0 without a base)."""
    f = files.agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("parse_status") == "parsed").alias("parsed"), F.count_if(F.col("parse_status") == "failed").alias("failed"))
    c = chunks.join(vectors.select("chunk_id", F.lit(1).alias("has")).distinct(), "chunk_id", "left").agg(F.count(F.lit(1)).alias("chunks"), F.count("has").alias("embedded"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return f.crossJoin(c).select("*", ratio("parsed", "discovered").alias("parse_ratio"), ratio("embedded", "chunks").alias("embedding_ratio"))  # one row each


def integrity_snapshot(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: vectors without chunk, chunks without file, files without root, and whether all are 0."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(vectors.join(chunks, "chunk_id", "left_anti"), "orphan_vectors").crossJoin(one(chunks.join(files, "file_id", "left_anti"), "orphan_chunks")).crossJoin(one(files.filter("root_id is null"), "rootless_files"))
    return out.withColumn("passed", (F.col("orphan_vectors") == 0) & (F.col("orphan_chunks") == 0) & (F.col("rootless_files") == 0))


def pending_chunks(chunks: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Chunks that have no vector of ``model``."""
    return chunks.join(vectors.filter(F.col("model") == model), "chunk_id", "left_anti")


def content_manifest(files: DataFrame, buckets: int = 256) -> DataFrame:
    """One digest over all (id, hash) in the order of ids, in two levels so that no task holds them all."""
    rows = files.select("file_id", F.pmod("file_id", F.lit(buckets)).alias("bucket"), F.concat_ws(":", "file_id", "content_sha256").alias("line"))
    low = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "line"))), lambda s: s["line"]), "\n"), 256).alias("digest"))
    return low.agg(F.sum("n").alias("files"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda s: s["digest"]), "\n"), 256).alias("digest"))


#: Files that a leaf of a manifest tree may have, and bits of an id that a level tells apart.
LEAF, STEP = 1024, 4


def manifest_tree(files: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``shift, node, leaf, files, digest``: a tree of digests over (id, hash), with a node for each range of ids that has files.

    A node holds the ids that are ``node`` after shifting right by ``shift`` bits (64 bits leave 0). A range of more than ``leaf`` files is cut in sixteen by the next four bits, so
    no task collects more than a leaf's lines or sixteen digests, however ids are spread, and trees of two listings can be compared range by range. The root
    has the largest shift. Repeated rows count each; rows without an id are left out; an empty listing has no nodes.
    """
    rows = cut(files.filter("file_id is not null").select(F.col("file_id").cast("long").alias("file_id"), F.concat_ws(":", "file_id", "content_sha256").alias("line")))
    ends = rows.agg(F.min("file_id").alias("low"), F.max("file_id").alias("high")).first()
    empty = rows.sparkSession.createDataFrame([], "shift int, node long, leaf boolean, files long, digest string")
    if ends["low"] is None:
        return empty
    top = 0
    while top < 64 and ends["low"] >> top != ends["high"] >> top:
        top += STEP
    shifted = lambda c, by: F.shiftright(c, by) if by < 64 else F.lit(0).cast("long")
    nodes, open_, shift = empty, rows, top
    leaves = []
    while True:
        at = open_.withColumn("node", shifted("file_id", shift))
        sizes = cut(at.groupBy("node").agg(F.count(F.lit(1)).alias("files")))
        done = sizes.filter((F.col("files") <= leaf) | F.lit(shift == 0))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "line"))), lambda s: s["line"]), "\n")
        found = at.join(done, "node", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("files"), F.sha2(lines, 256).alias("digest"))
        leaves.append((shift, cut(found)))
        more = sizes.join(done, "node", "left_anti")
        if not more.limit(1).count():
            break
        open_ = cut(at.join(more, "node", "left_semi").drop("node"))
        shift -= STEP
    level = None
    for shift, found in reversed(leaves):
        own = found.select(F.lit(shift).alias("shift"), "node", F.lit(True).alias("leaf"), "files", "digest")
        if level is not None:
            children = F.array_sort(F.collect_list(F.struct("node", "digest")))
            inner = level.select(shifted("node", STEP if shift < 64 else 64).alias("up"), "node", "files", "digest").groupBy("up").agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.transform(children, lambda s: F.concat_ws(":", s["node"], s["digest"])), "\n"), 256).alias("digest"))
            own = own.unionByName(inner.select(F.lit(shift).alias("shift"), F.col("up").alias("node"), F.lit(False).alias("leaf"), "files", "digest"))
        level = cut(own)
        nodes = nodes.unionByName(level)
    return nodes


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """``low, high, files_before, files_after``: the smallest ranges of ids in which two trees of ``manifest_tree`` differ.

    A range counts if one tree has a leaf there and the other's digest for it isn't the same (or isn't there, and nor is a node above it that is a leaf in both).
    """
    a = before.select("shift", "node", F.col("leaf").alias("la"), F.col("files").alias("files_before"), F.col("digest").alias("da"))
    b = after.select("shift", "node", F.col("leaf").alias("lb"), F.col("files").alias("files_after"), F.col("digest").alias("db"))
    j = a.join(b, ["shift", "node"], "full_outer").filter((F.col("la") | F.col("lb")) & ~F.col("da").eqNullSafe(F.col("db")))
    whole = F.col("shift") >= 64
    low = F.when(whole, F.lit(-(2**63))).otherwise(F.call_function("shiftleft", F.col("node"), F.col("shift")))
    high = F.when(whole, F.lit(2**63 - 1)).otherwise(low + (F.call_function("shiftleft", F.lit(1).cast("long"), F.least("shift", F.lit(60))) - 1))
    return j.select(low.alias("low"), high.alias("high"), F.coalesce("files_before", F.lit(0)).alias("files_before"), F.coalesce("files_after", F.lit(0)).alias("files_after"))


def recent_history(messages: DataFrame, users: int = 5, others: int = 5, chars: int = 400) -> DataFrame:
    """The newest user and other messages of each session in time order, white space folded, each cut."""
    w = Window.partitionBy("session_id", F.col("role") == "user").orderBy(F.desc("turn"))
    kept = messages.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= F.when(F.col("role") == "user", users).otherwise(others))
    text = F.substring(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), 1, chars)
    return kept.select("session_id", "turn", "role", text.alias("text"))


def session_summaries(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))


def neighbor_context(hits: DataFrame, chunks: DataFrame, cap: int) -> DataFrame:
    """``file_id, ordinal, before, after``: texts of the chunks next to each hit, cut to ``cap``."""
    near = chunks.select("file_id", F.col("ordinal").alias("o"), F.substring("text", 1, cap).alias("t"))
    b = near.select("file_id", (F.col("o") + 1).alias("ordinal"), F.col("t").alias("before"))
    a = near.select("file_id", (F.col("o") - 1).alias("ordinal"), F.col("t").alias("after"))
    return hits.join(b, ["file_id", "ordinal"], "left").join(a, ["file_id", "ordinal"], "left")


def head_mid_tail(chunks: DataFrame) -> DataFrame:
    """First, middle (index n // 2, or the first of two) and last ordinal of each file's chunks."""
    w = Window.partitionBy("file_id").orderBy("ordinal")
    c = chunks.withColumns({"r": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("file_id"))})
    mid = F.when(F.col("n") >= 3, F.floor(F.col("n") / 2)).otherwise(0)
    pick = lambda at: F.max(F.when(F.col("r") == at, F.col("ordinal")))
    return c.groupBy("file_id").agg(pick(F.lit(0)).alias("head"), pick(mid).alias("middle"), pick(F.col("n") - 1).alias("tail"))


def file_page(files: DataFrame, name_contains: str = "", extensions=(), statuses=(), availability=(), after=None, page_size: int = 50) -> DataFrame:
    """``query_files`` with ``total`` (all that the filters find) and ``next_after`` (the last id of the page if more follow, else null)."""
    size = max(1, min(200, page_size))
    if availability:
        files = files.filter(F.col("availability").isin(list(availability)))
    if name_contains:
        files = files.filter(F.lower("display_name").contains(name_contains.lower()))
    for column, values in (("extension", extensions), ("parse_status", statuses)):
        if values:
            files = files.filter(F.col(column).isin(list(values)))
    later = F.col("file_id") > after if after is not None else F.lit(True)
    counts = files.agg(F.count(F.lit(1)).alias("total"), F.count_if(later).alias("rest"))
    page = files.filter(later).orderBy("file_id").limit(size)
    last = page.agg(F.max("file_id").alias("last"))
    both = counts.crossJoin(last).select("total", F.when(F.col("rest") > size, F.col("last")).alias("next_after"))  # one row each
    return page.crossJoin(F.broadcast(both))


def scope_files(files: DataFrame, members: DataFrame, collections=(), file_ids=(), **filters) -> DataFrame:
    """``apply_scope`` with collections (``members``: ``collection_id, file_id``) and a list of files; an empty list doesn't restrict."""
    out = apply_scope(files, **filters)
    if collections:
        out = out.join(members.filter(F.col("collection_id").isin(list(collections))).select("file_id"), "file_id", "left_semi")
    return out.filter(F.col("file_id").isin(list(file_ids))) if file_ids else out


def exclude_paths(files: DataFrame, rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Files neither at nor below the exact path of an enabled rule (``rule_id, path, enabled``); ``overrides`` (``rule_id, enabled``) come first."""
    r = rules if overrides is None else rules.withColumnRenamed("enabled", "own").join(overrides, "rule_id", "left").withColumn("enabled", F.coalesce("enabled", "own"))
    return drop_protected(files, r.filter("enabled").select("path"))


def index_coverage(files: DataFrame, chunks: DataFrame, vectors: DataFrame, assets: DataFrame, active_key: str, parseable=()) -> DataFrame:
    """One row: files discovered, excluded, parseable, parsed and failed; chunks; vectors of any and of the active key; assets that wait; and the
    ratios of parsed to parseable files, and of chunks with a vector and with an active one (0 without a base)."""
    can = F.col("extension").isin(list(parseable)) & ~F.coalesce("excluded", F.lit(False))
    f = files.agg(F.count(F.lit(1)).alias("discovered"), F.count_if("excluded").alias("excluded"), F.count_if(can).alias("parseable"), F.count_if(can & (F.col("parse_status") == "parsed")).alias("parsed"), F.count_if(F.col("parse_status") == "failed").alias("failed"))
    v = vectors.groupBy("chunk_id").agg(F.bool_or(F.col("key") == active_key).alias("active"))
    c = chunks.join(v, "chunk_id", "left").agg(F.count(F.lit(1)).alias("chunks"), F.count("active").alias("embedded"), F.count_if("active").alias("active"))
    a = assets.agg(F.count_if(F.col("status") == "pending").alias("pending_assets"))
    ratio = lambda x, y: F.round(F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0), 6)
    return f.crossJoin(c).crossJoin(a).select("*", ratio("parsed", "parseable").alias("parse_ratio"), ratio("embedded", "chunks").alias("embedding_ratio"), ratio("active", "chunks").alias("vector_ratio"))  # one row each


def integrity_checks(files: DataFrame, chunks: DataFrame, vectors: DataFrame, jobs: DataFrame, active_key: str, now: str, stale: str = "15 minutes") -> DataFrame:
    """One row: vectors without a chunk, vectors of another key than the active one, files without a root, jobs queued or running for over
    ``stale``; and whether vectors, files and jobs pass."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    old = F.col("status").isin("queued", "running") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {stale}"))
    out = one(vectors.join(chunks, "chunk_id", "left_anti"), "orphan_vectors").crossJoin(one(vectors.filter(F.col("key") != active_key), "other_keys")).crossJoin(one(files.filter("root_id is null"), "rootless_files")).crossJoin(one(jobs.filter(old), "stale_jobs"))
    return out.select("*", ((F.col("orphan_vectors") == 0) & (F.col("other_keys") == 0)).alias("vectors_pass"), (F.col("rootless_files") == 0).alias("files_pass"), (F.col("stale_jobs") == 0).alias("jobs_pass"))


def rebuild_progress(chunks: DataFrame, revisions: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """One row ``done, total``: chunks of current revisions (``file_id, revision_id``), and those of them with a vector of ``model``."""
    current = chunks.join(revisions.select("file_id", "revision_id"), ["file_id", "revision_id"], "left_semi")
    has = vectors.filter(F.col("model") == model).select("chunk_id", F.lit(1).alias("has")).distinct()
    return current.join(has, "chunk_id", "left").agg(F.count("has").alias("done"), F.count(F.lit(1)).alias("total"))


def processing_counts(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """``kind, name, n``: files by parse status and by disposition, and attempts by operation, in one table."""
    by = lambda df, kind, column: df.groupBy(F.lit(kind).alias("kind"), F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by(files, "parse_status", "parse_status").union(by(files, "disposition", "disposition")).union(by(attempts, "attempts", "operation"))


def session_page(messages: DataFrame, before=None, size: int = 50) -> DataFrame:
    """``session_summaries`` with ``last_error``, newest session first (last time, then id); ``before`` is the last (time, id) seen."""
    s = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("created_at", "turn"))).alias("last_error"))
    if before is not None:
        at, last = F.lit(before[0]).cast("timestamp"), F.lit(before[1])
        s = s.filter((F.col("last_at") < at) | ((F.col("last_at") == at) & (F.col("session_id") > last)))
    return s.orderBy(F.desc("last_at"), "session_id").limit(size)
