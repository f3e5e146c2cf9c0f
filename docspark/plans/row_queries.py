"""Registered queries on the full forms of listings, checks, rates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import catalog, collections, evaluation, evidence, extraction, hybrid, incremental, inventory, profiles, relations, traces, vectors
from docspark.plans.queries import h1, query
from docspark.plans.tables import CHUNKS, FILES, HITS, chunks, files, hits
from docspark.sources.files import read_table

_BEFORE = f"""{FILES}, pv AS (SELECT file_id, file_id % 3 AS volume, CASE WHEN file_id % 5 != 0 THEN file_id * 10 END AS number, 'p' || file_id AS path, content_sha256 AS h, file_id % 13 != 5 AS present FROM files WHERE file_id % 10 != 3),
cu AS (SELECT file_id % 3 AS volume, CASE WHEN file_id % 5 != 0 AND file_id % 11 != 2 THEN file_id * 10 END AS number, CASE WHEN file_id % 7 = 2 THEN 'q' ELSE 'p' END || file_id AS path, CASE WHEN file_id % 8 = 1 THEN sha256(content_sha256) ELSE content_sha256 END AS h FROM files WHERE file_id % 10 != 4),
m1 AS (SELECT file_id, pv.path, pv.h, present, cu.path AS np, cu.h AS nh FROM pv JOIN cu USING (volume, number)), m2 AS (SELECT file_id, p.path, p.h, present, c.path AS np, c.h AS nh FROM (SELECT * FROM pv WHERE file_id NOT IN (SELECT file_id FROM m1)) p FULL JOIN (SELECT * FROM cu WHERE path NOT IN (SELECT np FROM m1)) c ON p.path = c.path)"""


@query("t1_match_snapshots", f"WITH {_BEFORE}, b AS (SELECT file_id, coalesce(np, path) AS path, CASE WHEN np IS NOT NULL AND file_id IS NULL THEN 'discovered' WHEN np IS NULL AND present THEN 'missing' WHEN np IS NOT NULL AND NOT present THEN 'restored' WHEN np IS NOT NULL AND h != nh THEN 'modified' WHEN path != np THEN 'renamed' END AS change, np IS NOT NULL AND file_id IS NOT NULL AND h != nh AS new_revision FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2)) SELECT * FROM b WHERE change IS NOT NULL")
def t1_match(spark, sf):
    f, k = files(spark, sf).select("file_id", "content_sha256"), F.col("file_id")
    name = lambda c: F.concat(c, k.cast("string"))
    prev = f.filter("file_id % 10 != 3").select("file_id", (k % 3).alias("volume"), F.when(k % 5 != 0, k * 10).alias("number"), name(F.lit("p")).alias("path"), "content_sha256", (k % 13 != 5).alias("present"))
    curr = f.filter("file_id % 10 != 4").select((k % 3).alias("volume"), F.when((k % 5 != 0) & (k % 11 != 2), k * 10).alias("number"), name(F.when(k % 7 == 2, "q").otherwise("p")).alias("path"), F.when(k % 8 == 1, F.sha2("content_sha256", 256)).otherwise(F.col("content_sha256")).alias("content_sha256"))
    return incremental.match_snapshots(prev, curr)


@query("c7_file_page", f"WITH {FILES}, f AS (SELECT file_id, display_name FROM files WHERE contains(lower(display_name), 'doc 1') AND parse_status = 'parsed'), p AS (SELECT * FROM f WHERE file_id > 20 ORDER BY file_id LIMIT 30) SELECT file_id, display_name, (SELECT count(*) FROM f) AS total, CASE WHEN (SELECT count(*) FROM f WHERE file_id > 20) > 30 THEN (SELECT max(file_id) FROM p) END AS next_after FROM p")
def c7_page(spark, sf):
    return catalog.file_page(files(spark, sf), "DOC 1", statuses=["parsed"], availability=["present"], after=20, page_size=30).select("file_id", "display_name", "total", "next_after")


@query("c6_scope_files", f"WITH {FILES} SELECT file_id FROM files WHERE extension IN ('en', 'fr') AND file_id % 6 IN (1, 2)")
def c6_files(spark, sf):
    f = files(spark, sf)
    return catalog.scope_files(f, f.select((F.col("file_id") % 6).alias("collection_id"), "file_id"), collections=[1, 2], extensions=["en", "fr"]).select("file_id")


@query("c2_exact_paths", f"WITH {FILES} SELECT file_id FROM files WHERE root_id NOT IN ('src1', 'src3')")
def c2_paths(spark, sf):
    rules = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("rule_id"), F.concat(F.lit("c:/SRC"), F.col("r_regionkey").cast("string"), F.lit("/")).alias("path"), (F.col("r_regionkey") % 2 == 1).alias("enabled"))
    return catalog.exclude_paths(files(spark, sf), rules, rules.filter("rule_id > 3").select("rule_id", F.lit(False).alias("enabled"))).select("file_id")


_VEC = "v AS (SELECT vec_id || '-1' AS chunk_id, CASE WHEN vec_id % 4 = 0 THEN 'old' ELSE 'new' END AS key FROM embeddings)"


def keyed_vectors(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.concat_ws("-", "vec_id", F.lit(1)).alias("chunk_id"), F.when(F.col("vec_id") % 4 == 0, "old").otherwise("new").alias("key"))


@query("c10_index_coverage", f"WITH {FILES}, {CHUNKS}, {_VEC}, f AS (SELECT count(*) AS discovered, count(*) FILTER (file_id % 9 = 0) AS excluded, count(*) FILTER (file_id % 9 != 0 AND extension IN ('en', 'de')) AS parseable, count(*) FILTER (file_id % 9 != 0 AND extension IN ('en', 'de') AND parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'failed') AS failed FROM files), c AS (SELECT count(*) AS chunks, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM v)) AS embedded, count(*) FILTER (chunk_id IN (SELECT chunk_id FROM v WHERE key = 'new')) AS active FROM chunks), a AS (SELECT count(*) FILTER (page_id % 12 = 3) AS pending_assets FROM pages) SELECT *, round(parsed / parseable, 6) AS parse_ratio, round(embedded / chunks, 6) AS embedding_ratio, round(active / chunks, 6) AS vector_ratio FROM f, c, a")
def c10_index(spark, sf):
    f = files(spark, sf).withColumn("excluded", F.col("file_id") % 9 == 0)
    assets = read_table(spark, sf, "pages").select(F.when(F.col("page_id") % 12 == 3, "pending").otherwise("ready").alias("status"))
    return catalog.index_coverage(f, chunks(spark, sf), keyed_vectors(spark, sf), assets, "new", ["en", "de"])


@query("c12_integrity_checks", f"WITH {FILES}, {CHUNKS}, {_VEC}, x AS (SELECT (SELECT count(*) FROM v WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE file_id % 5 != 0)) AS orphan_vectors, (SELECT count(*) FROM v WHERE key != 'new') AS other_keys, (SELECT count(*) FROM files WHERE file_id % 40 = 7) AS rootless_files, (SELECT count(*) FROM events WHERE event_type IN ('view', 'click') AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 15 MINUTE) AS stale_jobs) SELECT *, orphan_vectors = 0 AND other_keys = 0 AS vectors_pass, rootless_files = 0 AS files_pass, stale_jobs = 0 AS jobs_pass FROM x")
def c12_checks(spark, sf):
    f = files(spark, sf).withColumn("root_id", F.when(F.col("file_id") % 40 != 7, F.col("root_id")))
    jobs = read_table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"))
    return catalog.integrity_checks(f, chunks(spark, sf).filter("file_id % 5 != 0"), keyed_vectors(spark, sf), jobs, "new", "2024-01-20 12:00:00")


@query("v7_rebuild_progress", f"WITH {CHUNKS}, c AS (SELECT * FROM chunks WHERE file_id % 4 != 0) SELECT count(*) FILTER (file_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 != 1)) AS done, count(*) AS total FROM c")
def v7_progress(spark, sf):
    c = chunks(spark, sf).withColumn("revision_id", F.lit(1))
    current = files(spark, sf).select("file_id", F.when(F.col("file_id") % 4 == 0, 2).otherwise(1).alias("revision_id"))
    v = c.join(read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id")), "file_id").select("chunk_id", F.when(F.col("file_id") % 3 == 1, "old").otherwise("m").alias("model"))
    return catalog.rebuild_progress(c, current, v, "m")


@query("c16_processing_counts", f"WITH {FILES} SELECT 'parse_status' AS kind, parse_status AS name, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'disposition', CASE WHEN file_id % 3 = 0 THEN 'skip' ELSE 'process' END, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'attempts', event_type, count(*) FROM events GROUP BY 2")
def c16_counts(spark, sf):
    f = files(spark, sf).withColumn("disposition", F.when(F.col("file_id") % 3 == 0, "skip").otherwise("process"))
    return catalog.processing_counts(f, read_table(spark, sf, "events").withColumnRenamed("event_type", "operation"))


@query("e23_session_page", "WITH m AS (SELECT conv_id AS session_id, turn, make_timestamp(2024, 1, 1 + (conv_id % 20)::INT, 0, turn::INT, 0) AS tm, CASE WHEN turn % 4 = 1 THEN 'e' || turn END AS error FROM conversations), s AS (SELECT session_id, count(*) AS messages, min(tm) AS first_at, max(tm) AS last_at, arg_max(error, turn) FILTER (error IS NOT NULL) AS last_error FROM m GROUP BY 1) SELECT * FROM s WHERE last_at < TIMESTAMP '2024-01-15' ORDER BY last_at DESC, session_id LIMIT 10")
def e23_page(spark, sf):
    c = read_table(spark, sf, "conversations")
    at = F.make_timestamp(F.lit(2024), F.lit(1), (1 + F.col("conv_id") % 20).cast("int"), F.lit(0), F.col("turn").cast("int"), F.lit(0))
    return catalog.session_page(c.select(F.col("conv_id").alias("session_id"), "turn", at.alias("created_at"), F.when(F.col("turn") % 4 == 1, F.concat(F.lit("e"), F.col("turn").cast("string"))).alias("error")), ("2024-01-15", -1), 10)


@query("c13_inbox_page", "SELECT event_id AS item_id, event_type, (SELECT count(*) FROM events WHERE event_id % 4 IN (1, 2) AND event_type = 'click') AS total FROM events WHERE event_id % 4 IN (1, 2) AND event_type = 'click' AND event_id < 900 ORDER BY event_id DESC LIMIT 20")
def c13_page(spark, sf):
    i = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("open", "pending_retry", "retrying", "done"))), (i % 4 + 1).cast("int"))
    e = read_table(spark, sf, "events").select(i.alias("item_id"), "event_type", state.alias("resolution"), F.col("ts").alias("created_at"))
    return inventory.inbox_page(e, 20, before=900, status="error", event_types=["click"]).select("item_id", "event_type", "total")


@query("x7_parse_sums", f"WITH {FILES} SELECT parse_status AS outcome, extension AS format, count(*) AS files, sum(file_id % 9)::BIGINT AS pages, sum(file_id % 11)::BIGINT AS nodes, sum(size_bytes)::BIGINT AS characters, coalesce(sum(CASE WHEN file_id % 2 = 0 THEN file_id % 5 END), 0)::BIGINT AS ocr_pages FROM files GROUP BY 1, 2")
def x7_sums(spark, sf):
    k = F.col("file_id")
    return inventory.parse_sums(files(spark, sf).select(F.col("parse_status").alias("outcome"), F.col("extension").alias("format"), (k % 9).alias("pages"), (k % 11).alias("nodes"), F.col("size_bytes").alias("characters"), F.when(k % 2 == 0, k % 5).alias("ocr_pages")))


@query("o5_engine_stats", "SELECT 'attempt' AS kind, event_type AS operation, 'e' || event_id % 2 AS engine, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS n, round(sum(value), 2) AS elapsed_ms, count(*) FILTER (event_id % 5 = 0) AS retryable FROM events GROUP BY 2, 3, 4 UNION ALL SELECT 'asset', NULL, NULL, CASE WHEN page_id % 4 = 1 THEN 'failed' ELSE 'ready' END, count(*), NULL, NULL FROM pages GROUP BY 4")
def o5_engines(spark, sf):
    e, i = read_table(spark, sf, "events"), F.col("event_id")
    a = e.select(F.col("event_type").alias("operation"), F.concat(F.lit("e"), (i % 2).cast("string")).alias("engine"), F.when(i % 3 == 0, "failed").otherwise("done").alias("status"), F.col("value").alias("elapsed_ms"), (i % 5 == 0).alias("retryable"))
    return inventory.engine_stats(a, read_table(spark, sf, "pages").select(F.when(F.col("page_id") % 4 == 1, "failed").otherwise("ready").alias("status")))


@query("o6_activity_ocr", f"WITH {FILES}, {CHUNKS} SELECT count(*) AS discovered, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (file_id IN (SELECT file_id FROM chunks)) AS searchable, count(*) FILTER (file_id || '-1' IN (SELECT chunk_id FROM chunks) AND file_id IN (SELECT vec_id FROM embeddings)) AS embedded, (SELECT count(DISTINCT (l_suppkey, l_linenumber)) FROM lineitem WHERE l_returnflag = 'R') AS ocr_pages FROM files")
def o6_ocr(spark, sf):
    pages = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "R", "ocr").alias("engine"))
    return inventory.activity_with_ocr(files(spark, sf), chunks(spark, sf), keyed_vectors(spark, sf), pages)


@query("c14_level_violations", "WITH h AS (SELECT l_orderkey AS job_id, l_linenumber AS seq, min(l_returnflag || l_linestatus) AS m FROM lineitem GROUP BY 1, 2), v AS (SELECT *, CASE m WHEN 'AF' THEN 'full' WHEN 'NO' THEN 'balanced' WHEN 'RF' THEN 'core' ELSE lower(m) END AS l FROM h), s AS (SELECT *, lag(l) OVER (PARTITION BY job_id ORDER BY seq) AS b FROM v) SELECT job_id, seq, 'transition' AS problem FROM s WHERE b IS NOT NULL AND b != l AND b || '>' || l NOT IN ('full>balanced', 'balanced>full', 'balanced>core', 'core>balanced') UNION ALL SELECT job_id, seq, 'unknown level' FROM s WHERE l NOT IN ('full', 'balanced', 'core')")
def c14_levels(spark, sf):
    h = read_table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("m"))
    level = F.when(F.col("m") == "AF", "full").when(F.col("m") == "NO", "balanced").when(F.col("m") == "RF", "core").otherwise(F.lower("m"))
    return inventory.level_violations(h.select("job_id", "seq", level.alias("level")))


@query("c14_level_states", "WITH s AS (SELECT event_id AS job_id, user_id AS seq, event_id % 3 = 0 AS f, event_id % 4 = 0 AS t, event_id % 5 = 0 AS d, event_id % 7 != 0 AS e, event_id % 11 = 0 AS early FROM events) SELECT job_id, seq, 'full with causes' AS problem FROM s WHERE f AND (t OR d) UNION ALL SELECT job_id, seq, 'no cause or time' FROM s WHERE NOT f AND (NOT t OR NOT e) UNION ALL SELECT job_id, seq, 'recovery too early' FROM s WHERE e AND early")
def c14_states(spark, sf):
    k, none = F.col("event_id"), F.array().cast("array<string>")
    level = F.when(k % 3 == 0, "full").when(k % 2 == 0, "balanced").otherwise("core")
    s = read_table(spark, sf, "events").select(
        k.alias("job_id"), F.col("user_id").alias("seq"), level.alias("level"), F.when(k % 4 == 0, F.array("event_type")).otherwise(none).alias("triggers"), F.when(k % 5 == 0, F.array(F.lit("rerank"))).alias("disabled_features"),
        F.when(k % 7 != 0, F.col("ts")).alias("entered_at"), (F.col("ts") + F.when(k % 11 == 0, F.expr("interval -1 minute")).otherwise(F.expr("interval 1 minute"))).alias("recover_after"),
    )
    return inventory.level_state_problems(s)


@query("h5_sorted_files", f"WITH {HITS}, c AS (SELECT query_id, file_id, chunk_id, score AS fused, file_id * 37 % 101 AS m FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY score DESC, chunk_id) = 1), r AS (SELECT 'relevance' AS sort, query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, m DESC, file_id) AS place FROM c UNION ALL SELECT 'modified', query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY m DESC, file_id) FROM c UNION ALL SELECT 'name', query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY 'n' || file_id % 7, file_id) FROM c) SELECT * FROM r WHERE place <= 6")
def h5_sorted(spark, sf):
    k = F.col("file_id")
    c = hits(spark, sf).select("query_id", "file_id", "chunk_id", F.col("score").alias("fused"), (k * 37 % 101).alias("modified_at"), F.concat(F.lit("N"), (k % 7).cast("string")).alias("display_name"))
    out = None
    for sort in ("relevance", "modified", "name"):
        part = hybrid.sorted_files(c, sort, 6).select(F.lit(sort).alias("sort"), "query_id", "file_id", "place")
        out = part if out is None else out.union(part)
    return out


@query("h8_cursor_page")
def h8_cursor(spark, sf):
    ranked = h1(spark, sf)
    digest = hybrid.ranking_digest(ranked).first().fingerprint
    return hybrid.cursor_page(ranked, f"v1:10:{digest}", 10)


_RUN = """r AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderkey % 3 = 0 AS passed, o_custkey % 1000 AS ms, CASE WHEN o_orderkey % 2 = 0 THEN 'LOCAL' END AS es, CASE WHEN o_custkey % 3 = 0 THEN 'LOCAL' END AS s, CASE WHEN o_orderkey % 5 != 0 THEN 'ask' END AS ei, CASE WHEN o_custkey % 4 = 0 THEN 'find' ELSE 'ask' END AS i, CASE WHEN o_orderkey % 4 != 1 THEN [o_custkey % 5, 9] END AS ef, [o_orderkey % 5] AS af, [o_orderkey % 7, o_custkey % 3, 9] AS tf, o_orderkey % 6 = 0 AS m, o_orderkey % 8 = 1 AS cl, CASE WHEN o_orderkey % 3 != 2 THEN o_orderkey % 3 = 1 END AS ee, o_custkey % 2 = 0 AS fo, o_custkey % 5 != 0 AS g, o_orderkey % 4 AS n, o_custkey % 4 AS sn FROM orders)"""


def run(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read_table(spark, sf, "orders").select(
        (k % 3 == 0).alias("passed"), (c % 1000).alias("latency_ms"), F.when(k % 2 == 0, "LOCAL").alias("expected_source"), F.when(c % 3 == 0, "LOCAL").alias("actual_source"), F.when(k % 5 != 0, "ask").alias("expected_intent"), F.when(c % 4 == 0, "find").otherwise("ask").alias("actual_intent"),
        F.when(k % 4 != 1, F.array(c % 5, F.lit(9).cast("long"))).alias("expected_file_ids"), F.array(k % 5).alias("actual_file_ids"), F.array(k % 7, c % 3, F.lit(9).cast("long")).alias("top_files"), (k % 6 == 0).alias("memory_used"), (k % 8 == 1).alias("clarified"),
        F.when(k % 3 != 2, k % 3 == 1).alias("expected_evidence"), (c % 2 == 0).alias("evidence_found"), (c % 5 != 0).alias("grounded"), (k % 4).alias("claims"), (c % 4).alias("supported_claims"),
    )


_RATE = "round(CASE WHEN count(*) FILTER ({1}) > 0 THEN count(*) FILTER (({0}) AND ({1})) / count(*) FILTER ({1}) ELSE 0 END, 6)"
_HAS = "coalesce(list_has_any(ef, {}), FALSE)"


@query("q8_run_rates", f"WITH {_RUN} SELECT count(*) AS cases, count(*) FILTER (passed) AS passes, round(avg(ms), 4) AS mean_ms, {_RATE.format('es IS NOT DISTINCT FROM s', 'es IS NOT NULL')} AS source_accuracy, {_RATE.format('ei IS NOT DISTINCT FROM i', 'ei IS NOT NULL')} AS intent_accuracy, {_RATE.format(_HAS.format('tf[:1]'), 'ef IS NOT NULL')} AS top1_accuracy, {_RATE.format(_HAS.format('tf[:3]'), 'ef IS NOT NULL')} AS top3_recall, {_RATE.format(_HAS.format('af'), 'm')} AS memory_hits, {_RATE.format('NOT ' + _HAS.format('af'), 'm')} AS memory_wrong, {_RATE.format('cl', 'TRUE')} AS clarification_rate, {_RATE.format(_HAS.format('af'), 'cl')} AS clarification_success, {_RATE.format('fo', 'coalesce(ee, FALSE)')} AS evidence_recall, {_RATE.format('NOT fo', 'coalesce(ee, FALSE)')} AS false_no_evidence, {_RATE.format('g', 'TRUE')} AS grounded_rate, {_RATE.format('sn = n', 'n > 0')} AS citation_pass_rate FROM r")
def q8_rates(spark, sf):
    return evaluation.run_rates(run(spark, sf))


@query("q10_feature_metrics", "WITH r AS (SELECT l_linestatus AS f, CASE WHEN l_partkey % 9 < 7 THEN l_partkey % 9 + 1 END AS t, l_suppkey % 11 / 10 AS rc, l_suppkey % 5 / 4 AS pr, l_discount > 0.03 AS p, floor(l_extendedprice)::BIGINT AS ms, CASE WHEN l_suppkey % 3 != 0 THEN l_suppkey % 2 = 0 END AS s, l_partkey % 4 = 0 AS fo, CASE WHEN l_linenumber > 5 THEN l_partkey % 3 = 0 END AS g FROM lineitem) SELECT f AS feature, count(*) AS cases, round(count(*) FILTER (p) / count(*), 6) AS pass_rate, round(count(*) FILTER (t <= 1) / count(*), 6) AS top1, round(count(*) FILTER (t <= 3) / count(*), 6) AS top3, round(count(*) FILTER (t <= 5) / count(*), 6) AS top5, round(avg(coalesce(1 / t, 0)), 6) AS mrr, round(count(*) FILTER (s) / count(s), 6) AS source_accuracy, round(count(*) FILTER (fo) / count(fo), 6) AS evidence_rate, round(count(*) FILTER (g) / count(g), 6) AS grounded_rate, round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, quantile_disc(ms, 0.95) AS p95_ms FROM r GROUP BY 1")
def q10_features(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return evaluation.feature_metrics(read_table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("feature"), F.when(p % 9 < 7, p % 9 + 1).alias("top"), (s % 11 / 10).alias("recall"), (s % 5 / 4).alias("precision"), (F.col("l_discount") > 0.03).alias("passed"), F.floor("l_extendedprice").alias("latency_ms"),
        F.when(s % 3 != 0, s % 2 == 0).alias("source_ok"), (p % 4 == 0).alias("found"), F.when(F.col("l_linenumber") > 5, p % 3 == 0).alias("grounded"),
    ))


@query("q2_structured_rate", "SELECT round(count(*) FILTER (o_custkey % 3 = 0 AND o_orderkey % 4 != 0) / count(*) FILTER (o_orderkey % 4 != 0), 6) AS structured_rate FROM orders")
def q2_structured(spark, sf):
    return evaluation.structured_rate(read_table(spark, sf, "orders").select((F.col("o_custkey") % 3 == 0).alias("structured"), (F.col("o_orderkey") % 4 != 0).alias("generated")))


_EDGES = "ed AS (SELECT l_orderkey AS l, l_partkey AS r, CASE WHEN l_suppkey % 2 = 0 THEN 'version' ELSE 'duplicate' END AS t, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, t ORDER BY l_linenumber) = 1)"


def edges(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("left_file_id"), F.col("l_partkey").alias("right_file_id"), F.when(F.col("l_suppkey") % 2 == 0, "version").otherwise("duplicate").alias("relation_type"), F.col("l_linenumber").alias("n"))
    return li.groupBy("left_file_id", "right_file_id", "relation_type").agg(F.min("n").alias("n"))


def reviews(spark, sf):
    return edges(spark, sf).filter("n < 4").withColumns({"status": F.when(F.col("n") == 1, "confirmed").otherwise("rejected"), "reviewed_at": F.col("n")}).drop("n")


@query("r10_relation_counts", f"WITH {_EDGES} SELECT t AS relation_type, CASE WHEN n = 1 THEN 'confirmed' WHEN n < 4 THEN 'rejected' ELSE 'suggested' END AS status, count(*) AS n FROM ed GROUP BY 1, 2")
def r10_counts(spark, sf):
    return relations.relation_counts(edges(spark, sf), reviews(spark, sf))


@query("r10_update_reviews", f"WITH {_EDGES} SELECT l AS left_file_id, r AS right_file_id, t AS relation_type, CASE WHEN n IN (2, 5) THEN 'confirmed' WHEN n = 1 THEN 'confirmed' ELSE 'rejected' END AS status, CASE WHEN n IN (2, 5) THEN 11 ELSE n END AS reviewed_at FROM ed WHERE n < 4 OR n = 5")
def r10_update(spark, sf):
    up = edges(spark, sf).filter("n in (2, 5)").drop("n")
    both = up.withColumns({"status": F.lit("rejected"), "reviewed_at": F.lit(10)}).union(up.withColumns({"status": F.lit("confirmed"), "reviewed_at": F.lit(11)}))
    return relations.update_reviews(reviews(spark, sf), both)


@query("k4_member_listing", f"WITH {FILES} SELECT collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY lower(display_name), file_id) AS place, file_id, display_name FROM (SELECT DISTINCT l_suppkey % 4 AS collection_id, l_partkey AS file_id FROM lineitem) JOIN files USING (file_id)")
def k4_members(spark, sf):
    m = read_table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("collection_id"), F.col("l_partkey").alias("file_id"))
    return collections.member_listing(m, files(spark, sf))


@query("o3_query_traces", "WITH o AS (SELECT o_orderkey AS operation_id, o_orderkey AS c, o_custkey AS ts FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT operation_id, ts, (SELECT count(*) FROM o) AS total FROM o ORDER BY ts DESC, operation_id DESC LIMIT 20 OFFSET 20")
def o3_traces(spark, sf):
    ops = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("operation_id"), F.col("o_orderkey").alias("correlation_id"), F.col("o_orderstatus").alias("flow"), F.col("o_orderpriority").alias("feature"), F.col("o_custkey").alias("ts"))
    nodes = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("correlation_id"), F.col("l_returnflag").alias("node"))
    return traces.query_traces(nodes, ops, "F", "R", "1-URGENT", page=1, size=20).select("operation_id", "ts", "total")


@query("p7_profile_counts", f"WITH {FILES} SELECT count(*) FILTER (file_id % 3 != 0 AND file_id % 5 != 0) AS profiled, count(*) FILTER (NOT (file_id % 3 != 0 AND file_id % 5 != 0)) AS stale, count(*) FILTER (file_id % 3 != 0) AS skipped FROM files")
def p7_counts(spark, sf):
    f, k = files(spark, sf), F.col("file_id")
    now = f.select("file_id", F.lit(1).alias("revision_id"), F.col("content_sha256").alias("text_hash"))
    old = now.filter(k % 3 != 0).withColumn("revision_id", F.when(k % 5 == 0, 0).otherwise(1))
    return profiles.profile_counts(old.union(old.withColumn("file_id", -1 - k)), now)


@query("v2_vector_summary", "SELECT count(*) AS rows, 2 AS dimensions, count(*) FILTER (vec_id = 0 OR vec_id % 9 = 4) AS rejected, count(*) FILTER (vec_id = 0 OR vec_id % 9 = 4) = 0 AS passed FROM embeddings")
def v2_summary(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return vectors.vector_summary(e.withColumn("embedding", F.when(F.col("vec_id") % 9 == 4, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))), "vec_id", "embedding", 64)


@query("e2_noise_summary", r"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Markup control text: ' || length(t) || ' characters, ' || len(list_distinct(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'))) || ' words' END AS summary FROM (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' \rtf1' ELSE '' END AS t FROM documents)".replace("\\\\", "\\"))
def e2_summary(spark, sf):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " \\rtf1").otherwise(""))
    return read_table(spark, sf, "documents").select("doc_id", extraction.noise_summary(t).alias("summary"))


@query("e9_answer_citations", "WITH c AS (SELECT o_custkey AS a, o_orderkey AS c, o_orderkey % 7 AS e FROM orders), v AS (SELECT a, c, e < 6 AND e % 5 != 4 AS ok FROM c) SELECT a AS answer_id, count(*) AS claims, count(*) FILTER (NOT ok) AS invalid, count(*) <= 12 AND count(*) FILTER (NOT ok) = 0 AS valid FROM v GROUP BY 1")
def e9_answers(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("answer_id"), F.col("o_orderkey").alias("claim_id"), F.lit("t").alias("text"), F.array((F.col("o_orderkey") % 7).cast("string")).alias("cited"))
    shown = o.select("answer_id").distinct().select("answer_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("n")).select("answer_id", F.col("n").cast("string").alias("evidence_id"), (F.col("n") % 5).alias("file_id"))
    return evidence.answer_citations(o, shown, shown.select("file_id").distinct().filter("file_id != 4"))


@query("e18_stale_roots", f"WITH {FILES} SELECT doc_id AS memory_id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id IN (SELECT file_id FROM files WHERE root_id != 'src2')) OR (doc_id % 3 = 2 AND doc_id % 5 < 3) THEN 'confirmed' ELSE 'stale' END AS status FROM documents")
def e18_roots(spark, sf):
    f, k = files(spark, sf), F.col("doc_id")
    m = read_table(spark, sf, "documents").select(k.alias("memory_id"), F.when(k % 3 == 0, "entity").when(k % 3 == 1, "file").otherwise("collection").alias("target_type"), F.when(k % 3 == 2, k % 5).otherwise(k).alias("target_id"), F.lit("confirmed").alias("status"))
    kept = f.select((F.col("file_id") % 3).alias("collection_id")).distinct()
    return evidence.stale_by_roots(m, f, f.select("root_id").filter("root_id != 'src2'"), kept).select("memory_id", "status")


@query("t4_apply_renames", "WITH e AS (SELECT user_id % 20 AS root_id, event_type AS t, 'p' || user_id % 7 AS path, CASE WHEN event_id % 3 = 0 THEN 'p' || event_id % 40 END AS prev, ts, event_id FROM events), k AS (SELECT root_id, 'p' || i AS path, 'present' AS a, TIMESTAMP '2024-01-03' AS l FROM (SELECT DISTINCT root_id FROM e), range(40) r(i)), m AS (SELECT root_id, prev, max(struct_pack(ts := ts, id := event_id, path := path)) AS e FROM e WHERE t = 'view' AND prev IS NOT NULL GROUP BY 1, 2), j AS (SELECT k.root_id, coalesce(e.path, k.path) AS path, a, greatest(l, e.ts) AS l, e IS NOT NULL AS came FROM k LEFT JOIN m ON m.root_id = k.root_id AND prev = k.path AND e.ts > l), p AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY root_id, path ORDER BY came DESC, l DESC) = 1), z AS (SELECT root_id, path, max(struct_pack(ts := ts, id := event_id, t := t)) AS z FROM e GROUP BY 1, 2) SELECT coalesce(p.root_id, z.root_id) AS root_id, coalesce(p.path, z.path) AS path, CASE WHEN z IS NOT NULL AND (l IS NULL OR z.ts > l) THEN CASE WHEN z.t = 'error' THEN 'missing' ELSE 'present' END ELSE a END AS availability, CASE WHEN z IS NOT NULL AND (l IS NULL OR z.ts > l) THEN z.ts ELSE l END AS last_ts FROM p FULL JOIN z ON p.root_id = z.root_id AND p.path = z.path")
def t4_renames(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "view", "renamed").when(F.col("event_type") == "error", "removed").otherwise("modified")
    e = read_table(spark, sf, "events").select((u % 20).alias("root_id"), kind.alias("event_type"), F.concat(F.lit("p"), (u % 7).cast("string")).alias("path"), F.when(i % 3 == 0, F.concat(F.lit("p"), (i % 40).cast("string"))).alias("previous_path"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    known = e.select("root_id").distinct().select("root_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n")).select("root_id", F.concat(F.lit("p"), F.col("n").cast("string")).alias("path"), F.lit("present").alias("availability"), F.lit("2024-01-03").cast("timestamp").alias("last_ts"))
    return inventory.apply_renames(known, e)
