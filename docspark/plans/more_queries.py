"""More registered queries: parse results, roots, inbox, chunking, collections, evidence, memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import chunking, collections, evaluation, evidence, inventory, profiles, relations
from docspark.plans.queries import QUERIES, bm25, query
from docspark.plans.tables import CHUNKS, EVENTS, FILES, KEY, chunks, files, fs_events
from docspark.sources.files import read_table


def parse_results(spark, sf):
    f = files(spark, sf)
    warn = F.array_compact(F.array(F.when(F.col("size_bytes") < 200, "short"), F.when(F.col("size_bytes") > 5000, "long"), F.when(F.contains("text", F.lit("\t")), "tab")))
    return f.select(F.col("parse_status").alias("outcome"), F.col("extension").alias("format"), F.col("size_bytes").alias("characters"), F.size(F.split("text", "\n")).cast("long").alias("nodes"), warn.alias("warnings"))


@query("x7_parse_rollup", f"WITH {FILES} SELECT parse_status AS outcome, extension AS format, count(*) AS files, sum(size_bytes)::BIGINT AS characters, sum(len(string_split(text, chr(10))))::BIGINT AS nodes FROM files GROUP BY 1, 2")
def x7(spark, sf):
    return inventory.parse_status_rollup(parse_results(spark, sf))


@query("x7_warnings", "SELECT code, count(*) AS files FROM (SELECT unnest([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN contains(text, chr(9)) THEN 'tab' END]) AS code FROM documents) WHERE code IS NOT NULL GROUP BY 1")
def x7w(spark, sf):
    return inventory.warning_counts(parse_results(spark, sf))


def assets(spark, sf):
    p, i = read_table(spark, sf, "pages"), F.col("page_id")
    status = F.when(i % 12 == 3, "pending").when(i % 4 == 1, "failed").otherwise("ready")
    return p.select(i.alias("asset_id"), (i % 100).alias("file_id"), status.alias("status"), F.col("url").alias("text"), F.when(i % 3 != 0, F.concat(F.lit("page "), i.cast("string"))).alias("description"), F.when(i % 5 == 0, F.array(F.lit("web"), F.lit("page"))).otherwise(F.array().cast("array<string>")).alias("keywords"))


ASSETS = "assets AS (SELECT page_id AS asset_id, page_id % 100 AS file_id, CASE WHEN page_id % 12 = 3 THEN 'pending' WHEN page_id % 4 = 1 THEN 'failed' ELSE 'ready' END AS status, url AS text, CASE WHEN page_id % 3 != 0 THEN 'page ' || page_id END AS description, CASE WHEN page_id % 5 = 0 THEN 'web page' END AS words FROM pages)"


@query("x8_asset_nodes", f"WITH {ASSETS} SELECT file_id, 'asset-' || asset_id AS node_id, 'image' AS node_type, concat_ws(chr(10), text, description, words) AS text FROM assets WHERE status = 'ready'")
def x8(spark, sf):
    return inventory.asset_nodes(assets(spark, sf))


@query("x9_promote", f"WITH {FILES}, {ASSETS}, d AS (SELECT file_id FROM assets GROUP BY 1 HAVING bool_and(status != 'pending')) SELECT file_id, CASE WHEN parse_status = 'waiting' AND file_id IN (SELECT file_id FROM d) THEN 'parsed' ELSE parse_status END AS parse_status FROM files")
def x9(spark, sf):
    return inventory.promote_ready_files(files(spark, sf), assets(spark, sf)).select("file_id", "parse_status")


@query("c5_uncovered", rf"WITH {FILES}, c AS (SELECT DISTINCT regexp_replace({KEY}, '\\[^\\]*$', '') AS key FROM files UNION SELECT 'c:\' || root_id FROM files), r AS (SELECT unnest(['c:\src1\docs', 'c:\src2']) AS root) SELECT key FROM c WHERE NOT EXISTS (FROM r WHERE key = root OR starts_with(key, root || '\') OR starts_with(root, key || '\'))")
def c5(spark, sf):
    f = files(spark, sf)
    folders = f.select(F.regexp_replace("canonical_path", r"[\\/][^\\/]*$", "").alias("path")).union(f.select(F.concat(F.lit("C:\\"), "root_id"))).distinct()
    roots = spark.createDataFrame([("C:\\src1\\Docs",), ("C:/src2/",)], "path string")
    return inventory.uncovered_candidates(folders, roots).select("key").distinct()


@query("c9_home_summary", "SELECT event_id AS file_id, ts AS first_seen_at, (SELECT count(*) FROM events WHERE (ts + INTERVAL 8 HOUR)::DATE = DATE '2024-01-10') AS seen_that_day FROM events ORDER BY ts DESC, event_id LIMIT 10")
def c9(spark, sf):
    return inventory.home_summary(read_table(spark, sf, "events").select(F.col("event_id").alias("file_id"), F.col("ts").alias("first_seen_at")), "2024-01-10", "Asia/Shanghai")


def chunk_vectors(spark, sf, c):
    return c.join(read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id")), "file_id").filter("ordinal % 2 = 1").select("chunk_id")


_EMB = f"{FILES}, {CHUNKS}, c AS (SELECT chunk_id, file_id, ordinal % 2 = 1 AND file_id IN (SELECT vec_id FROM embeddings) AS has FROM chunks)"


@query("c11_scope_coverage", f"WITH {_EMB}, f AS (SELECT file_id, count(*) AS n, count(*) FILTER (has) AS e FROM c WHERE file_id IN (SELECT file_id FROM files WHERE extension IN ('en', 'de')) GROUP BY 1) SELECT sum(n)::BIGINT AS chunks, count(*) AS files, round(sum(e) / sum(n), 6) AS chunk_ratio, round(count(*) FILTER (e > 0) / count(*), 6) AS file_ratio FROM f")
def c11(spark, sf):
    c = chunks(spark, sf)
    return inventory.scope_index_coverage(c, chunk_vectors(spark, sf, c), files(spark, sf).filter("extension in ('en', 'de')"))


@query("o6_activity", f"WITH {_EMB}, e AS (SELECT file_id, bool_or(has) AS has FROM c GROUP BY 1) SELECT count(*) AS discovered, count(*) FILTER (parse_status = 'parsed') AS parsed, count(e.file_id) AS searchable, count(*) FILTER (has) AS embedded FROM files LEFT JOIN e USING (file_id)")
def o6(spark, sf):
    c = chunks(spark, sf)
    return inventory.activity_stats(files(spark, sf), c, chunk_vectors(spark, sf, c))


@query("c13_inbox", "SELECT event_id AS item_id, 'r' || user_id % 20 AS root_id, event_type, ['open', 'pending_retry', 'retrying', 'done'][event_id % 4 + 1] AS resolution, ts AS created_at FROM events WHERE event_id % 4 IN (1, 2) AND event_type IN ('click', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY event_id DESC LIMIT 50")
def c13(spark, sf):
    e, i = read_table(spark, sf, "events"), F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, ("open", "pending_retry", "retrying", "done"))), (i % 4 + 1).cast("int"))
    inbox = e.select(i.alias("item_id"), F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("root_id"), "event_type", state.alias("resolution"), F.col("ts").alias("created_at"))
    return inventory.query_inbox(inbox, "error", ["click", "error"], since="2024-01-05", until="2024-01-20")


@query("o5_attempts", "SELECT event_type AS operation, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'done' END AS status, count(*) AS attempts, round(sum(value), 2) AS elapsed_ms, count(*) FILTER (event_id % 5 = 0) AS retryable FROM events GROUP BY 1, 2")
def o5(spark, sf):
    e = read_table(spark, sf, "events")
    return inventory.attempt_stats(e.select(F.col("event_type").alias("operation"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("done").alias("status"), F.col("value").alias("elapsed_ms"), (F.col("event_id") % 5 == 0).alias("retryable")))


@query("t4_apply_events", f"WITH {EVENTS}, k AS (SELECT root_id, path, 'present' AS availability, min(ts) AS last_ts FROM fs WHERE event_id % 3 = 0 GROUP BY 1, 2), l AS (SELECT root_id, path, arg_max(event_type, struct_pack(ts := ts, id := event_id)) AS t, max(ts) AS ts FROM fs GROUP BY 1, 2) SELECT root_id, path, CASE WHEN ts IS NOT NULL AND (last_ts IS NULL OR ts > last_ts) THEN CASE WHEN t = 'removed' THEN 'missing' ELSE 'present' END ELSE availability END AS availability, CASE WHEN ts IS NOT NULL AND (last_ts IS NULL OR ts > last_ts) THEN ts ELSE last_ts END AS last_ts FROM k FULL JOIN l USING (root_id, path)")
def t4(spark, sf):
    e = fs_events(spark, sf)
    known = e.filter("event_id % 3 = 0").groupBy("root_id", "path").agg(F.lit("present").alias("availability"), F.min("ts").alias("last_ts"))
    return inventory.apply_events(known, e)


@query("l1_chunk_nodes")
def l1(spark, sf):
    return chunking.chunk_nodes(read_table(spark, sf, "documents").select(F.col("doc_id").alias("revision_id"), F.col("doc_id").alias("node_id"), F.lit(1).alias("ordinal"), "text"))


@query("l3_cap_tokens")
def l3(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", chunking.cap_tokens(F.col("text"), 100).alias("text"))


@query("h4_mmr")
def h4(spark, sf):
    found = bm25(spark, sf).select("query_id", "chunk_id", F.col("chunk_id").alias("file_id"), F.col("score").alias("fused"))
    return chunking.mmr_select(found.join(read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id"), 5)


RULES = [
    {"collection_id": "romance", "operator": "all", "extensions": ["FR", "es"], "min_size_bytes": 500},
    {"collection_id": "copies", "operator": "any", "filename_keywords": ["copy"], "parse_statuses": ["failed"], "exclude_extensions": ["en"]},
    {"collection_id": "none", "operator": "any"},
    {"collection_id": "every", "operator": "all", "exclude_path_keywords": ["node_modules"]},
]


@query("k1_apply_rules", f"WITH {FILES} SELECT 'romance' AS collection_id, file_id FROM files WHERE extension IN ('fr', 'es') AND size_bytes >= 500 UNION ALL SELECT 'copies', file_id FROM files WHERE (contains(lower(display_name), 'copy') OR parse_status = 'failed') AND extension != 'en' UNION ALL SELECT 'every', file_id FROM files WHERE NOT contains(lower(canonical_path), 'node_modules')")
def k1(spark, sf):
    return collections.apply_rules(files(spark, sf), RULES, "2024-02-01")


@query("k2_text_rules", f"WITH {CHUNKS}, g AS (SELECT file_id, bool_or(contains(lower(text), 'the')) AS i, bool_or(contains(lower(text), 'der ')) AS x, bool_or(contains(lower(text), 'license')) AS l FROM chunks GROUP BY 1) SELECT 'the' AS collection_id, file_id FROM g WHERE i AND NOT x UNION ALL SELECT 'law', file_id FROM g WHERE l")
def k2(spark, sf):
    return collections.apply_text_rules(chunks(spark, sf), [{"collection_id": "the", "text_keywords": ["The"], "exclude_text_keywords": ["der "]}, {"collection_id": "law", "text_keywords": ["license"]}])


@query("k3_rule_violations", "WITH r AS (SELECT p_partkey AS collection_id, CASE WHEN p_size % 3 != 0 THEN p_size * 100 - 200 END AS d, CASE WHEN p_size % 2 = 0 THEN p_size * 10 END AS lo, CASE WHEN p_size % 4 = 0 THEN 250 END AS hi FROM part) SELECT collection_id, problem FROM (SELECT collection_id, unnest([CASE WHEN d IS NULL AND lo IS NULL AND hi IS NULL THEN 'empty' END, CASE WHEN d < 1 OR d > 3650 THEN 'days' END, CASE WHEN lo > hi THEN 'sizes' END]) AS problem FROM r) WHERE problem IS NOT NULL")
def k3(spark, sf):
    p, s = read_table(spark, sf, "part"), F.col("p_size")
    return collections.rule_violations(p.select(F.col("p_partkey").alias("collection_id"), F.when(s % 3 != 0, s * 100 - 200).alias("modified_within_days"), F.when(s % 2 == 0, s * 10).alias("min_size_bytes"), F.when(s % 4 == 0, 250).alias("max_size_bytes"), F.array().cast("array<string>").alias("extensions")))


@query("k4_collection_counts", "SELECT o_orderpriority AS collection_id, count(DISTINCT o_custkey) AS files FROM orders GROUP BY 1")
def k4(spark, sf):
    return collections.collection_counts(read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("collection_id"), F.col("o_custkey").alias("file_id")))


@query("k6_suggestions", f"WITH {FILES}, s AS (SELECT n_nationkey AS suggestion_id, CASE WHEN n_nationkey % 5 = 0 THEN ' ' WHEN n_nationkey % 5 = 1 THEN 'doc 7_v2.en' ELSE n_name END AS name FROM nation), m AS (SELECT c_nationkey AS suggestion_id, c_custkey AS file_id FROM customer), g AS (SELECT suggestion_id, count(*) AS members, bool_and(f.file_id IS NOT NULL) AS known, bool_or(coalesce(lower(s.name) = lower(f.display_name), false)) AS same FROM m JOIN s USING (suggestion_id) LEFT JOIN files f ON f.file_id = m.file_id GROUP BY 1) SELECT suggestion_id, coalesce(members, 0) AS members, coalesce(trim(name) != '' AND members >= 2 AND known AND NOT same, false) AS valid FROM s LEFT JOIN g USING (suggestion_id)")
def k6(spark, sf):
    n = F.col("n_nationkey")
    s = read_table(spark, sf, "nation").select(n.alias("suggestion_id"), F.when(n % 5 == 0, " ").when(n % 5 == 1, "doc 7_v2.en").otherwise(F.col("n_name")).alias("name"))
    m = read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("suggestion_id"), F.col("c_custkey").alias("file_id"))
    return collections.suggestion_checks(s, m, files(spark, sf))


_TOKS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'))"
_NUMS = r"regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?')"


@query("e1_claim_support", f"WITH {CHUNKS}, f AS (SELECT file_id, min(ordinal) AS o FROM chunks GROUP BY 1), c AS (SELECT file_id, text AS claim FROM chunks JOIN f USING (file_id) WHERE ordinal = o), e AS (SELECT file_id, string_agg(text, chr(10) ORDER BY ordinal) AS evidence FROM chunks JOIN f USING (file_id) WHERE ordinal > o GROUP BY 1), j AS (SELECT *, regexp_replace(lower(claim), '\\s+', '', 'g') AS fc, regexp_replace(lower(evidence), '\\s+', '', 'g') AS fe, {_TOKS.format('claim')} AS t, {_TOKS.format('evidence')} AS te, {_NUMS.format('claim')} AS n, {_NUMS.format('evidence')} AS ne FROM c LEFT JOIN e USING (file_id)) SELECT file_id AS claim_id, coalesce((length(fc) >= 4 AND contains(fe, fc)) OR (len([x for x in n if NOT list_contains(ne, x)]) = 0 AND len(t) >= 3 AND len([x for x in t if list_contains(te, x)]) >= len(t) * 0.72), false) AS supported FROM j")
def e1(spark, sf):
    c = chunks(spark, sf)
    first = c.groupBy("file_id").agg(F.min("ordinal").alias("o"))
    c = c.join(first, "file_id").withColumnRenamed("file_id", "claim_id")
    return evidence.claim_support(c.filter("ordinal = o"), c.filter("ordinal > o"))


@query("e9_citations", "WITH b AS (SELECT l_orderkey AS answer_id, l_linenumber AS claim_id, [l_linenumber, l_suppkey % 8] AS cited, l_comment_len AS n FROM (SELECT *, l_partkey % 1200 AS l_comment_len FROM lineitem)), v AS (SELECT DISTINCT l_orderkey AS answer_id, l_linenumber AS evidence_id, l_suppkey % 10 AS file_id FROM lineitem), d AS (SELECT DISTINCT answer_id, claim_id, evidence_id FROM (SELECT answer_id, claim_id, unnest(cited) AS evidence_id FROM b)), u AS (SELECT answer_id, claim_id, count(*) FILTER (v.file_id IS NULL) AS unknown, count(*) FILTER (v.file_id = 3) AS unauthorised FROM d LEFT JOIN v USING (answer_id, evidence_id) GROUP BY 1, 2) SELECT answer_id, claim_id, unknown, unauthorised, n <= 1000 AND unknown = 0 AND unauthorised = 0 AS valid FROM b JOIN u USING (answer_id, claim_id)")
def e9(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "answer_id")
    c = li.select("answer_id", F.col("l_linenumber").alias("claim_id"), F.repeat(F.lit("x"), (F.col("l_partkey") % 1200).cast("int")).alias("text"), F.array(F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 8).alias("cited"))
    e = li.select("answer_id", F.col("l_linenumber").cast("long").alias("evidence_id"), (F.col("l_suppkey") % 10).alias("file_id"))
    return evidence.validate_citations(c, e, e.select("file_id").filter("file_id != 3"))


@query("e15_proposals", "WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS proposal_id, l_shipmode AS alias, CASE WHEN l_linenumber != 7 THEN l_suppkey END AS target_id, l_discount * 20 - 0.2 AS c FROM (SELECT *, ' Name ' || l_partkey % 50 AS l_shipmode FROM lineitem)), q AS (SELECT proposal_id, replace(lower(alias), ' ', '') AS key, target_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)) AS confidence, 'candidate' AS status FROM p WHERE target_id IS NOT NULL) SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY key, target_id ORDER BY confidence DESC, proposal_id) = 1")
def e15(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return evidence.dedup_proposals(li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("proposal_id"), F.concat(F.lit(" Name "), (F.col("l_partkey") % 50).cast("string")).alias("alias"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey")).alias("target_id"), (F.col("l_discount") * 20 - 0.2).alias("confidence")))


def memory(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    kinds = F.element_at(F.array(*map(F.lit, evidence.TRUST)), (k % 6 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("key"), k.alias("target_id"), F.when(k % 2 == 0, "confirmed").otherwise("candidate").alias("status"), kinds.alias("source_type"), F.lit(1).alias("hit_count"), k.alias("updated_at"))


@query("e17_merge_memory", "WITH m AS (SELECT o_custkey AS key, o_orderkey AS target_id, 6 - o_orderkey % 6 AS rank, CASE WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'candidate' END AS status, ['user_explicit', 'user_confirmed', 'user_selection', 'repeated_usage', 'document_inference', 'model_inference'][o_orderkey % 6 + 1] AS source_type FROM orders) SELECT key, target_id, CASE WHEN rank < 3 THEN 'candidate' ELSE status END AS status, source_type, count(*) OVER (PARTITION BY key) AS hit_count, target_id AS updated_at FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY rank DESC, target_id DESC) = 1")
def e17(spark, sf):
    m = memory(spark, sf)
    return evidence.merge_memory(m.filter("target_id % 5 < 3"), m.filter("target_id % 5 >= 3"))


@query("e18_stale_memory", f"WITH {FILES} SELECT o_orderkey AS memory_id, ['file', 'collection', 'entity'][o_orderkey % 3 + 1] AS target_type, o_custkey AS target_id, CASE WHEN (o_orderkey % 3 = 0 AND o_custkey NOT IN (SELECT file_id FROM files)) OR (o_orderkey % 3 = 1 AND o_custkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 20)) THEN 'stale' ELSE 'confirmed' END AS status FROM orders")
def e18(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("file", "collection", "entity"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    m = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("memory_id"), kind.alias("target_type"), F.col("o_custkey").alias("target_id"), F.lit("confirmed").alias("status"))
    return evidence.stale_memory(m, files(spark, sf), read_table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("collection_id")))


@query("e24_merge_answers", "WITH f AS (SELECT l_orderkey AS question_id, CAST(l_partkey % 5 AS VARCHAR) AS text, l_suppkey % 3 AS file_id, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY n, text, file_id) AS place, text, file_id FROM f")
def e24(spark, sf):
    return evidence.merge_sub_answers(read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("query_no"), F.lit(1).alias("rank"), (F.col("l_partkey") % 5).cast("string").alias("text"), (F.col("l_suppkey") % 3).alias("file_id")))


@query("q2_rag_metrics", "WITH c AS (SELECT l_linenumber % 3 = 0 AS refused, l_linenumber % 2 = 0 AS generated, l_partkey % 3 = 0 AS exp, l_suppkey % 4 AS bad, l_partkey % 5 = 0 AS cited, l_quantity::BIGINT AS claims, least(l_quantity::BIGINT, l_linenumber) AS ok, floor(l_extendedprice)::BIGINT AS ms FROM lineitem) SELECT round(sum(ok) / sum(claims), 6) AS citation_coverage, round(count(*) FILTER (cited AND generated AND NOT refused) / count(*) FILTER (generated AND NOT refused), 6) AS correctness, round(count(*) FILTER (refused AND exp) / count(*) FILTER (exp), 6) AS refusal_accuracy, round(count(*) FILTER (bad = 0) / count(*), 6) AS unauthorized_rejection, quantile_disc(ms, 0.95) AS p95_ms FROM c")
def q2(spark, sf):
    li, n = read_table(spark, sf, "lineitem"), F.col("l_linenumber")
    return evaluation.rag_metrics(li.select((n % 3 == 0).alias("refused"), (n % 2 == 0).alias("generated"), (F.col("l_partkey") % 3 == 0).alias("expected_refusal"), (F.col("l_suppkey") % 4).alias("unauthorized_citations"), (F.col("l_partkey") % 5 == 0).alias("expected_source_cited"), F.col("l_quantity").cast("long").alias("factual_claims"), F.least(F.col("l_quantity").cast("long"), n.cast("long")).alias("verified_claims"), F.floor("l_extendedprice").alias("elapsed_ms")))


@query("c14_job_violations", "WITH h AS (SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'paused' ELSE 'succeeded' END AS status, value / 50 AS progress, event_id % 11 AS processed, 9 AS total FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY seq) AS before FROM h) SELECT job_id, seq, problem FROM (SELECT job_id, seq, unnest([CASE WHEN before != status AND (before || '>' || status) NOT IN ('queued>running', 'running>paused', 'running>succeeded', 'running>failed', 'paused>running', 'paused>failed') THEN 'transition' END, CASE WHEN progress NOT BETWEEN 0 AND 1 THEN 'progress' END, CASE WHEN processed > total THEN 'counts' END]) AS problem FROM l) WHERE problem IS NOT NULL")
def c14(spark, sf):
    t = F.col("event_type")
    status = F.when(t == "click", "queued").when(t == "view", "running").when(t == "error", "failed").when(t == "purchase", "paused").otherwise("succeeded")
    return inventory.job_transition_violations(read_table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("value") / 50).alias("progress"), (F.col("event_id") % 11).alias("processed"), F.lit(9).alias("total")))


@query("p6_classify", "WITH r AS (SELECT o_orderkey AS file_id, o_orderkey % 3 AS t, o_orderkey % 10 / 10 AS s FROM orders WHERE o_orderkey % 5 != 0), p AS (SELECT o_orderkey AS file_id, o_orderkey % 4 AS t, o_orderkey % 17 / 17 AS s FROM orders WHERE o_orderkey % 7 != 0), j AS (SELECT file_id, r.t AS rt, r.s AS rs, p.t AS pt, p.s AS ps FROM r FULL JOIN p USING (file_id)) SELECT file_id, CASE WHEN rt = pt THEN rt WHEN ps >= CASE WHEN rt IS NULL THEN 0.65 ELSE 0.72 END THEN pt WHEN rs >= 0.5 THEN rt END AS document_type, round(CASE WHEN rt = pt THEN 0.6::DOUBLE + 0.4::DOUBLE * greatest(rs, ps) WHEN ps >= CASE WHEN rt IS NULL THEN 0.65 ELSE 0.72 END THEN ps WHEN rs >= 0.5 THEN rs END, 6) AS confidence FROM j")
def p6(spark, sf):
    o, k = read_table(spark, sf, "orders"), F.col("o_orderkey")
    score = lambda m, n: o.select(k.alias("file_id"), (k % m).alias("type"), (k % n / n).alias("score"))
    return profiles.classify_types(score(3, 10).filter("file_id % 5 != 0"), score(4, 17).filter("file_id % 7 != 0"))


@query("p7_stale_profiles", f"WITH {FILES} SELECT file_id, file_id % 6 = 1 OR file_id % 4 = 2 OR file_id % 9 = 5 AS stale FROM files")
def p7(spark, sf):
    f = files(spark, sf).select("file_id", (F.col("file_id") * 3).alias("revision_id"), F.col("content_sha256").alias("text_hash"))
    known = f.filter("file_id % 6 != 1").select("file_id", F.when(F.col("file_id") % 4 == 2, 0).otherwise(F.col("revision_id")).alias("revision_id"), F.when(F.col("file_id") % 9 != 5, F.col("text_hash")).alias("text_hash"))
    return profiles.stale_profiles(known.filter("file_id != 0").union(f.filter("file_id = 0")), f)


@query("r10_query_relations", f"WITH {FILES} SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS left_file_id, l_suppkey AS right_file_id, l_returnflag AS relation_type, l_linestatus AS review_status, a.display_name AS left_name, b.display_name AS right_name FROM (SELECT min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN files a ON a.file_id = l_partkey JOIN files b ON b.file_id = l_suppkey WHERE l_returnflag IN ('A', 'N') AND l_linestatus = 'O' ORDER BY edge_id LIMIT 50")
def r10(spark, sf):
    pick = lambda c, name: F.min(c).alias(name)
    e = read_table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(pick("l_partkey", "left_file_id"), pick("l_suppkey", "right_file_id"), pick("l_returnflag", "relation_type"), pick("l_linestatus", "review_status"))
    e = e.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), "left_file_id", "right_file_id", "relation_type", "review_status")
    return relations.query_relations(e, files(spark, sf), ["A", "N"], "O")


@query("q5_scorecard", "WITH t AS (SELECT o_custkey AS run_id, round(sum(greatest(0.0::DOUBLE, least(o_totalprice / 10000, 20.0::DOUBLE))), 6) AS total FROM orders GROUP BY 1), g AS (SELECT o_custkey AS run_id, coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderstatus = 'F'), '') AS failed_gates FROM orders GROUP BY 1) SELECT run_id, total, failed_gates, total >= 85 AND failed_gates = '' AS passed FROM t JOIN g USING (run_id)")
def q5(spark, sf):
    o = read_table(spark, sf, "orders").withColumnRenamed("o_custkey", "run_id")
    return evaluation.scorecard(o.select("run_id", (F.col("o_totalprice") / 10000).alias("score"), F.lit(20.0).alias("maximum")), o.select("run_id", F.col("o_orderpriority").alias("gate"), (F.col("o_orderstatus") != "F").alias("ok")))


@query("q11_metric_means", "SELECT event_type AS metric, round(avg(value), 6) AS mean, count(*) AS n, count(DISTINCT user_id) AS cases FROM events WHERE event_id % 6 != 0 GROUP BY 1")
def q11(spark, sf):
    v = F.when(F.col("event_id") % 12 == 0, float("nan")).when(F.col("event_id") % 6 != 0, F.col("value"))
    return evaluation.metric_means(read_table(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("metric"), v.alias("value")))


@query("q18_split_three", "SELECT doc_id, CASE WHEN doc_id % 256 % 10 < 6 THEN 'tuning' WHEN doc_id % 256 % 10 < 8 THEN 'development' ELSE 'hidden' END AS split FROM documents")
def q18(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", evaluation.split_three(F.conv(F.right(F.hex("doc_id"), F.lit(2)), 16, 10).cast("int")).alias("split"))


@query("q22_baseline", "SELECT o_orderkey AS case_id, (o_orderkey % 7 IN (o_custkey % 7, o_custkey % 5)) AND NOT o_orderkey % 3 IN (o_custkey % 7, o_custkey % 5) AS passed FROM orders WHERE o_orderkey % 10 != 0")
def q22(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return evaluation.baseline_check(read_table(spark, sf, "orders").select(k.alias("case_id"), F.array(k % 7).alias("expected"), F.array(k % 3).alias("forbidden"), F.array(c % 7, c % 5).alias("returned"), (k % 10 == 0).alias("requires_ocr")))


__all__ = ["QUERIES"]
