"""Registered queries on scores, verdicts, generated cases, topic groups and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import lexical, neighbours, scoring, topics
from docspark.plans.queries import query
from docspark.plans.recall_queries import file_profiles
from docspark.plans.tables import FILES, files
from docspark.sources.files import read_table
from docspark.storage import fresh_folder
from docspark.streaming import progress

METRICS = "recall mrr ndcg citation_coverage correctness refusal_accuracy unauthorized_rejection structured_rate relation_precision relation_recall type_accuracy parse_coverage embedding_coverage vector_coverage".split()


@query("q4_component_scores", f"""WITH m AS (SELECT s_suppkey AS run_id, {", ".join(f"(s_suppkey * {i + 3} % 21) / 20 AS {m}" for i, m in enumerate(METRICS))}, s_suppkey * 97 % 5000 + 1 AS sp, s_suppkey * 891 % 90000 + 1 AS ap, s_suppkey % 3 != 0 AS j, s_suppkey % 5 != 0 AS i, s_suppkey % 7 != 0 AS z, s_suppkey % 4 AS lv FROM supplier)
SELECT run_id, 'search_quality' AS component, round(20 * (0.4 * recall + 0.3 * mrr + 0.3 * ndcg) * CASE WHEN sp <= 2000 THEN 1 ELSE greatest(0.5, 2000 / sp) END, 6) AS earned, 20.0 AS maximum, '' AS failures FROM m
UNION ALL SELECT run_id, 'strict_rag', round(30 * (0.25 * citation_coverage + 0.25 * correctness + 0.15 * refusal_accuracy + 0.15 * unauthorized_rejection + 0.1 * structured_rate + 0.1 * CASE WHEN ap <= 30000 THEN 1 ELSE greatest(0.25, 30000 / ap) END), 6), 30.0, concat_ws(',', CASE WHEN citation_coverage < 1 THEN 'citation_coverage_below_hard_gate' END, CASE WHEN unauthorized_rejection < 1 THEN 'unauthorized_citation_rejection_below_hard_gate' END, CASE WHEN refusal_accuracy < 1 THEN 'refusal_accuracy_below_hard_gate' END, CASE WHEN correctness < 0.85 THEN 'factual_correctness_below_target' END) FROM m
UNION ALL SELECT run_id, 'relations_and_collections', round(10 * (0.45 * relation_precision + 0.4 * relation_recall + 0.15 * type_accuracy), 6), 10.0, concat_ws(',', CASE WHEN relation_precision < 0.85 THEN 'semantic_relation_precision_below_target' END, CASE WHEN relation_recall < 0.80 THEN 'semantic_relation_recall_below_target' END) FROM m
UNION ALL SELECT run_id, 'index_coverage', round(20 * (0.5 * parse_coverage + 0.3 * embedding_coverage + 0.2 * vector_coverage), 6), 20.0, '' FROM m
UNION ALL SELECT run_id, 'runtime_recovery_logging', CASE WHEN lv = 0 THEN 4.0 ELSE 0 END + CASE WHEN j THEN 2 ELSE 0 END + CASE WHEN i THEN 2 ELSE 0 END + CASE WHEN z THEN 1 ELSE 0 END, 10.0, concat_ws(',', CASE WHEN NOT j THEN 'nonrecoverable_background_jobs' END, CASE WHEN NOT i THEN 'index_key_mapping_inconsistent' END, CASE WHEN NOT z THEN 'files_outside_authorized_roots' END, CASE WHEN lv > 0 THEN 'runtime_log_privacy_violation' END, 'runtime_cancel_latency_not_measured') FROM m""")
def q4(spark, sf):
    k = F.col("s_suppkey")
    m = [((k * (i + 3) % 21) / 20).alias(name) for i, name in enumerate(METRICS)]
    return scoring.component_scores(read_table(spark, sf, "supplier").select(k.alias("run_id"), *m, (k * 97 % 5000 + 1).alias("search_p95_ms"), (k * 891 % 90000 + 1).alias("answer_p95_ms"), (k % 3 != 0).alias("jobs_ok"), (k % 5 != 0).alias("index_keys_ok"), (k % 7 != 0).alias("authorized_ok"), (k % 4).alias("log_violations")))


_CASE = "o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderpriority AS p FROM orders)"


@query("q6_case_verdicts", f"WITH {_CASE}, v AS (SELECT k AS case_id, concat_ws(',', CASE WHEN k % 2 = 0 AND NOT coalesce(s = 'F', FALSE) THEN 'source_correct' END, CASE WHEN k % 3 = 0 AND p != '1-URGENT' THEN 'intent_correct' END, CASE WHEN k % 5 = 0 THEN 'target_correct' END, CASE WHEN k % 4 != 0 AND NOT (c % 7 = k % 7 OR c % 5 = k % 7) THEN 'file_correct' END, CASE WHEN k % 6 < 2 AND (k % 6 = 1) != (c % 2 = 0) THEN 'evidence_found' END, CASE WHEN k % 6 = 1 AND c % 3 != 0 THEN 'answer_grounded' END) AS f FROM o) SELECT case_id, f = '' AS passed, f AS failed_fields FROM v")
def q6(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return scoring.case_verdicts(read_table(spark, sf, "orders").select(
        k.alias("case_id"), F.when(k % 2 == 0, "F").alias("expected_source"), F.col("o_orderstatus").alias("actual_source"), F.when(k % 3 == 0, "1-URGENT").alias("expected_intent"), F.col("o_orderpriority").alias("actual_intent"),
        F.when(k % 5 == 0, "a").alias("expected_type"), F.lit(None).cast("string").alias("actual_type"), F.when(k % 4 != 0, F.array(c % 7, c % 5)).alias("expected_file_ids"), F.array(k % 7).alias("actual_file_ids"),
        F.when(k % 6 < 2, k % 6 == 1).alias("expected_evidence"), (c % 2 == 0).alias("evidence_found"), (c % 3 == 0).alias("answer_grounded"),
    ))


_CODES = ["RAG_GENERATION_FAILED", "rerank_timeout", "no_route", "PARSER_BROKEN", "embedding_missing", "resolution_x", "disk_full"]


@query("q7_error_classes", f"WITH {_CASE}, v AS (SELECT k AS case_id, CASE WHEN k % 4 = 0 THEN ['retrieval', 'rerank_error', 'citation_error'][c % 3 + 1] END AS node, CASE WHEN k % 4 = 1 THEN ['generation_error', 'rerank_error', 'router_error', 'query_parse_error', 'chunk_retrieval_error', 'document_resolution_error', 'unknown'][c % 7 + 1] END AS code, k % 4 = 2 AS refused, c % 3 = 0 AS none, c % 5 = 0 AS bad FROM o) SELECT case_id, coalesce(CASE node WHEN 'retrieval' THEN 'chunk_retrieval_error' ELSE node END, code, CASE WHEN refused THEN CASE WHEN NOT none THEN 'no_evidence_error' END WHEN bad THEN 'citation_error' END) AS error FROM v")
def q7(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    return scoring.classify_errors(read_table(spark, sf, "orders").select(
        k.alias("case_id"), F.when(k % 4 == 0, F.array(F.lit("other"), pick(["retrieval", "reranking", "repair"], c % 3))).otherwise(F.array(F.lit("other"))).alias("failed_nodes"), F.when(k % 4 == 1, pick(_CODES, c % 7)).alias("error_code"),
        F.when((k % 4 == 2) & (c % 2 == 0), "rag_refusal").otherwise("generated").alias("answer_mode"), ((k % 4 == 2) & (c % 2 == 1)).alias("insufficient"), F.when(c % 3 == 0, False).alias("expected_evidence"), (c % 5 == 0).alias("unsupported"),
    ))


@query("q9_judge_cases", "WITH l AS (SELECT l_orderkey AS case_id, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS returned FROM lineitem WHERE l_orderkey % 11 != 0 GROUP BY 1), c AS (SELECT o_orderkey AS case_id, ['SEARCH', 'ASK', 'FILE_RELATION', 'SMART_COLLECTION'][o_orderkey % 4 + 1] AS feature, e, CASE WHEN o_custkey % 3 = 0 THEN 'version' END AS et, o_custkey FROM orders JOIN (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_linenumber % 3 != 2 OR l_linenumber = 7) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey), j AS (SELECT case_id, feature, e, coalesce(returned, []) AS r, et, returned IS NOT NULL AS seen, o_custkey % 2 = 0 AS g FROM c LEFT JOIN l USING (case_id)), m AS (SELECT *, list_min(list_filter([list_position(r, x) for x in e], lambda p: p > 0)) AS top, len(list_intersect(e, r)) AS b FROM j) SELECT case_id, feature, coalesce(CASE feature WHEN 'SEARCH' THEN top <= 5 WHEN 'ASK' THEN seen AND g AND b > 0 WHEN 'FILE_RELATION' THEN round(b / len(e), 6) = 1 AND et IS NOT DISTINCT FROM CASE WHEN seen THEN 'version' END ELSE round(b / len(e), 6) = 1 END, FALSE) AS passed, top, coalesce(round(b / len(e), 6), 0.0) AS recall, coalesce(round(b / nullif(len(r), 0), 6), 0.0) AS precision FROM m")
def q9(spark, sf):
    li, k, c = read_table(spark, sf, "lineitem"), F.col("o_orderkey"), F.col("o_custkey")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])  # seven an order at most
    per = li.groupBy("l_orderkey").agg(ordered.alias("returned"), F.collect_set(F.when((F.col("l_linenumber") % 3 != 2) | (F.col("l_linenumber") == 7), F.col("l_suppkey"))).alias("expected"))
    feature = F.element_at(F.array(*map(F.lit, ("SEARCH", "ASK", "FILE_RELATION", "SMART_COLLECTION"))), (k % 4 + 1).cast("int"))
    o = read_table(spark, sf, "orders").join(per, F.col("l_orderkey") == k)
    cases = o.select(k.alias("case_id"), feature.alias("feature"), "expected", F.when(c % 3 == 0, "version").alias("expected_type"))
    seen = o.filter(k % 11 != 0).select(k.alias("case_id"), "returned", F.lit("version").alias("returned_type"), (c % 2 == 0).alias("grounded"))
    return scoring.judge_cases(cases, seen)


@query("q13_search_cases", rf"""WITH {FILES}, f AS (SELECT file_id, display_name AS d, regexp_replace(display_name, '\.[^.]*$', '') AS stem, root_id || ' (' || extension || ')' AS title, text FROM files),
m AS (SELECT file_id, unnest(['full', 'partial', 'title', 'content', 'entity', 'type', 'typo', 'natural']) AS reason, unnest([stem, 'Doc', regexp_replace(title, '[()]', '', 'g'), list_filter([trim(regexp_replace(l, '\s+', ' ', 'g')) for l in regexp_split_to_array(text, '\r\n|\n|\r')], lambda x: length(x) BETWEEN 8 AND 120)[1], stem, stem || ' ' || split_part(d, '.', -1), left(stem, 1) || stem[3] || stem[2] || stem[4:], regexp_extract(text, '[A-Za-z]{{10,}}')]) AS query FROM f)
SELECT 'search-' || reason || '-' || file_id AS case_id, file_id, query, reason FROM m WHERE query != '' AND query IS NOT NULL""")
def q13(spark, sf):
    p = file_profiles(spark, sf).withColumn("title", F.regexp_replace("title", r"^(\S+) (\S+)$", "$1 ($2)")).withColumn("text", F.col("summary"))
    return scoring.search_cases(p)


@query("q15_relation_cases", f"WITH {FILES}, d AS (SELECT file_id AS l, lead(file_id) OVER (PARTITION BY content_sha256 ORDER BY file_id) AS r, 'exact_duplicate' AS e FROM files), n AS (SELECT file_id AS l, content_sha256 AS h, lead(file_id) OVER w AS r, lead(content_sha256) OVER w AS rh FROM files WINDOW w AS (ORDER BY file_id)), u AS (SELECT * FROM d WHERE r IS NOT NULL UNION ALL SELECT l, r, NULL FROM n WHERE r IS NOT NULL AND h != rh) SELECT CASE WHEN e IS NULL THEN 'relation-neg-' ELSE 'relation-dup-' END || l || '-' || r AS case_id, l AS left_id, r AS right_id, e AS expected FROM u")
def q15(spark, sf):
    return scoring.relation_cases(files(spark, sf), bucket=64)


@query("q16_no_evidence")
def q16(spark, sf):
    return scoring.no_evidence_cases(files(spark, sf), lexical.build_postings(read_table(spark, sf, "documents")))


def order_cases(spark, sf):
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(k.alias("case_id"), F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("intent"), F.concat(F.lit("b"), F.floor(k / 50).cast("string")).alias("batch_id"))


@query("q19_freeze_batches", "WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS file_id, o_orderpriority AS intent, (('0x' || left(sha256(concat_ws(chr(31), 'v1', o_custkey)), 8))::BIGINT % 4)::INT AS batch FROM orders), n AS (SELECT batch, intent, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT *, greatest(0, 40 - count(*) OVER w) * n / sum(n) OVER w AS sh FROM n WINDOW w AS (PARTITION BY batch)), q AS (SELECT *, floor(sh) + 1 AS whole, row_number() OVER (PARTITION BY batch ORDER BY sh - floor(sh) DESC, intent) AS turn FROM s), z AS (SELECT batch, intent, whole + (turn <= 40 - sum(whole) OVER (PARTITION BY batch))::INT AS quota FROM q), t AS (SELECT c.*, row_number() OVER (PARTITION BY batch, intent ORDER BY sha256(concat_ws(chr(31), 'v1', intent, case_id)), case_id) AS turn FROM c) SELECT case_id, file_id, intent, batch FROM t JOIN z USING (batch, intent) WHERE turn <= quota")
def q19(spark, sf):
    return scoring.freeze_batches(order_cases(spark, sf), 40, 4)


@query("q19_freeze_splits", """WITH c AS (SELECT o_orderkey AS case_id, o_custkey AS file_id, o_orderpriority AS intent, CASE WHEN o_orderkey % 10 < 7 THEN 'DEV' ELSE 'HOLDOUT' END AS split, (('0x' || left(sha256(concat_ws(chr(31), 'v2', o_custkey)), 8))::BIGINT % 4)::INT AS batch FROM orders),
d AS (SELECT * FROM c WHERE split = CASE WHEN batch < 3 THEN 'DEV' ELSE 'HOLDOUT' END), n AS (SELECT batch, intent, count(*) AS n FROM d GROUP BY 1, 2), s AS (SELECT *, greatest(0, 30 - count(*) OVER w) * n AS sh, sum(n) OVER w AS total FROM n WINDOW w AS (PARTITION BY batch)),
q AS (SELECT batch, intent, 1 + sh // total AS whole, row_number() OVER (PARTITION BY batch ORDER BY sh % total DESC, intent DESC) AS turn FROM s), z AS (SELECT batch, intent, whole + (turn <= 30 - sum(whole) OVER (PARTITION BY batch))::INT AS quota FROM q),
t AS (SELECT d.*, row_number() OVER (PARTITION BY batch, intent ORDER BY sha256(concat_ws(chr(31), 'v2', split, intent, case_id)), case_id) AS turn FROM d), k AS (SELECT case_id, file_id, intent, split, batch FROM t JOIN z USING (batch, intent) WHERE turn <= quota),
i AS (SELECT batch, 'v2-' || lower(any_value(split)) || '-' || lpad((CASE WHEN any_value(split) = 'DEV' THEN batch ELSE 0 END)::VARCHAR, 2, '0') || '-' || left(sha256(concat_ws(chr(31), 'v2', any_value(split), batch, string_agg(case_id::VARCHAR, chr(10) ORDER BY case_id::VARCHAR))), 12) AS batch_id FROM k GROUP BY batch) SELECT * FROM k JOIN i USING (batch)""")
def q19_splits(spark, sf):
    cases = order_cases(spark, sf).withColumn("split", F.when(F.col("case_id") % 10 < 7, "DEV").otherwise("HOLDOUT"))
    return scoring.freeze_splits(cases, 30, 3, "v2")


_DIGEST = """dg AS (SELECT 'b' || (o_orderkey // 50) AS batch_id, count(*) AS cases, sha256(string_agg('{"case_id":' || o_orderkey || ',"intent":"' || o_orderpriority || '"}', chr(10) ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1)"""


@query("q20_manifest_digests", f"WITH {_DIGEST} SELECT * FROM dg")
def q20(spark, sf):
    return scoring.manifest_digest(order_cases(spark, sf))


@query("q20_manifest_problems", f"WITH {_DIGEST}, z AS (SELECT *, regexp_extract(batch_id, '[0-9]+')::INT AS i FROM dg) SELECT batch_id, CASE WHEN cases != 50 THEN 'size' WHEN i % 3 = 0 THEN 'digest' ELSE 'id' END AS problem FROM z")
def q20_problems(spark, sf):
    cases = order_cases(spark, sf)
    i = F.regexp_extract("batch_id", "[0-9]+", 0).cast("int")
    manifests = scoring.manifest_digest(cases).select("batch_id", F.when(i % 3 == 0, "0").otherwise(F.col("digest")).alias("digest"))
    return scoring.validate_manifests(manifests, cases, 50)


@query("q21_ragas_samples", "WITH c AS (SELECT conv_id AS case_id, text AS user_input, 'gold ' || conv_id AS reference FROM conversations WHERE turn = 0 AND conv_id % 3 != 0), o AS (SELECT conv_id AS case_id, CASE WHEN conv_id % 5 = 0 THEN '' ELSE text END AS response FROM conversations WHERE turn = 1) SELECT case_id, user_input, response, '' AS contexts, reference FROM c JOIN o USING (case_id)")
def q21(spark, sf):
    c, k = read_table(spark, sf, "conversations"), F.col("conv_id")
    cases = c.filter("turn = 0").select(k.alias("case_id"), F.when(k % 3 != 0, "ASK").otherwise("SEARCH").alias("feature"), F.col("text").alias("question"), F.concat(F.lit("gold "), k.cast("string")).alias("gold"))
    seen = c.filter("turn = 1").select(k.alias("case_id"), F.when(k % 5 != 0, F.col("text")).alias("answer"), F.lit(None).cast("array<string>").alias("contexts"))
    return scoring.ragas_samples(cases, seen).withColumn("contexts", F.array_join("contexts", "|"))


@query("q23_log_privacy", "SELECT count(DISTINCT user_id % 10) AS files, count(*) AS events, count(*) FILTER (event_id % 7 IN (1, 2, 3, 5)) AS violations FROM events WHERE event_id % 7 != 6")
def q23(spark, sf):
    k, p = F.col("event_id") % 7, F.col("props")
    line = F.when(k == 1, F.concat(F.lit('{"a": {"FilePath": 1}, "p": '), p, F.lit("}"))).when(k == 2, F.lit('{"v": ["x", "see C:\\\\docs"]}')).when(k == 3, F.lit('{"v": "\\\\\\\\host\\\\share"}')).when(k == 4, F.lit('{"v": "a path: b", "n": [1]}')).when(k == 5, F.concat(p, F.lit("}"))).when(k == 6, F.lit("  ")).otherwise(p)
    return scoring.log_privacy(read_table(spark, sf, "events").select((F.col("user_id") % 10).alias("file"), line.alias("line")))


def bucketed(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("file_id"), F.col("label").alias("bucket"), F.col("embedding").alias("vector"))


_PAIRS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("r4_semantic_pairs", f"SELECT a.vec_id AS left_file_id, b.vec_id AS right_file_id, {_PAIRS} AS confidence FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_PAIRS} >= 0.3")
def r4(spark, sf):
    return topics.semantic_pairs(bucketed(spark, sf), 0.3, part=256)


def groups(spark, sf):
    p = bucketed(spark, sf)
    return topics.seed_expand_groups(p, p.filter("file_id % 13 = 0"), 0.25, 5)


_GROUPS = f"""v AS (SELECT vec_id AS id, label AS b, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 13 != 0),
a AS (SELECT x.id, x.b, y.id AS o, list_cosine_similarity(x.e, y.e) AS c FROM v x JOIN v y ON x.b = y.b AND x.id != y.id), n AS (SELECT id, round(avg(c), 6) AS mean FROM a GROUP BY 1), p AS (SELECT id, b, o, round(c, 6) AS s FROM a WHERE round(c, 6) >= 0.25),
o AS (SELECT id, b, nb, row_number() OVER (PARTITION BY b ORDER BY best DESC, mean DESC, id) AS turn FROM (SELECT id, b, max(s) AS best, list(o ORDER BY s DESC, o) AS nb FROM p GROUP BY 1, 2) JOIN n USING (id)),
r AS (SELECT DISTINCT b, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS seed, []::BIGINT[] AS got FROM o UNION ALL
  SELECT b, turn, CASE WHEN ok THEN list_concat(taken, list_concat([id], free)) ELSE taken END, CASE WHEN ok THEN id END, CASE WHEN ok THEN free ELSE [] END
  FROM (SELECT *, NOT list_contains(taken, id) AND len(free) > 0 AS ok FROM (SELECT r.b, o.turn, r.taken, o.id, list_filter(o.nb, lambda x: NOT list_contains(r.taken, x))[1:5] AS free FROM r JOIN o ON o.b = r.b AND o.turn = r.turn + 1))),
m AS (SELECT seed, unnest(got) AS file FROM r WHERE seed IS NOT NULL),
g AS (SELECT seed AS seed_file_id, file AS file_id, s AS similarity, ((2 * sum(round(s * 1000000)::BIGINT) OVER w + count(*) OVER w) // (2 * count(*) OVER w)) / 1000000 AS confidence FROM m JOIN p ON p.id = seed AND p.o = file WINDOW w AS (PARTITION BY seed))"""


@query("r9_seed_groups", f"WITH RECURSIVE {_GROUPS} SELECT * FROM g")
def r9(spark, sf):
    return groups(spark, sf)


@query("k7_suggestions", f"""WITH RECURSIVE {_GROUPS}, f AS (SELECT seed_file_id, file_id FROM g UNION SELECT seed_file_id, seed_file_id FROM g), t AS (SELECT DISTINCT seed_file_id, confidence FROM g WHERE seed_file_id NOT IN (SELECT seed_file_id FROM f WHERE file_id % 17 = 0)),
k AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, seed_file_id) AS place FROM t QUALIFY place <= 20)
SELECT place, k.seed_file_id, f.file_id, coalesce(similarity, k.confidence) AS confidence, CASE WHEN f.file_id = k.seed_file_id THEN 'seed' ELSE 'similar to the seed' END AS reason FROM k JOIN f USING (seed_file_id) LEFT JOIN g ON g.seed_file_id = k.seed_file_id AND g.file_id = f.file_id""")
def k7(spark, sf):
    used = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id")).filter("file_id % 17 = 0")
    return topics.refresh_suggestions(groups(spark, sf), used)[0]


@query("v6_topk_lsh")
def v6(spark, sf):
    e = read_table(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the stated query set
    return topics.vector_topk_lsh(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10, 64)


@query("v6_topk_cells")
def v6_cells(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = fresh_folder(spark, "index")
    neighbours.write_index(e, path, 64)
    return neighbours.search_index(spark, path, e.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 64, 10)  # the stated query set


@query("h9_rerank", rf"WITH t AS (SELECT doc_id AS chunk_id, source AS query_id, text, -abs(length(text) - 500) / 100 AS x FROM documents) SELECT query_id, chunk_id, round(1 / (1 + exp(-greatest(-30, least(30, x)))), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-greatest(-30, least(30, x)))), 6) DESC, chunk_id) AS place FROM t")
def h9(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("query_id"), F.col("source").alias("query"), "text")
    return topics.rerank(d, lambda q, t: [-abs(len(x) - 500) / 100 for x in t]).drop("query", "text")


_ASKS = ["ask_started", "node_started", "node_progress", "node_completed", "node_failed", "node_skipped", "answer_delta", "ask_completed"]
_NODE = "event_type IN ('node_started', 'node_progress', 'node_completed', 'node_failed', 'node_skipped')"


@query("t5_ask_progress", f"""WITH e AS (SELECT user_id AS op, event_id AS arrival, event_id - CASE WHEN event_id % 9 = 4 THEN 3000 ELSE 0 END AS seq, {_ASKS}[CASE WHEN event_id % 97 = 0 THEN 1 ELSE event_id % 53 % 7 + 2 END] AS event_type, 'n' || event_id % 4 AS node_id, CASE WHEN event_id % 6 != 1 THEN event_id % 500 END AS dur, event_type AS delta, CASE WHEN event_id % 5 = 0 THEN 'failed' END AS st FROM events),
a AS (SELECT * FROM e QUALIFY seq > coalesce(max(seq) OVER (PARTITION BY op ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000)), s AS (SELECT * FROM a QUALIFY seq >= coalesce(max(CASE WHEN event_type = 'ask_started' THEN seq END) OVER (PARTITION BY op), -1000000)),
n AS (SELECT op, node_id, arg_max(CASE event_type WHEN 'node_completed' THEN 'completed' WHEN 'node_failed' THEN 'failed' WHEN 'node_skipped' THEN 'skipped' ELSE 'running' END, seq) AS st, max(seq) FILTER (event_type = 'node_started') AS b, max(seq) FILTER (event_type IN ('node_completed', 'node_failed', 'node_skipped')) AS x, list(CASE WHEN event_type IN ('node_completed', 'node_failed', 'node_skipped') THEN dur END ORDER BY seq DESC) FILTER (event_type IN ('node_started', 'node_completed', 'node_failed', 'node_skipped'))[1] AS took FROM s WHERE {_NODE} GROUP BY 1, 2),
p AS (SELECT op, count(*) FILTER (st != 'skipped') AS steps, string_agg(node_id || ':' || st, ',' ORDER BY node_id) AS nodes, coalesce(string_agg(node_id || ':' || took, ',' ORDER BY node_id), '') AS durations FROM n GROUP BY 1), l AS (SELECT op, node_id, b, x FROM n WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY op ORDER BY b DESC) = 1),
w AS (SELECT op, max(seq) AS last_sequence, arg_max(coalesce(st, 'completed'), seq) FILTER (event_type = 'ask_completed') AS final, max(seq) FILTER (event_type = 'ask_completed') AS c, coalesce(string_agg(delta, '' ORDER BY seq) FILTER (event_type = 'answer_delta'), '') AS answer FROM s GROUP BY 1)
SELECT w.op::VARCHAR AS operation_id, CASE WHEN c IS NOT NULL AND c > coalesce(b, -1000000) THEN final WHEN b IS NOT NULL THEN 'running' ELSE 'started' END AS status, coalesce(steps, 0) AS steps, CASE WHEN b > coalesce(x, -1000000) AND b > coalesce(c, -1000000) THEN node_id END AS active_node, answer, last_sequence, coalesce(nodes, '') AS nodes, coalesce(durations, '') AS durations FROM w LEFT JOIN p USING (op) LEFT JOIN l USING (op)""")
def t5(spark, sf):
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _ASKS)), F.when(i % 97 == 0, 1).otherwise(i % 53 % 7 + 2).cast("int"))
    e = read_table(spark, sf, "events").select(
        F.col("user_id").alias("operation_id"), i.alias("arrival"), (i - F.when(i % 9 == 4, 3000).otherwise(0)).alias("sequence"), kind.alias("event_type"), F.concat(F.lit("n"), (i % 4).cast("string")).alias("node_id"),
        F.when(i % 6 != 1, i % 500).alias("duration_ms"), F.col("event_type").alias("delta"), F.when(i % 5 == 0, "failed").alias("status"),
    )
    return progress.ask_progress(e)
