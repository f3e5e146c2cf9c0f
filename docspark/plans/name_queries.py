"""Registered queries on names, entities, profiles, traces and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions.text import normalize_terms
from docspark.operators import extraction, names, profiles, relations, traces, vectors
from docspark.plans.queries import TERM_SQL, query
from docspark.plans.tables import CHUNKS, FILES, chunks, files
from docspark.sources.files import read_table


_HEX = "length(regexp_replace({}, '[^0-9a-fA-F]', '', 'g'))"


@query("e2_noise_flags", rf"SELECT doc_id, regexp_matches(lower(text), '\\rtf|\\ansi|\\fonttbl') OR length(regexp_replace(text, '[^\\{{}};]', '', 'g')) * 5 > greatest(length(text), 1) OR len(regexp_extract_all(text, '\\[A-Za-z]{{2,}}')) >= 3 AS markup, len([t for t in regexp_split_to_array(text, '[\s=:,]') if {_HEX.format('t')} >= 48]) > 0 OR ({_HEX.format('text')} * 4 > length(text) * 3 AND length(text) >= 80) AS opaque FROM documents")
def e2(spark, sf):
    markup, opaque = extraction.noise_flags(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", markup.alias("markup"), opaque.alias("opaque"))


_STOP = ", ".join(f"'{w}'" for w in names.STOP_WORDS)


@query("e4_query_entities", f"WITH t AS (SELECT conv_id, turn, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM (SELECT conv_id, turn, regexp_extract_all(text, '[0-9A-Za-z]+') AS l FROM conversations)), g AS (SELECT conv_id, turn, lower(w) AS entity, min(p) AS p FROM t WHERE length(w) >= 2 AND NOT regexp_matches(lower(w), '^([0-9]+(e[0-9]+)?|inf|infinity|nan)$') AND lower(w) NOT IN ({_STOP}) GROUP BY 1, 2, 3) SELECT conv_id, turn, entity, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) AS place FROM g QUALIFY place <= 8")
def e4(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(names.query_entities(F.col("text"))).alias("pos", "entity"))
    return c.select("conv_id", "turn", "entity", (F.col("pos") + 1).alias("place"))


@query("e12_entity_like", f"WITH {CHUNKS} SELECT chunk_id, length(text) <= 60 AND NOT regexp_matches(text, '[。；！？;!?、]') AND length(regexp_replace(text, '[^，,]', '', 'g')) <= 1 AS entity_like FROM chunks")
def e12(spark, sf):
    return chunks(spark, sf).select("chunk_id", names.entity_like(F.col("text")).alias("entity_like"))


@query("e16_resolve_names", "WITH n AS (SELECT replace(lower(name), ' ', '') AS key, type, id FROM (SELECT n_name AS name, 'entity' AS type, n_nationkey AS id, 0 AS p FROM nation UNION ALL SELECT c_name, 'file', c_custkey, 1 FROM customer UNION ALL SELECT r_name, 'collection', r_regionkey, 2 FROM region) QUALIFY row_number() OVER (PARTITION BY key ORDER BY p, id) = 1), p AS (SELECT o_orderkey AS proposal_id, CASE WHEN o_orderkey % 3 = 0 THEN 'alias' ELSE 'relation' END AS kind, 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') AS s, ['nation_1', 'nobody', 'africa', 'nation_2'][o_orderkey % 4 + 1] AS o FROM orders) SELECT proposal_id, kind, a.type AS subject_type, a.id AS subject_id, b.type AS object_type, b.id AS object_id FROM p JOIN n a ON a.key = s JOIN n b ON b.key = CASE WHEN kind = 'alias' THEN s ELSE o END")
def e16(spark, sf):
    k, named = F.col("o_orderkey"), lambda t, i, n: read_table(spark, sf, t).select(F.col(i).alias("id"), F.col(n).alias("name"))
    p = read_table(spark, sf, "orders").select(k.alias("proposal_id"), F.when(k % 3 == 0, "alias").otherwise("relation").alias("kind"), F.concat(F.lit(" CUSTOMER #"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("subject"), F.element_at(F.array(*map(F.lit, ("Nation _1", "nobody", "Africa ", "NATION_2"))), (k % 4 + 1).cast("int")).alias("object"))
    return names.resolve_names(p, named("nation", "n_nationkey", "n_name"), named("customer", "c_custkey", "c_name"), named("region", "r_regionkey", "r_name"))


@query("l10_name_search", f"WITH {FILES}, q AS (SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN 'doc ' || item_id WHEN 1 THEN 'dooc ' || item_id || ' copy' WHEN 2 THEN item_id % 100 || '_v' ELSE 'tmp_ca' END AS q FROM benchmark), f AS (SELECT file_id, lower(display_name) AS name, lower(canonical_path) AS path FROM files), j AS (SELECT query_id, file_id, CASE WHEN contains(name, q) THEN 'filename' WHEN contains(path, q) THEN 'path' END AS c, levenshtein(q, regexp_replace(name, '\\.[^.]*$', '')) <= 1 AND NOT contains(name, q) AS z FROM q, f) SELECT query_id, file_id, c AS channel FROM j WHERE c IS NOT NULL UNION ALL SELECT query_id, file_id, 'filename_fuzzy' FROM j WHERE z")
def l10(spark, sf):
    i = F.col("item_id").cast("string")
    text = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Doc "), i)).when(F.col("item_id") % 4 == 1, F.concat(F.lit("dooc "), i, F.lit(" copy"))).when(F.col("item_id") % 4 == 2, F.concat((F.col("item_id") % 100).cast("string"), F.lit("_v"))).otherwise("tmp_ca")
    return names.name_search(read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text")), files(spark, sf))


@query("k5_keyword_collections", f"WITH {CHUNKS}, w AS (SELECT DISTINCT doc_id AS file_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS keyword FROM documents), o AS (SELECT DISTINCT keyword, file_id FROM w JOIN chunks c USING (file_id) WHERE length(keyword) >= 3 AND NOT regexp_matches(keyword, '^[0-9]+$') AND contains(lower(c.text), keyword)) SELECT keyword, file_id, count(*) OVER (PARTITION BY keyword) AS members FROM o QUALIFY members >= 2")
def k5(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    return names.keyword_collections(read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), words.alias("keywords")), chunks(spark, sf))


@query("p1_section_titles", "WITH t AS (SELECT conv_id AS doc_id, role || ' ' || turn % 3 AS title, min(turn) AS p FROM conversations WHERE turn % 5 != 4 GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, title) AS place, title FROM t QUALIFY place <= 64")
def p1(spark, sf):
    c = read_table(spark, sf, "conversations")
    path = F.when(F.col("turn") % 5 == 4, '["cut').otherwise(F.to_json(F.array(F.lit("root"), F.concat(F.lit(" "), "role", F.lit(" "), (F.col("turn") % 3).cast("string")))))
    return names.section_titles(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), path.alias("heading_path")))


@query("p3_representative", r"WITH c AS (SELECT doc_id, source, lang, substr(trim(regexp_replace(text, '[\s\x{A0}\x{3000}]+', ' ', 'g')), 1, 260) AS h FROM documents) SELECT doc_id, sha256(trim(regexp_replace(concat_ws(' || ', source, lang || '；a b', nullif(h, '')), '[\s\x{A0}\x{3000}]+', ' ', 'g'))) AS text_hash FROM c")
def p3(spark, sf):
    text = names.representative_text(F.col("source"), F.array(F.col("lang"), F.lit(" a \n b")), F.col("text"), F.lit(None).cast("string"), F.lit(" "))
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("text_hash"))


def embedded(spark, sf):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"), "label", F.col("embedding").alias("vector"))


@query("p5_prototype_scores", "WITH d AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM d GROUP BY 1, 2), p AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1) SELECT vec_id AS file_id, p.label AS type, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS score FROM embeddings, p WHERE TRUE QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, p.label) = 1 AND score >= 0.1")
def p5(spark, sf):
    e = embedded(spark, sf)
    return profiles.type_prototype_scores(e, vectors.mean_vector(e, "label", "vector").select(F.col("label").alias("type"), F.col("mean").alias("vector")), 0.1)


@query("p10_semantic_recall", "SELECT q.vec_id AS query_id, v.vec_id AS id, round((1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round((1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2, 6) DESC, v.vec_id) AS place FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY place <= 40 AND score >= 0.62")
def p10(spark, sf):
    e = embedded(spark, sf)
    return profiles.semantic_recall(e.filter("file_id % 20 = 0").select(F.col("file_id").alias("query_id"), "vector"), e.select(F.col("file_id").alias("id"), "vector"))


@query("r5_containment", f"WITH t AS (SELECT doc_id, list_sort(list_distinct({TERM_SQL})) AS t FROM documents), s AS (SELECT min(doc_id) AS doc_id, t FROM t WHERE len(t) > 0 GROUP BY t), x AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM s) SELECT a.doc_id AS left_file_id, b.doc_id AS right_file_id, round(count(*) / any_value(a.n), 6) AS confidence FROM x a JOIN x b USING (w) WHERE b.n > a.n GROUP BY 1, 2 HAVING round(count(*) / any_value(a.n), 6) >= 0.9")
def r5(spark, sf):
    return relations.containment_pairs(read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.array_distinct(normalize_terms(F.col("text"))).alias("terms")))


@query("r5_containment_members", f"WITH t AS (SELECT doc_id, list_sort(list_distinct({TERM_SQL})) AS t FROM documents) SELECT doc_id AS file_id, min(doc_id) OVER (PARTITION BY t) AS representative FROM t WHERE len(t) > 0")
def r5_members(spark, sf):
    return relations.containment_members(read_table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.array_distinct(normalize_terms(F.col("text"))).alias("terms")))


@query("r8_version_roles", "WITH e AS (SELECT label AS group_id, vec_id AS file_id, embedding::DOUBLE[] AS v, vec_id * 7919 % 1009 AS m FROM embeddings), n AS (SELECT group_id, arg_max(file_id, m * 100000000 + file_id) AS f, arg_max(v, m * 100000000 + file_id) AS nv FROM e GROUP BY 1) SELECT group_id, file_id, CASE WHEN file_id = f THEN 'latest' WHEN round(list_cosine_similarity(v, nv), 6) >= 0.99 THEN 'copy' ELSE 'version' END AS role FROM e JOIN n USING (group_id)")
def r8(spark, sf):
    e = embedded(spark, sf)
    return relations.version_roles(e.select(F.col("label").alias("group_id"), "file_id"), e.select("file_id", (F.col("file_id") * 7919 % 1009).alias("modified_at")), e)


STAGES = ["view", "click", "error", "purchase"]


@query("o2_trace_view", f"WITH s AS (SELECT {STAGES} AS s) SELECT 'op' || user_id AS operation_id, row_number() OVER (PARTITION BY user_id ORDER BY list_position(s, event_type), ts, event_id) AS place, event_type AS node, event_id AS record_id FROM events, s WHERE list_contains(s, event_type)")
def o2(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("correlation_id"), F.col("event_type").alias("node"), "ts", F.col("event_id").alias("record_id"))
    return traces.trace_view(e, e.select("correlation_id").distinct().withColumn("operation_id", F.concat(F.lit("op"), F.col("correlation_id").cast("string"))), STAGES)


@query("o3_query_logs", "SELECT event_id AS record_id, user_id, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def o3(spark, sf):
    e = read_table(spark, sf, "events").withColumnRenamed("event_id", "record_id")
    return traces.query_logs(e, {"event_type": "error"}, page=1).select("record_id", "user_id", "total")


@query("o4_ocr_routing", rf"WITH {CHUNKS}, l AS (SELECT file_id AS asset_id, ordinal // 10 AS page, CASE WHEN file_id % 2 = 0 THEN 'pdf_scanned_page' ELSE 'image' END AS kind, text, CASE WHEN file_id % 9 != 0 THEN (ordinal + file_id) % 8 / 8 END AS c FROM chunks), g AS (SELECT asset_id, page, min(kind) AS kind, count(*) AS n, sum(length(text)) AS chars, sum(length(regexp_replace(text, '[\s\x{{A0}}\x{{3000}}]', '', 'g'))) AS k, sum(length(regexp_replace(text, '\P{{Nd}}', '', 'g'))) AS d, avg(c) AS m FROM l GROUP BY 1, 2), r AS (SELECT asset_id, page, CASE WHEN chars = 0 THEN 'ocr_no_text' WHEN m IS NULL THEN 'ocr_confidence_missing' WHEN m < 0.45 THEN 'ocr_low_confidence' END AS fallback, CASE WHEN kind != 'pdf_scanned_page' AND k < 48 THEN 'complex_sparse_text' WHEN n >= 3 AND d / greatest(k, 1) >= 0.2 AND k <= 600 THEN 'complex_chart_like' WHEN n >= 4 AND chars / n <= 12 AND k <= 400 THEN 'complex_layout' END AS complexity FROM g) SELECT *, fallback IS NOT NULL OR complexity IS NOT NULL AS needs_vision FROM r")
def o4(spark, sf):
    f, o = F.col("file_id"), F.col("ordinal")
    kind = F.when(f % 2 == 0, "pdf_scanned_page").otherwise("image")
    return traces.ocr_routing(chunks(spark, sf).select(f.alias("asset_id"), F.floor(o / 10).alias("page"), kind.alias("kind"), "text", F.when(f % 9 != 0, (o + f) % 8 / 8).alias("confidence")))


PRIORITIES = ["4-NOT SPECIFIED", "1-URGENT", "3-MEDIUM", "2-HIGH", "other"]


@query("q12_failures", f"WITH r AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE o_orderpriority END AS category, CASE WHEN o_custkey % 4 != 0 THEN 'd' || o_custkey END AS d FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT category, count(*) AS failed, round(count(*) * 100 / (SELECT count(*) FROM orders), 6) AS rate FROM r GROUP BY 1), s AS (SELECT category, string_agg(d, '; ' ORDER BY case_id) AS diagnoses FROM (SELECT * FROM r WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY case_id) <= 3) GROUP BY 1) SELECT category, failed, rate, diagnoses, row_number() OVER (ORDER BY list_position({PRIORITIES}, category)) <= 3 AS top FROM n LEFT JOIN s USING (category)")
def q12(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return traces.analyze_failures(read_table(spark, sf, "orders").select(k.alias("case_id"), (k % 3 != 0).alias("passed"), F.col("o_orderpriority").alias("category"), F.when(c % 4 != 0, F.concat(F.lit("d"), c.cast("string"))).alias("diagnosis")), PRIORITIES)
