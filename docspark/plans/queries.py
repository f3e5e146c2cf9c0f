"""Registered queries over the supplied tables, with their oracles in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import catalog, evaluation, hybrid, incremental, lexical, relations, stored_index, vectors
from docspark.plans.tables import CHUNKS, EVENTS, FILES, HITS, KEY, chunks, files, fs_events, hits
from docspark.sources.files import read_table
from docspark.storage import fresh_folder

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


TERM_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("x3_text_lines", f"WITH {CHUNKS} SELECT file_id AS doc_id, ordinal, 'paragraph' AS node_type, text FROM chunks")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.text_lines_to_nodes(read_table(spark, sf, "documents"))


@query("l2_token_estimate", r"SELECT doc_id, greatest(1, ceil(length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) * 0.25 + length(regexp_replace(text, '[0-9A-Za-z\s]', '', 'g'))))::BIGINT AS tokens FROM documents")
def l2(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("l4_normalize_terms", f"SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest({TERM_SQL}) AS t FROM documents) GROUP BY 1, 2")
def l4(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.explode(T.normalize_terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query("l5_script_l6_hash", "SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS script, sha256(text) AS content_hash FROM documents")
def l5(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.detect_script(F.col("text")).alias("script"), T.content_hash(F.col("text")).alias("content_hash"))


@query("l7_postings_summary", f"WITH t AS (SELECT doc_id, unnest({TERM_SQL}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY 1")
def l7(spark, sf):
    return lexical.build_postings(read_table(spark, sf, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


_QT = f"qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({TERM_SQL}) AS term FROM benchmark) WHERE length(term) > 1)"


@query("l8_query_terms", f"WITH {_QT} SELECT * FROM qt")
def l8(spark, sf):
    return lexical.query_terms(read_table(spark, sf, "benchmark"), "item_id")


_BM25 = f"""
{_QT}, p AS (SELECT term, doc_id AS chunk_id, count(*) AS tf FROM (SELECT doc_id, unnest({TERM_SQL}) AS term FROM documents) GROUP BY 1, 2),
s AS (SELECT chunk_id, sum(tf) AS len FROM p GROUP BY 1), z AS (SELECT count(*) AS n, avg(len) AS mean FROM s), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
m AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS s
      FROM qt JOIN p USING (term) JOIN d USING (term) JOIN s USING (chunk_id), z GROUP BY 1, 2),
bm AS (SELECT query_id, chunk_id, round(s / (1 + s), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s / (1 + s), 6) DESC, chunk_id) AS place FROM m QUALIFY place <= 10)
"""


def bm25(spark, sf):
    return lexical.bm25_search(lexical.query_terms(read_table(spark, sf, "benchmark"), "item_id"), read_table(spark, sf, "documents"), 10)


QUERIES["l9_bm25"], ORACLES["l9_bm25"] = bm25, f"WITH {_BM25} SELECT * FROM bm"


@query("l9_stored_index", f"WITH {_BM25} SELECT * FROM bm")
def l9_stored(spark, sf):
    index = stored_index.write_index(read_table(spark, sf, "documents"), fresh_folder(spark, "index"))
    return stored_index.search_index(index, lexical.query_terms(read_table(spark, sf, "benchmark"), "item_id"), 10)


_NOW = "d2 AS (SELECT doc_id, CASE WHEN doc_id % 7 != 3 AND doc_id % 13 = 0 THEN text || ' ' || source ELSE text END AS text FROM documents WHERE doc_id % 7 = 3 OR doc_id % 11 != 0)"


@query("l9_updated_index", f"WITH {_NOW}, {_BM25.replace('FROM documents', 'FROM d2')} SELECT * FROM bm")
def l9_updated(spark, sf):
    """An index of an earlier listing, updated by what ``snapshot_diff`` finds: some files are new, some changed, some gone."""
    docs, k = read_table(spark, sf, "documents").select("doc_id", "text", "source"), F.col("doc_id")
    before = docs.filter(k % 7 != 3)
    now = docs.filter((k % 7 == 3) | (k % 11 != 0)).withColumn("text", F.when((k % 7 != 3) & (k % 13 == 0), F.concat_ws(" ", "text", "source")).otherwise(F.col("text")))
    listing = lambda d: d.select(k.alias("file_key"), k.cast("string").alias("path"), F.sha2("text", 256).alias("content_sha256"), F.lit(True).alias("present"))
    changes = incremental.snapshot_diff(listing(before), listing(now)).select(F.col("file_key").alias("chunk_id"), "change")
    index = stored_index.write_index(before, fresh_folder(spark, "index"))
    index = stored_index.update_index(index, changes, now)
    return stored_index.search_index(index, lexical.query_terms(read_table(spark, sf, "benchmark"), "item_id"), 10)


@query("l11_neighbor_context", f"WITH {CHUNKS} SELECT c.file_id, c.ordinal, left(b.text, 40) AS before, left(a.text, 40) AS after FROM chunks c LEFT JOIN chunks b ON b.file_id = c.file_id AND b.ordinal = c.ordinal - 1 LEFT JOIN chunks a ON a.file_id = c.file_id AND a.ordinal = c.ordinal + 1 WHERE c.text LIKE '%a%'")
def l11(spark, sf):
    c = chunks(spark, sf)
    return catalog.neighbor_context(c.filter("contains(text, 'a')").select("file_id", "ordinal"), c, 40)


@query("v1_l2_normalize", "SELECT vec_id, round(list_sum([x * x for x in v]), 6) AS square, round(v[1], 6) AS first FROM (SELECT vec_id, [x / nrm for x in u] AS v FROM (SELECT vec_id, u, greatest(sqrt(list_sum([y * y for y in u])), 1e-12) AS nrm FROM (SELECT vec_id, [z::DOUBLE * (vec_id + 1) for z in embedding] AS u FROM embeddings)))")
def v1(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("vector"))
    n = vectors.l2_normalize(e)
    return n.select("vec_id", F.round(vectors.dot(F.col("vector"), F.col("vector")), 6).alias("square"), F.round(F.col("vector")[0], 6).alias("first"))


@query("v2_validate_vectors", "SELECT vec_id AS id, CASE WHEN vec_id = 0 THEN 'key' ELSE 'dimension' END AS problem FROM embeddings WHERE vec_id = 0 OR vec_id % 9 = 4")
def v2(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return vectors.validate_vectors(e.withColumn("embedding", F.when(F.col("vec_id") % 9 == 4, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))), "vec_id", "embedding", 64)


@query("v3_mean_vector", "SELECT label, i AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY 1, 2")
def v3(spark, sf):
    m = vectors.mean_vector(read_table(spark, sf, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("mean").alias("pos", "m")).select("label", F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("mean"))


def neighbours(spark, sf):
    e = read_table(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))  # the stated query set
    return vectors.vector_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 10)


_TOPK = """nn AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round((1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2, 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round((1 + list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) / 2, 6) DESC, v.vec_id) AS place FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY place <= 10)"""
QUERIES["v5_vector_topk"], ORACLES["v5_vector_topk"] = neighbours, f"WITH {_TOPK} SELECT * FROM nn"


@query("v7_pending_chunks", f"WITH {CHUNKS} SELECT chunk_id, file_id FROM chunks WHERE NOT file_id IN (SELECT vec_id FROM embeddings)")
def v7(spark, sf):
    c = chunks(spark, sf)
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"), F.lit("m").alias("model"))
    return catalog.pending_chunks(c, c.select("chunk_id", "file_id").join(v, "file_id").select("chunk_id", "model"), "m").select("chunk_id", "file_id")


@query("h1_rrf", f"WITH {HITS}, f AS (SELECT query_id, chunk_id AS item, round(sum(1.0 / (60 + place)), 9) AS fused FROM hits GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item) AS place FROM f")
def h1(spark, sf):
    return hybrid.rrf_fuse(hits(spark, sf).withColumnRenamed("chunk_id", "item"))


_FUSE = f"""{HITS}, s1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_id, chunk_id ORDER BY channel, place) AS sight FROM hits),
s2 AS (SELECT *, sum((sight = 1)::INT) OVER (PARTITION BY query_id, file_id ORDER BY channel, place, chunk_id ROWS UNBOUNDED PRECEDING) AS new FROM s1),
cands AS (SELECT query_id, file_id, chunk_id, round(sum(w / (60 + place)), 9) AS fused, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, max(score) AS best_score
          FROM (SELECT *, CASE reason WHEN 'semantic' THEN 1.15::DOUBLE WHEN 'fulltext' THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END AS w FROM s2 WHERE sight > 1 OR new <= 3) GROUP BY 1, 2, 3),
boosted AS (SELECT * REPLACE (round(fused + CASE WHEN list_contains(string_split(reasons, ','), 'filename') THEN 2.0 WHEN list_contains(string_split(reasons, ','), 'path') THEN 1.0 ELSE 0.0 END, 9) AS fused) FROM cands)"""


@query("h2_fuse_channels", f"WITH {_FUSE} SELECT * FROM cands")
def h2(spark, sf):
    return hybrid.fuse_channels(hits(spark, sf))


@query("h3_h5_files", f"WITH {_FUSE}, b AS (SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id, file_id ORDER BY fused DESC, chunk_id) = 1) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, file_id) AS place FROM b QUALIFY place <= 5")
def h35(spark, sf):
    return hybrid.collapse_to_files(hybrid.boost_names(hybrid.fuse_channels(hits(spark, sf))), 5)


_WIDE = f"{HITS}, w AS (SELECT query_id, file_id, chunk_id, max(score) FILTER (reason = 'semantic') AS semantic, max(score) FILTER (reason = 'fulltext') AS fulltext FROM hits GROUP BY 1, 2, 3)"


def wide(spark, sf):
    pick = lambda r: F.max(F.when(F.col("reason") == r, F.col("score"))).alias(r)
    return hits(spark, sf).groupBy("query_id", "file_id", "chunk_id").agg(pick("semantic"), pick("fulltext"))


@query("h6_evidence_filter", f"WITH {_WIDE} SELECT * FROM w WHERE coalesce(semantic, 0) >= 0.7 OR (coalesce(semantic, 0) >= 0.6 AND coalesce(fulltext, 0) >= 0.05)")
def h6(spark, sf):
    return hybrid.evidence_filter(wide(spark, sf))


@query("h7_query_gate", f"WITH {_WIDE} SELECT query_id, max(semantic) AS max_semantic, max(fulltext) AS max_fulltext, coalesce(max(semantic), 0) >= 0.8 OR coalesce(max(fulltext), 0) >= 0.3 AS passed FROM w GROUP BY 1")
def h7(spark, sf):
    return hybrid.query_gate(wide(spark, sf))


@query("h8_page", f"WITH {HITS}, f AS (SELECT query_id, chunk_id AS item, round(sum(1.0 / (60 + place)), 9) AS fused FROM hits GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item) AS place FROM f QUALIFY place BETWEEN 11 AND 20")
def h8(spark, sf):
    return hybrid.page_results(h1(spark, sf), 10, 10)


@query("r1_duplicate_groups", f"WITH {FILES} SELECT content_sha256, count(*) AS members, min(file_id) AS first_file_id FROM files GROUP BY 1 HAVING count(*) >= 2")
def r1(spark, sf):
    return relations.exact_duplicate_groups(files(spark, sf))


@query("r2_duplicate_pairs", f"WITH {FILES} SELECT * FROM (SELECT min(file_id) OVER (PARTITION BY content_sha256) AS left_file_id, file_id AS right_file_id, 'duplicate' AS relation_type, 1.0::DOUBLE AS confidence FROM files) WHERE left_file_id != right_file_id")
def r2(spark, sf):
    return relations.exact_duplicate_pairs(files(spark, sf))


@query("r3_version_pairs", f"WITH {FILES}, v AS (SELECT file_id, content_sha256, regexp_replace(lower(display_name), '(copy|\\.[^.]*$)', '', 'g') AS k0 FROM files), k AS (SELECT file_id, content_sha256, regexp_replace(k0, '[0-9\\-_ ()\\[\\]v]+$', '') AS key FROM v), a AS (SELECT key, min(file_id) AS f, arg_min(content_sha256, file_id) AS h FROM k WHERE key != '' GROUP BY 1) SELECT f AS left_file_id, file_id AS right_file_id, 'version' AS relation_type, 0.8::DOUBLE AS confidence FROM k JOIN a USING (key) WHERE file_id != f AND content_sha256 IS DISTINCT FROM h")
def r3(spark, sf):
    return relations.version_pairs(files(spark, sf))


_STARS = f"{FILES}, g AS (SELECT min(file_id) OVER (PARTITION BY content_sha256) AS group_id, file_id, count(*) OVER (PARTITION BY content_sha256) AS members FROM files)"


@query("r6_connected_groups", f"WITH {_STARS} SELECT group_id, file_id FROM g WHERE members > 1")
def r6(spark, sf):
    return relations.connected_groups(relations.exact_duplicate_pairs(files(spark, sf), "chain"))


@query("r7_describe_groups", f"WITH {_STARS} SELECT DISTINCT group_id, 'duplicate' AS group_type, 1.0::DOUBLE AS confidence, members FROM g WHERE members > 1")
def r7(spark, sf):
    edges = relations.exact_duplicate_pairs(files(spark, sf))
    return relations.describe_groups(edges, relations.connected_groups(edges))


def family_edges(spark, sf):
    """Files in eights: each with the first of its four, and the second four's first with the eight's first."""
    k = F.col("doc_id")
    to = F.when(k % 4 != 0, k - k % 4).when(k % 8 == 4, k - 4)
    kind = F.when(k % 4 == 0, "summary").otherwise(F.element_at(F.array(*map(F.lit, ("summary", "duplicate", "version"))), (k % 3 + 1).cast("int")))
    return read_table(spark, sf, "documents").select(k.alias("left_file_id"), to.alias("right_file_id"), kind.alias("relation_type"), F.lit(0.5).alias("confidence")).filter("right_file_id is not null")


@query("r7_group_roles", """WITH e AS (SELECT doc_id AS l, CASE WHEN doc_id % 4 != 0 THEN doc_id - doc_id % 4 ELSE doc_id - 4 END AS r, CASE WHEN doc_id % 4 = 0 THEN 'summary' ELSE ['summary', 'duplicate', 'version'][doc_id % 3 + 1] END AS t FROM documents WHERE doc_id % 4 != 0 OR doc_id % 8 = 4),
m AS (SELECT DISTINCT unnest([l, r]) AS file_id FROM e), s AS (SELECT l AS file_id, l, r, 'summary' AS role FROM e WHERE t = 'summary' UNION ALL SELECT r, l, r, 'source' FROM e WHERE t = 'summary'), f AS (SELECT file_id, role FROM s QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY l, r) = 1)
SELECT file_id - file_id % 8 AS group_id, file_id, coalesce(role, 'member') AS role FROM m LEFT JOIN f USING (file_id)""")
def r7_roles(spark, sf):
    edges = family_edges(spark, sf)
    return relations.group_roles(edges, relations.connected_groups(edges))


@query("c1_path_key_c8_display", rf"WITH {FILES} SELECT file_id, {KEY} AS path_key, '…\' || array_to_string([x for x in string_split_regex(substr(canonical_path, 5), '[\\/]') if x != ''][-3:], '\') AS shown FROM files")
def c1(spark, sf):
    return files(spark, sf).select("file_id", T.path_key(F.col("canonical_path")).alias("path_key"), T.display_path(F.col("canonical_path")).alias("shown"))


@query("c2_exclusions", f"WITH {FILES}, p AS (SELECT file_id, extension, string_split({KEY}, '\\') AS parts FROM files) SELECT file_id FROM p WHERE NOT (list_contains(parts, 'node_modules') OR len([x for x in parts if starts_with(x, 'tmp_')]) > 0 OR extension = 'es')")
def c2(spark, sf):
    return catalog.apply_exclusions(files(spark, sf), ["node_modules"], ["tmp_*"], ["ES"]).select("file_id")


@query("c3_drop_protected", f"WITH {FILES} SELECT file_id FROM files WHERE NOT ({KEY} = 'c:\\src1\\docs' OR starts_with({KEY}, 'c:\\src1\\docs\\'))")
def c3(spark, sf):
    return catalog.drop_protected(files(spark, sf), spark.createDataFrame([("C:\\src1\\Docs\\",)], "path string")).select("file_id")


@query("c4_assign_roots", f"WITH {FILES}, r AS (SELECT DISTINCT root_id AS r, 'c:\\' || root_id AS k FROM files UNION ALL SELECT 'all', 'c:'), h AS (SELECT file_id, r AS root_id, k, {KEY} AS key FROM files, r WHERE starts_with({KEY}, k || '\\')) SELECT file_id, root_id, substr(key, length(k) + 2) AS relative_path, row_number() OVER (PARTITION BY file_id ORDER BY length(k) DESC, root_id) = 1 AS is_primary FROM h")
def c4(spark, sf):
    f = files(spark, sf)
    roots = f.select("root_id", F.concat(F.lit("C:\\"), "root_id").alias("path")).distinct().union(spark.createDataFrame([("all", "C:\\")], "root_id string, path string"))
    return catalog.assign_roots(f, roots)


@query("c6_scope", f"WITH {FILES} SELECT file_id FROM files WHERE root_id IN ('src1', 'src2') AND extension IN ('en', 'fr')")
def c6(spark, sf):
    return catalog.apply_scope(files(spark, sf), roots=["src1", "src2"], extensions=["en", "fr"], availability=["present"]).select("file_id")


@query("c7_query_files", f"WITH {FILES} SELECT file_id, display_name FROM files WHERE contains(lower(display_name), 'doc 1') AND parse_status = 'parsed' AND file_id > 100 ORDER BY file_id LIMIT 50")
def c7(spark, sf):
    return catalog.query_files(files(spark, sf), "DOC 1", statuses=["parsed"], after=100).select("file_id", "display_name")


@query("c10_coverage", f"WITH {FILES}, {CHUNKS}, c AS (SELECT count(*) AS chunks, count(*) FILTER (file_id IN (SELECT vec_id FROM embeddings)) AS embedded FROM chunks) SELECT count(*) AS discovered, count(*) FILTER (parse_status = 'parsed') AS parsed, count(*) FILTER (parse_status = 'failed') AS failed, any_value(chunks) AS chunks, any_value(embedded) AS embedded, round(count(*) FILTER (parse_status = 'parsed') / count(*), 6) AS parse_ratio, round(any_value(embedded) / any_value(chunks), 6) AS embedding_ratio FROM files, c")
def c10(spark, sf):
    c = chunks(spark, sf)
    v = c.join(read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id")), "file_id").select("chunk_id")
    return catalog.coverage_snapshot(files(spark, sf), c, v)


@query("c12_integrity", f"WITH {CHUNKS} SELECT (SELECT count(*) FROM embeddings WHERE vec_id || '-1' NOT IN (SELECT chunk_id FROM chunks)) AS orphan_vectors, 0::BIGINT AS orphan_chunks, 0::BIGINT AS rootless_files, (SELECT count(*) FROM embeddings WHERE vec_id || '-1' NOT IN (SELECT chunk_id FROM chunks)) = 0 AS passed")
def c12(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.concat_ws("-", "vec_id", F.lit(1)).alias("chunk_id"))
    return catalog.integrity_snapshot(files(spark, sf), chunks(spark, sf), v)


@query("c15_content_manifest", f"WITH {FILES}, b AS (SELECT file_id % 256 AS bucket, count(*) AS n, sha256(string_agg(file_id || ':' || content_sha256, chr(10) ORDER BY file_id)) AS digest FROM files GROUP BY 1) SELECT sum(n)::BIGINT AS files, sha256(string_agg(digest, chr(10) ORDER BY bucket)) AS digest FROM b")
def c15(spark, sf):
    return catalog.content_manifest(files(spark, sf))


@query("c15_manifest_tree")
def c15_tree(spark, sf):
    return catalog.manifest_tree(files(spark, sf), leaf=64)


@query("c16_status_counts", f"WITH {FILES} SELECT parse_status, extension, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY GROUPING SETS ((parse_status), (extension), ())")
def c16(spark, sf):
    return catalog.status_counts(files(spark, sf))


_SNAP = f"""{FILES}, prev AS (SELECT file_id AS file_key, {KEY} AS path, content_sha256, file_id % 13 != 5 AS present FROM files WHERE file_id % 10 != 3),
curr AS (SELECT file_id AS file_key, CASE WHEN file_id % 7 = 2 THEN {KEY} || '.new' ELSE {KEY} END AS path, CASE WHEN file_id % 8 = 1 THEN sha256(content_sha256) ELSE content_sha256 END AS content_sha256 FROM files WHERE file_id % 10 != 4)"""


@query("t1_snapshot_diff", f"WITH {_SNAP}, d AS (SELECT coalesce(p.file_key, c.file_key) AS file_key, CASE WHEN c.path IS NOT NULL AND p.path IS NULL THEN 'discovered' WHEN c.path IS NULL AND p.present THEN 'missing' WHEN c.path IS NOT NULL AND NOT p.present THEN 'restored' WHEN c.path IS NOT NULL AND p.content_sha256 IS DISTINCT FROM c.content_sha256 THEN 'modified' WHEN c.path IS NOT NULL AND p.path != c.path THEN 'renamed' END AS change, coalesce(p.content_sha256 = c.content_sha256, false) AS same_revision FROM prev p FULL JOIN curr c USING (file_key)) SELECT * FROM d WHERE change IS NOT NULL")
def t1(spark, sf):
    f = files(spark, sf).select(F.col("file_id").alias("file_key"), T.path_key(F.col("canonical_path")).alias("path"), "content_sha256")
    prev = f.filter("file_key % 10 != 3").withColumn("present", F.col("file_key") % 13 != 5)
    curr = f.filter("file_key % 10 != 4").select("file_key", F.when(F.col("file_key") % 7 == 2, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(F.col("file_key") % 8 == 1, F.sha2("content_sha256", 256)).otherwise(F.col("content_sha256")).alias("content_sha256"), F.lit(True).alias("present"))
    return incremental.snapshot_diff(prev, curr)


@query("t2_coalesce_events", f"WITH {EVENTS}, s AS (SELECT *, coalesce(epoch_ms(ts) - lag(epoch_ms(ts)) OVER r >= 2000, true)::INT AS st FROM fs WINDOW r AS (PARTITION BY root_id ORDER BY ts, event_id)), b AS (SELECT *, sum(st) OVER (PARTITION BY root_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM s) SELECT root_id, burst, path, CASE WHEN bool_or(event_type = 'removed') THEN 'removed' WHEN bool_or(event_type = 'renamed') THEN 'renamed' WHEN last(event_type ORDER BY ts, event_id) = 'modified' AND last(event_type ORDER BY ts, event_id) FILTER (event_type != 'modified') = 'created' THEN 'created' ELSE last(event_type ORDER BY ts, event_id) END AS event_type, max(ts) AS last_ts, count(*) AS events FROM b GROUP BY 1, 2, 3")
def t2(spark, sf):
    return incremental.coalesce_events(fs_events(spark, sf))


@query("t7_event_rates", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def t7(spark, sf):
    return incremental.event_rates(read_table(spark, sf, "events"))


_MSG = "msg AS (SELECT conv_id AS session_id, turn, role, text FROM conversations)"


def messages(spark, sf):
    return read_table(spark, sf, "conversations").withColumnRenamed("conv_id", "session_id")


@query("e10_recent_history", f"WITH {_MSG} SELECT session_id, turn, role, left(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), 400) AS text FROM msg QUALIFY row_number() OVER (PARTITION BY session_id, role = 'user' ORDER BY turn DESC) <= 2")
def e10(spark, sf):
    return catalog.recent_history(messages(spark, sf), 2, 2)


@query("e23_session_summaries", f"WITH {_MSG} SELECT session_id, count(*) AS messages, min(turn) AS first_turn, max(turn) AS last_turn, arg_max(role, turn) AS last_role FROM msg GROUP BY 1")
def e23(spark, sf):
    return catalog.session_summaries(messages(spark, sf))


@query("p2_head_mid_tail", f"WITH {CHUNKS}, c AS (SELECT file_id, ordinal, row_number() OVER (PARTITION BY file_id ORDER BY ordinal) - 1 AS r, count(*) OVER (PARTITION BY file_id) AS n FROM chunks) SELECT file_id, max(ordinal) FILTER (r = 0) AS head, max(ordinal) FILTER (r = CASE WHEN n >= 3 THEN n // 2 ELSE 0 END) AS middle, max(ordinal) FILTER (r = n - 1) AS tail FROM c GROUP BY 1")
def p2(spark, sf):
    return catalog.head_mid_tail(chunks(spark, sf))


def search_cases(spark, sf):
    """Neighbours as returned files; the dozen of ids around the query's as relevant ones."""
    found = neighbours(spark, sf).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("returned"))
    first = F.col("query_id") - F.col("query_id") % 12
    return found.select(F.col("query_id").alias("case_id"), F.sequence(first, first + 11).alias("relevant"), "returned", (F.col("query_id") * 37 % 1009).alias("elapsed_ms"))


@query("q1_search_metrics", f"WITH {_TOPK}, rel AS (SELECT vec_id AS query_id, range(vec_id - vec_id % 12, vec_id - vec_id % 12 + 12) AS relevant FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT query_id, any_value(len(relevant)) AS n, count(*) FILTER (list_contains(relevant, id)) AS hits, min(place) FILTER (list_contains(relevant, id)) AS f, coalesce(sum(1 / log2(place + 1)) FILTER (list_contains(relevant, id)), 0) AS g FROM nn JOIN rel USING (query_id) GROUP BY 1) SELECT count(*) AS cases, round(avg(hits / n), 6) AS recall, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(g / list_sum([1 / log2(r + 1) for r in range(1, least(n, 10) + 1)])), 6) AS ndcg, quantile_disc(query_id * 37 % 1009, 0.95) AS p95_ms FROM c")
def q1(spark, sf):
    return evaluation.search_metrics(search_cases(spark, sf))


@query("q3_relation_metrics", "WITH c AS (SELECT l_orderkey % 3 = 0 AS e, l_partkey % 4 = 0 AS p, l_returnflag AS et, CASE WHEN l_linenumber % 2 = 0 THEN 'N' ELSE l_returnflag END AS pt FROM lineitem) SELECT round(count(*) FILTER (e AND p) / count(*) FILTER (p), 6) AS precision, round(count(*) FILTER (e AND p) / count(*) FILTER (e), 6) AS recall, round(count(*) FILTER (e AND p AND et = pt) / count(*) FILTER (e AND p), 6) AS type_accuracy FROM c")
def q3(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return evaluation.relation_metrics(li.select((F.col("l_orderkey") % 3 == 0).alias("expected"), (F.col("l_partkey") % 4 == 0).alias("predicted"), F.col("l_returnflag").alias("expected_type"), F.when(F.col("l_linenumber") % 2 == 0, "N").otherwise(F.col("l_returnflag")).alias("predicted_type")))


def run_results(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.select(F.col("l_linestatus").alias("feature"), F.col("l_returnflag").alias("category"), (F.col("l_discount") > 0.03).alias("passed"), F.floor("l_extendedprice").alias("latency_ms"))


@query("q8_run_metrics", "WITH r AS (SELECT l_linestatus AS feature, l_discount > 0.03 AS passed, floor(l_extendedprice)::BIGINT AS ms FROM lineitem) SELECT feature, count(*) AS cases, count(*) FILTER (passed) AS passes, round(avg(ms), 4) AS mean_ms, quantile_disc(ms, 0.95) AS p95_ms, list_sort(list(ms))[len(list(ms)) // 2 + 1] AS p50_ms, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate FROM r GROUP BY 1")
def q8(spark, sf):
    return evaluation.run_metrics(run_results(spark, sf))


@query("q10_case_rollup", "SELECT l_linestatus AS feature, l_returnflag AS category, count(*) AS cases, count(*) FILTER (l_discount > 0.03) AS passes FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)")
def q10(spark, sf):
    return evaluation.case_rollup(run_results(spark, sf))


@query("q17_split", "WITH RECURSIVE b AS (SELECT item_id, encode(text) AS t, 0 AS i, 2166136261::BIGINT AS h FROM benchmark UNION ALL SELECT item_id, t, i + 1, (xor(h, ('0x' || substr(hex(t), 2 * i + 1, 2))::BIGINT) * 16777619) % 4294967296 FROM b WHERE i < octet_length(t)) SELECT item_id, h AS fnv, CASE WHEN h < floor(0.7 * 4294967295) THEN 'DEV' ELSE 'HOLDOUT' END AS split FROM b WHERE i = octet_length(t)")
def q17(spark, sf):
    key = F.col("text")
    return read_table(spark, sf, "benchmark").select("item_id", T.fnv1a32(key).alias("fnv"), T.dev_or_holdout(key).alias("split"))


@query("o1_trace_timings", "SELECT user_id AS operation_id, round(sum(value) FILTER (event_type = 'view'), 4) AS \"view\", round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(coalesce(round(sum(value) FILTER (event_type = 'view'), 4), 0) + coalesce(round(sum(value) FILTER (event_type = 'click'), 4), 0), 4) AS total_ms FROM events GROUP BY 1")
def o1(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("user_id").alias("operation_id"), F.col("event_type").alias("node"), F.col("value").alias("elapsed_ms"))
    return evaluation.trace_timings(e, ["view", "click"])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for the benchmark passages: full-text channel, fused and cut to the five best files a query."""
    full = bm25(spark, sf).select("query_id", F.lit(1).alias("channel"), "place", F.col("chunk_id").alias("file_id"), "chunk_id", F.lit("fulltext").alias("reason"), "score")
    near = neighbours(spark, sf).select("query_id", F.lit(2).alias("channel"), "place", F.col("id").alias("file_id"), F.col("id").alias("chunk_id"), F.lit("semantic").alias("reason"), "score")
    return hybrid.collapse_to_files(hybrid.boost_names(hybrid.fuse_channels(full.union(near))), 5)


QUERIES["w2_hybrid_search"] = flagship
ORACLES["w2_hybrid_search"] = f"WITH {_BM25}, {_TOPK}, u AS (SELECT query_id, 1 AS channel, place, chunk_id AS file_id, chunk_id, 'fulltext' AS reason, score, 1.0::DOUBLE AS w FROM bm UNION ALL SELECT query_id, 2, place, id, id, 'semantic', score, 1.15::DOUBLE FROM nn), f AS (SELECT query_id, file_id, chunk_id, round(sum(w / (60 + place)), 9) AS fused, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, max(score) AS best_score FROM u GROUP BY 1, 2, 3) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, file_id) AS place FROM f QUALIFY place <= 5"
