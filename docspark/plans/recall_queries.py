"""Registered queries on extraction, document recall, answers and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import answers, extraction, memory, profiles, recall
from docspark.operators import questions as questions_ops
from docspark.operators.names import STOP_WORDS, query_entities
from docspark.plans.queries import query
from docspark.plans.tables import CHUNKS, FILES, chunks, files
from docspark.sources.files import read_table

Q = "'"


@query("x1_decode_text", "SELECT doc_id, text || CASE WHEN doc_id % 3 = 2 THEN chr(65533) ELSE '' END AS text FROM documents")
def x1(spark, sf):
    raw, k = F.encode("text", "UTF-8"), F.col("doc_id") % 3
    content = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(k == 1, raw).otherwise(F.concat(raw, F.unhex(F.lit("FF"))))
    return read_table(spark, sf, "documents").select("doc_id", extraction.decode_text(content).alias("text"))


_HTML = "regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g')"
for _tag in extraction.HIDDEN:
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}\\b[^>]*>.*?(?:</{_tag}\\s*>|\\z)', '', 'g')"
_HTML = f"regexp_replace(regexp_replace({_HTML}, '(?i)<(?:{'|'.join(extraction.BREAKING)})(?:[\\s/][^>]*)?>', chr(10), 'g'), '(?s)<[/!?A-Za-z][^>]*(?:>|\\z)', '', 'g')"
for _name, _value in extraction.ENTITIES.items():
    _HTML = f"regexp_replace({_HTML}, '&{_name};{'?' if _name in extraction.OPEN else ''}', '{_value.replace(Q, Q + Q)}', 'g')"


@query("x2_html_text", rf"SELECT page_id, trim(regexp_replace({_HTML}, '[\s\x{{A0}}\x{{3000}}]+', ' ', 'g')) AS text FROM pages")
def x2(spark, sf):
    return extraction.html_visible_text(read_table(spark, sf, "pages"))


_CELL = r"""'("[^"]*(?:""[^"]*)*"[^,\r\n]*|[^,\r\n]*)(,|\r\n|\n|\r|\z)'"""


@query("x4_delimited", rf"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, {_CELL}, 1)) AS c, unnest(regexp_extract_all(text, {_CELL}, 2)) AS e, unnest(range(1, len(regexp_extract_all(text, {_CELL}, 1)) + 1)) AS pos FROM documents),
r AS (SELECT *, coalesce(count(*) FILTER (regexp_matches(e, '[\r\n]')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r, lag(e, 1, chr(10)) OVER w AS last FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l AS (SELECT doc_id, r, string_agg(CASE WHEN starts_with(c, '"') THEN replace(regexp_replace(c, '^"([^"]*(?:""[^"]*)*)"', '\1'), '""', '"') ELSE c END, ' | ' ORDER BY pos) AS line FROM r WHERE c != '' OR e != '' OR last = ',' GROUP BY 1, 2),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY 1),
n AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS ordinal, unnest(s) AS x FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS s FROM t))
SELECT doc_id, ordinal, 'paragraph' AS node_type, regexp_replace(x, '^\s+|\s+$', '', 'g') AS text FROM n WHERE regexp_replace(x, '^\s+|\s+$', '', 'g') != ''""")
def x4(spark, sf):
    return extraction.delimited_to_nodes(read_table(spark, sf, "documents"))


_FIRST = " ".join(f"WHEN regexp_matches(x, '{p}') THEN regexp_extract(x, '{p}', 1)" for p in extraction.SYMBOLS)


@query("x5_code_nodes", rf"""WITH d AS (SELECT doc_id, lang, regexp_split_to_array(regexp_replace(regexp_replace(text, '\n([Tt])', chr(10) || 'pub fn \1', 'g'), '(?:\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS l FROM documents), x AS (SELECT doc_id, lang, unnest(l) AS x, unnest(range(0, len(l))) AS pos FROM d),
s AS (SELECT *, CASE {_FIRST} END AS symbol FROM x), p AS (SELECT *, count(symbol) OVER (PARTITION BY doc_id ORDER BY pos) AS part, count(symbol) OVER (PARTITION BY doc_id) AS n FROM s),
g AS (SELECT doc_id, max(lang) AS lang, CASE WHEN n = 0 THEN pos // 120 ELSE part END AS part, max(symbol) AS symbol, min(pos) + 1 AS line_start, max(pos) + 1 AS line_end, regexp_replace(string_agg(x, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM p GROUP BY doc_id, CASE WHEN n = 0 THEN pos // 120 ELSE part END)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS ordinal, CASE WHEN symbol IS NULL THEN 'code_block' ELSE 'code_symbol' END AS node_type, symbol, line_start, line_end, sha256(text) AS text_sha, concat_ws('/', lang, symbol) AS heading FROM g WHERE text != ''""")
def x5(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "lang", F.regexp_replace("text", r"\n([Tt])", "\npub fn $1").alias("text"))
    return extraction.code_to_nodes(d, format_col="lang").withColumns({"text_sha": F.sha2("text", 256), "heading": F.array_join("heading_path", "/")}).drop("text", "heading_path")


@query("x6_mime")
def x6(spark, sf):
    f = files(spark, sf)
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in ("", "255044462D", "504B0304", "FFD8FF", "4D5A", "0102")]), (F.col("file_id") % 6 + 1).cast("int"))
    ext = F.when(F.col("file_id") % 4 == 0, "md").when(F.col("file_id") % 4 == 1, "rs").otherwise(F.col("extension"))
    return f.select("file_id", extraction.detect_mime(ext, F.concat(head, F.encode("text", "UTF-8"))).alias("mime"))


def file_profiles(spark, sf):
    f, k = files(spark, sf), F.col("file_id")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{10,}"), 0))
    return f.select(
        k.alias("file_id"), "display_name", F.concat_ws(" ", "root_id", "extension").alias("title"), F.col("extension").alias("document_type"), F.concat(F.lit("Type "), "extension").alias("type_name"),
        words.alias("keywords"), F.split("text", "\n").alias("section_titles"), F.array(F.regexp_replace("display_name", r"\.[^.]*$", "")).alias("entities"), F.col("text").alias("summary"), F.col("text").alias("head"),
    )


_PROFILES = rf"""{FILES}, prof AS (SELECT file_id, display_name, regexp_replace(display_name, '\.[^.]*$', '') AS stem, root_id || ' ' || extension AS title, extension AS document_type, 'Type ' || extension AS type_name,
list_distinct(regexp_extract_all(text, '[A-Za-z]{{10,}}')) AS keywords, string_split(text, chr(10)) AS section_titles, [regexp_replace(display_name, '\.[^.]*$', '')] AS entities, text AS summary FROM files)"""
_BIG = "list_distinct([{0}[i:i+1] for i in range(1, length({0}))])"
_META = f"""{_PROFILES}, qs AS (SELECT item_id AS question_id, trim(text) AS q, {_BIG.format('trim(text)')} AS g FROM benchmark),
x AS (SELECT question_id, file_id, list_has_any(g, {_BIG.format('stem')}) OR list_has_any(g, {_BIG.format('title')}) AS t, contains(q, type_name) OR contains(q, document_type) AS y,
  len(list_filter(keywords, lambda k: contains(q, k))) > 0 AS k, len(list_filter(section_titles, lambda s: length(trim(s)) >= 2 AND contains(q, trim(s)))) > 0 AS s, contains(q, stem) AS e, length(trim(summary)) >= 2 AND contains(q, trim(summary)) AS m FROM qs, prof),
meta AS (SELECT question_id, file_id, round(least(0.9, t::INT * 0.45::DOUBLE + y::INT * 0.35::DOUBLE + k::INT * 0.3::DOUBLE + s::INT * 0.25::DOUBLE + e::INT * 0.2::DOUBLE + m::INT * 0.15::DOUBLE), 6) AS score,
  concat_ws(',', CASE WHEN t THEN 'title_match' END, CASE WHEN y THEN 'type_match' END, CASE WHEN k THEN 'keyword_match' END, CASE WHEN s THEN 'section_title_match' END, CASE WHEN e THEN 'entity_match' END, CASE WHEN m THEN 'summary_match' END) AS signals FROM x WHERE t OR y OR k OR s OR e OR m)"""


def questions(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def scored(spark, sf):
    return recall.metadata_scores(questions(spark, sf), file_profiles(spark, sf))


query("p8_metadata_scores", f"WITH {_META} SELECT * FROM meta")(scored)


@query("p8_best_by_metadata", f"WITH {_META} SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id) AS place FROM meta QUALIFY place <= 24")
def best_scored(spark, sf):
    return recall.best_by_metadata(questions(spark, sf), file_profiles(spark, sf))


_WORDS = {"first": ("thand", "ationthe", "the"), "second": ("ering", "Wh", "src1"), "third": ("ouble", "esthe", "Doc 1")}
_RULES = ", ".join(f"({-i}, '{n}', least(1.0, round(({' + '.join(f'3 * contains(title, {Q}{w}{Q})::INT + 2 * (len(list_filter(section_titles, lambda s: contains(s, {Q}{w}{Q}))) > 0)::INT + contains(summary, {Q}{w}{Q})::INT + contains(display_name, {Q}{w}{Q})::INT' for w in ws)}) / 6, 6)))" for i, (n, ws) in enumerate(_WORDS.items()))


@query("p4_type_rules", f"WITH {_PROFILES}, r AS (SELECT file_id, o, t, s FROM prof, LATERAL (SELECT * FROM (VALUES {_RULES}) v(o, t, s))) SELECT file_id, t AS type, s AS score FROM r WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY s DESC, o DESC) = 1")
def p4(spark, sf):
    return recall.type_rule_scores(file_profiles(spark, sf), _WORDS)


def vectors_of(spark, sf, name):
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("p9_rank_documents", f"WITH {_META}, c AS (SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id) <= 24), v AS (SELECT c.*, coalesce({_COS}, 0) AS cos FROM c LEFT JOIN embeddings a ON a.vec_id = question_id LEFT JOIN embeddings b ON b.vec_id = file_id), z AS (SELECT question_id, file_id, round(CASE WHEN cos > 0 THEN 0.55 * score + 0.45 * cos ELSE 0.8 * score END, 6) AS score, signals || CASE WHEN cos > 0 THEN ',vector_match' ELSE '' END AS signals FROM v), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id) AS place FROM z) SELECT * FROM p WHERE place <= 8 AND score >= 0.25")
def p9(spark, sf):
    return recall.rank_documents(best_scored(spark, sf), vectors_of(spark, sf, "question_id"), vectors_of(spark, sf, "file_id"))


@query("p11_parallel_recall", f"WITH {_META}, c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, file_id) AS place FROM meta QUALIFY place <= 24), n AS (SELECT a.vec_id AS question_id, b.vec_id AS file_id, round((1 + {_COS}) / 2, 6) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS place FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b QUALIFY place <= 40), l AS (SELECT question_id, file_id, place, signals, 0 AS o FROM c UNION ALL SELECT question_id, file_id, place, 'semantic_match', 1 FROM n WHERE s >= 0.62), f AS (SELECT question_id, file_id, round(sum(1.0 / (60 + place)), 9) AS fused, string_agg(signals, ',' ORDER BY o) AS signals FROM l GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY fused DESC, file_id) AS place FROM f QUALIFY place <= 8) SELECT question_id, file_id, round(fused / max(fused) OVER (PARTITION BY question_id), 6) AS score, signals, place FROM p")
def p11(spark, sf):
    asked = vectors_of(spark, sf, "query_id").join(questions(spark, sf).select(F.col("question_id").alias("query_id")), "query_id", "left_semi")
    near = profiles.semantic_recall(asked, vectors_of(spark, sf, "id"))
    return recall.parallel_recall(best_scored(spark, sf), near.select(F.col("query_id").alias("question_id"), F.col("id").alias("file_id"), "place"))


_TARGETS = """tg AS (SELECT item_id AS target_id, CASE WHEN item_id % 3 = 0 THEN 'fr' END AS document_type, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Doc ' || item_id || '_v2.en' ELSE 'Doc ' || item_id % 90 END AS name, CASE WHEN item_id % 2 = 0 THEN 'Doc ' || item_id % 17 END AS entity, item_id % 4 = 0 AS self, item_id % 6 = 1 AS precise, CASE WHEN item_id % 7 = 3 THEN item_id END AS active, CASE WHEN item_id % 8 < 3 THEN [item_id, item_id + 1] END AS refs FROM benchmark)"""


@query("p12_resolve_documents", rf"""WITH {_PROFILES}, {_TARGETS}, pn AS (SELECT file_id, stem AS pstem, regexp_replace(title, '\.[^.\s]*$', '') AS ptitle FROM prof),
ex AS (SELECT target_id, count(DISTINCT file_id) AS n, list_sort(list(DISTINCT file_id)) AS files FROM tg JOIN pn ON regexp_replace(regexp_replace(name, '\.[^.\s]*$', ''), '(.)_[0-9]+$', '\1') IN (regexp_replace(pstem, '(.)_[0-9]+$', '\1'), ptitle) WHERE precise GROUP BY 1),
sm AS (SELECT a.vec_id AS target_id, b.vec_id AS file_id, round({_COS}, 6) AS cos FROM embeddings a JOIN benchmark ON item_id = a.vec_id, embeddings b WHERE round({_COS}, 6) >= 0.24),
lo AS (SELECT * FROM tg WHERE NOT precise OR name IS NULL),
w AS (SELECT target_id, file_id, (coalesce(lo.document_type = prof.document_type, FALSE))::INT * 0.35::DOUBLE + (coalesce(active = file_id, FALSE))::INT * 0.3::DOUBLE + (coalesce(contains(title, name) OR contains(name, title), FALSE))::INT * 0.25::DOUBLE + (coalesce(list_contains(refs, file_id), FALSE))::INT * 0.2::DOUBLE + (coalesce(contains(stem, entity) OR contains(entity, stem), FALSE))::INT * 0.2::DOUBLE + (coalesce(len(list_filter(keywords, lambda k: contains(k, name) OR contains(name, k))) > 0, FALSE))::INT * 0.15::DOUBLE + (coalesce(contains(display_name, name), FALSE))::INT * 0.1::DOUBLE + 0.3 * coalesce(cos, 0) AS w, self FROM lo CROSS JOIN prof LEFT JOIN sm USING (target_id, file_id)),
s AS (SELECT target_id, file_id, round(least(1.0, w + self::INT * 0.05::DOUBLE), 6) AS score FROM w WHERE w > 0 AND round(least(1.0, w + self::INT * 0.05::DOUBLE), 6) > 0.05),
t AS (SELECT target_id, list(file_id ORDER BY score DESC, file_id)[:3] AS f, list(score ORDER BY score DESC, file_id)[:2] AS sc FROM s GROUP BY 1),
j AS (SELECT target_id, CASE WHEN sc[1] < 0.3 THEN 'unresolved' WHEN round(sc[1] - coalesce(sc[2], -1), 6) >= 0.15 THEN 'resolved' ELSE 'candidates' END AS status, f, sc[1] AS c FROM t
  UNION ALL SELECT target_id, CASE WHEN n = 1 THEN 'resolved' ELSE 'candidates' END, files, 1.0 FROM ex)
SELECT tg.target_id, coalesce(status, 'unresolved') AS status, coalesce(array_to_string(CASE status WHEN 'resolved' THEN f[:1] WHEN 'candidates' THEN f END, ','), '') AS files, CASE WHEN coalesce(status, 'unresolved') = 'unresolved' THEN 0.0 ELSE c END AS confidence FROM tg LEFT JOIN j USING (target_id)""")
def p12(spark, sf):
    i, text = F.col("item_id"), F.col("item_id").cast("string")
    t = read_table(spark, sf, "benchmark").select(
        i.alias("target_id"), F.when(i % 3 == 0, "fr").alias("document_type"), F.when(i % 5 == 1, F.concat(F.lit("Doc "), text, F.lit("_v2.en"))).when(i % 5 != 0, F.concat(F.lit("Doc "), (i % 90).cast("string"))).alias("name"),
        F.when(i % 2 == 0, F.concat(F.lit("Doc "), (i % 17).cast("string"))).alias("entity"), F.when(i % 4 == 0, "self").alias("owner"), (i % 6 == 1).alias("precise"), F.when(i % 7 == 3, i).alias("active_file_id"), F.when(i % 8 < 3, F.array(i, i + 1)).alias("referenced_file_ids"),
    )
    asked = vectors_of(spark, sf, "query_id").join(t.select(F.col("target_id").alias("query_id")), "query_id", "left_semi")
    near = profiles.semantic_recall(asked, vectors_of(spark, sf, "id"), k=1 << 30)
    similar = near.select(F.col("query_id").alias("target_id"), F.col("id").alias("file_id"), F.round(2 * F.col("score") - 1, 6).alias("cos"))
    return recall.resolve_documents(t, file_profiles(spark, sf), similar).withColumn("files", F.array_join("files", ","))


@query("p13_sections", rf"""WITH RECURSIVE {CHUNKS}, c AS (SELECT file_id AS doc_id, ordinal, CASE WHEN ordinal % 4 != 0 THEN 'Part ' || (ordinal // 9) END AS h, strlen(text)::BIGINT AS size, row_number() OVER (PARTITION BY file_id ORDER BY ordinal) AS i FROM chunks),
s AS (SELECT doc_id, i, ordinal, lower(coalesce(h, '')) AS key, 1 AS section, coalesce(h, '未命名内容') AS base, 0 AS again, FALSE AS more, size AS held, size FROM c WHERE i = 1 UNION ALL
  SELECT doc_id, i, ordinal, CASE WHEN fresh THEN k ELSE key END, section + fresh::INT, CASE WHEN renamed THEN coalesce(h, '未命名内容') ELSE base END, CASE WHEN renamed THEN 0 ELSE again END + (fresh AND "full")::INT, CASE WHEN fresh THEN "full" ELSE more END, CASE WHEN fresh THEN 0 ELSE held END + size, size
  FROM (SELECT *, fresh AND (NOT "full" OR h IS NOT NULL) AS renamed FROM (SELECT s.* EXCLUDE (i, ordinal, size), c.i, c.ordinal, c.size, c.h, lower(coalesce(c.h, '')) AS k, held >= 6000 AS "full", held >= 6000 OR lower(coalesce(c.h, '')) != key AS fresh FROM s JOIN c ON c.doc_id = s.doc_id AND c.i = s.i + 1))),
g AS (SELECT doc_id, section, any_value(CASE WHEN more THEN base || '（续 ' || again || '）' ELSE base END) AS title, min(ordinal) AS first, count(*) AS chunks, sum(size)::BIGINT AS bytes, max(section) OVER (PARTITION BY doc_id) AS n FROM s GROUP BY doc_id, section)
SELECT doc_id, least(section, 30)::INT AS section, CASE WHEN section >= 30 AND n > 30 THEN '其余内容' ELSE title END AS title, min(first) AS first, sum(chunks)::BIGINT AS chunks, sum(bytes)::BIGINT AS bytes FROM g GROUP BY doc_id, least(section, 30), CASE WHEN section >= 30 AND n > 30 THEN '其余内容' ELSE title END""")
def p13(spark, sf):
    c = chunks(spark, sf)
    return recall.document_sections(c.select(F.col("file_id").alias("doc_id"), "ordinal", F.when(F.col("ordinal") % 4 != 0, F.concat(F.lit("Part "), F.floor(F.col("ordinal") / 9).cast("string"))).alias("heading"), "text"))


@query("e3_extractive_answer", rf"WITH {CHUNKS}, h AS (SELECT file_id % 50 AS question_id, file_id, text, row_number() OVER (PARTITION BY file_id % 50 ORDER BY ordinal, file_id) AS place FROM chunks), f AS (SELECT *, min(place) OVER (PARTITION BY question_id, file_id) AS p1 FROM h WHERE place <= 40), g AS (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY p1) AS n FROM f) SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY place) AS claim, file_id, left(trim(regexp_replace(text, '[\s\x{{A0}}\x{{3000}}]+', ' ', 'g')), 260) AS text FROM g WHERE n <= 5")
def e3(spark, sf):
    from pyspark.sql import Window

    c = chunks(spark, sf).select((F.col("file_id") % 50).alias("question_id"), "file_id", "ordinal", F.col("text").alias("quote"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("ordinal", "file_id"))
    return answers.extractive_answer(c.withColumn("place", place), 40, 5)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_ASKED = f"""qe AS (SELECT conv_id AS question_id, lower(w) AS entity, min(p) AS p FROM (SELECT conv_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS p FROM (SELECT conv_id, regexp_extract_all(text, '[0-9A-Za-z]+') AS l FROM conversations WHERE turn = 0)) WHERE length(w) >= 2 AND NOT regexp_matches(lower(w), '^([0-9]+(e[0-9]+)?|inf|infinity|nan)$') AND lower(w) NOT IN ({_STOP}) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY min(p)) <= 8)"""
_APPEARS = "CASE WHEN length(entity) <= 3 THEN regexp_matches({0}, '(?:^|[^0-9A-Za-z])' || entity || '(?:$|[^0-9A-Za-z])') ELSE contains({0}, entity) END"


def asked_and_shown(spark, sf):
    c = read_table(spark, sf, "conversations").withColumnRenamed("conv_id", "question_id")
    return c.filter("turn = 0"), c.filter("turn > 0").select("question_id", "text", F.lit(None).cast("string").alias("heading"))


@query("e5_entity_hits", f"WITH {_ASKED}, ev AS (SELECT conv_id AS question_id, lower(text) AS t FROM conversations WHERE turn > 0) SELECT question_id, entity, count(*) FILTER ({_APPEARS.format('t')}) AS hits FROM qe LEFT JOIN ev USING (question_id) GROUP BY 1, 2")
def e5(spark, sf):
    asked, shown = asked_and_shown(spark, sf)
    return answers.entity_hits(asked.select("question_id", F.explode(query_entities(F.col("text"))).alias("entity")), shown)


@query("e6_evidence_roles", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'project' WHEN doc_id % 7 = 1 THEN 'person' WHEN doc_id % 7 = 2 THEN 'document_metadata' WHEN doc_id % 7 = 3 THEN 'concept' WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 2 AND length(text) <= 200 THEN 'fact' ELSE 'other' END AS role FROM documents")
def e6(spark, sf):
    k = F.col("doc_id") % 7
    heading = F.when(k == 0, "3. 项目经历").when(k == 1, "联系方式")
    text = F.when(k == 2, F.concat("text", F.lit(" 目录"))).when(k == 3, F.concat(F.lit("X 是一种 "), "text", F.lit("电话"))).otherwise(F.col("text"))
    return read_table(spark, sf, "documents").select("doc_id", answers.evidence_role(text, heading).alias("role"))


@query("e7_answerability", f"WITH {_ASKED}, ev AS (SELECT conv_id AS question_id, lower(text) AS t FROM conversations WHERE turn > 0), h AS (SELECT question_id, entity, p, coalesce(bool_or({_APPEARS.format('t')}), FALSE) AS hit FROM qe LEFT JOIN ev USING (question_id) GROUP BY 1, 2, 3), g AS (SELECT question_id, count(*) AS n, count(*) FILTER (hit) AS m, string_agg(CASE WHEN NOT hit THEN entity END, ',' ORDER BY p) AS missing FROM h GROUP BY 1), q AS (SELECT conv_id AS question_id, conv_id % 6 = 0 AS needs, EXISTS (SELECT 1 FROM ev WHERE ev.question_id = conv_id) AS has FROM conversations WHERE turn = 0), v AS (SELECT question_id, coalesce(missing, '') AS missing, has, CASE WHEN NOT has THEN 'no_evidence' WHEN coalesce(n, 0) > 0 AND m = 0 THEN 'entity_mismatch' WHEN needs THEN 'existence_requires_project_context' WHEN coalesce(missing, '') != '' THEN 'partial_entity_coverage' WHEN coalesce(n, 0) = 0 THEN 'no_strong_entities' ELSE 'entities_consistent' END AS reason FROM q LEFT JOIN g USING (question_id)) SELECT question_id, CASE WHEN reason IN ('no_evidence', 'entity_mismatch', 'existence_requires_project_context') THEN 'not_answerable' WHEN reason = 'partial_entity_coverage' THEN 'partial' ELSE 'answerable' END AS status, CASE reason WHEN 'no_evidence' THEN 0.0 WHEN 'entity_mismatch' THEN 0.15 WHEN 'existence_requires_project_context' THEN 0.2 WHEN 'partial_entity_coverage' THEN 0.45 WHEN 'no_strong_entities' THEN 0.55 ELSE 0.9 END::DOUBLE AS confidence, reason, CASE WHEN has THEN missing ELSE '' END AS missing FROM v")
def e7(spark, sf):
    asked, shown = asked_and_shown(spark, sf)
    return answers.answerability(asked.select("question_id", "text", (F.col("question_id") % 6 == 0).alias("needs_project")), shown)


_CLAIMED = _ASKED.replace("qe AS", "ce AS").replace("conv_id AS question_id", "conv_id * 1000 + turn AS claim_id").replace("SELECT conv_id, unnest", "SELECT conv_id, turn, unnest").replace("SELECT conv_id, regexp", "SELECT conv_id, turn, regexp").replace("WHERE turn = 0", "WHERE turn % 5 != 3").replace("PARTITION BY conv_id ", "PARTITION BY conv_id * 1000 + turn ")


@query("e8_claim_flags", f"WITH {_CLAIMED}, qu AS (SELECT a.conv_id * 1000 + a.turn AS claim_id, lower(b.text) AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn != a.turn), m AS (SELECT claim_id, entity, p FROM ce LEFT JOIN qu USING (claim_id) GROUP BY 1, 2, 3 HAVING NOT coalesce(bool_or({_APPEARS.format('t')}), FALSE)) SELECT conv_id * 1000 + turn AS claim_id, (SELECT arg_min(entity, p) FROM m WHERE m.claim_id = conv_id * 1000 + turn) AS missing_entity, CASE WHEN turn % 5 = 2 THEN '通常用于' END AS outside FROM conversations")
def e8(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), "text")
    more = F.when(F.col("turn") % 5 == 3, " 未找到").when(F.col("turn") % 5 == 2, " 通常用于 你可以参考").otherwise("")
    other = c.select("conv_id", F.col("turn").alias("t"), F.col("text").alias("quote"))
    return answers.claim_flags(c.withColumn("text", F.concat("text", more)), c.join(other, "conv_id").filter("t != turn").select("claim_id", "quote"))


_QUESTIONS = "oq AS (SELECT o_orderkey AS question_id, 'About Nation_' || o_custkey % 30 || ' and  REGION ' || o_custkey % 7 || CASE WHEN o_orderkey % 3 = 0 THEN ' nation _1' ELSE '' END AS text, replace(lower(text), ' ', '') AS q FROM orders)"


def order_questions(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("About Nation_"), (c % 30).cast("string"), F.lit(" and  REGION "), (c % 7).cast("string"), F.when(k % 3 == 0, " nation _1").otherwise(""))
    return read_table(spark, sf, "orders").select(k.alias("question_id"), text.alias("text"))


@query("e13_match_aliases", f"WITH {_QUESTIONS}, a AS (SELECT lower(n_name) AS key, 'entity' AS target_type, n_nationkey AS target_id FROM nation UNION ALL SELECT 'nation_1', 'file', n_nationkey FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'on', 'collection', r_regionkey FROM region), h AS (SELECT * FROM oq JOIN a ON contains(q, key)) SELECT question_id, key AS alias, target_type, target_id, 1.0 AS confidence FROM h WHERE NOT EXISTS (SELECT 1 FROM h z WHERE z.question_id = h.question_id AND z.key != h.key AND contains(z.key, h.key))")
def e13(spark, sf):
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    a = n.select(F.col("n_name").alias("alias"), F.lit("entity").alias("target_type"), F.col("n_nationkey").alias("target_id"))
    a = a.union(n.filter("n_nationkey % 5 = 0").select(F.lit("Nation_1"), F.lit("file"), "n_nationkey")).union(r.select(F.lit("on"), F.lit("collection"), "r_regionkey"))
    return memory.match_aliases(order_questions(spark, sf), a.withColumn("confidence", F.lit(1.0)))


@query("e14_match_relations", f"WITH {_QUESTIONS}, r AS (SELECT s_suppkey AS relation_id, CASE WHEN s_suppkey % 4 = 0 THEN 'file' ELSE 'entity' END AS st, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey ELSE s_nationkey END AS si, CASE WHEN s_suppkey % 4 IN (0, 3) THEN 'entity' ELSE 'file' END AS ot, CASE WHEN s_suppkey % 4 = 0 THEN s_nationkey ELSE s_suppkey % 25 END AS oi FROM supplier WHERE s_suppkey % 3 != 0), h AS (SELECT question_id, n_nationkey AS e, lower(n_name) AS key FROM oq JOIN nation ON contains(q, lower(n_name))), x AS (SELECT question_id, relation_id, key, 0 AS side, ot AS t, oi AS i FROM h JOIN r ON si = e WHERE ot != 'entity' UNION ALL SELECT question_id, relation_id, key, 1, st, si FROM h JOIN r ON oi = e WHERE st != 'entity') SELECT question_id, relation_id, key AS matched, t AS target_type, i AS target_id FROM x QUALIFY row_number() OVER (PARTITION BY question_id, relation_id ORDER BY side) = 1")
def e14(spark, sf):
    s, k, n = read_table(spark, sf, "supplier"), F.col("s_suppkey"), F.col("s_nationkey")
    r = s.select(
        k.alias("relation_id"), F.when(k % 4 == 0, "file").otherwise("entity").alias("subject_type"), F.when(k % 4 == 0, k).otherwise(n).alias("subject_id"),
        F.when((k % 4).isin(0, 3), "entity").otherwise("file").alias("object_type"), F.when(k % 4 == 0, n).otherwise(k % 25).alias("object_id"), F.when(k % 3 != 0, "confirmed").otherwise("candidate").alias("status"),
    )
    named = read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    return memory.match_relations(order_questions(spark, sf), named, r)


@query("e21_glossary", f"WITH {_QUESTIONS}, t AS (SELECT n_nationkey AS entry, 1 AS place, lower(n_name) AS term FROM nation UNION ALL SELECT n_nationkey, 2, 'region ' || n_regionkey FROM nation UNION ALL SELECT 100, 1, 'and'), h AS (SELECT question_id, entry, term, strpos(lower(text), term) AS position FROM oq JOIN t ON contains(lower(text), term) QUALIFY row_number() OVER (PARTITION BY question_id, entry ORDER BY place) = 1) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY position, entry) = 1")
def e21(spark, sf):
    n = read_table(spark, sf, "nation")
    t = n.select(F.col("n_nationkey").cast("long").alias("entry"), F.lit(1).alias("place"), F.lower("n_name").alias("term"))
    t = t.union(n.select("n_nationkey", F.lit(2), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))).union(read_table(spark, sf, "region").select(F.lit(100), F.lit(1), F.lit("and")).distinct())
    return memory.glossary_lookup(order_questions(spark, sf), t)


@query("e22_memory_summaries", "WITH m AS (SELECT 'alias' AS kind, c_custkey AS id, c_name AS label, 'entity' AS target_type, c_nationkey + CASE WHEN c_custkey % 10 = 0 THEN 100 ELSE 0 END AS t, ['confirmed', 'candidate', 'rejected'][c_custkey % 3 + 1] AS status, c_custkey * 7 % 1000 AS updated_at, ['你主动设置', '你在对话中确认过', '你选择过该文件', '多次使用后自动记住', '从资料中推测', '推测', NULL][c_custkey % 7 + 1] AS source_label FROM customer UNION ALL SELECT 'relation', s_suppkey, 'supplies', 'collection', s_nationkey % 7, 'confirmed', s_suppkey, '推测' FROM supplier) SELECT kind, id, label, target_type, coalesce(n_name, r_name, '(removed)') AS target, coalesce(n_name, r_name) IS NOT NULL AS available, status, updated_at, source_label FROM m LEFT JOIN nation ON target_type = 'entity' AND n_nationkey = t LEFT JOIN region ON target_type = 'collection' AND r_regionkey = t WHERE status != 'rejected'")
def e22(spark, sf):
    c, k = read_table(spark, sf, "customer"), F.col("c_custkey")
    a = c.select(k.alias("alias_id"), F.col("c_name").alias("alias"), F.lit("entity").alias("target_type"), (F.col("c_nationkey") + F.when(k % 10 == 0, 100).otherwise(0)).alias("target_id"), F.element_at(F.array(*map(F.lit, ("confirmed", "candidate", "rejected"))), (k % 3 + 1).cast("int")).alias("status"), (k * 7 % 1000).alias("updated_at"), F.element_at(F.array(*map(F.lit, (*memory.SOURCE_LABELS, "other"))), (k % 7 + 1).cast("int")).alias("source_type"))
    r = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("relation_id"), F.lit("supplies").alias("predicate"), F.lit("collection").alias("object_type"), (F.col("s_nationkey") % 7).alias("object_id"), F.lit("confirmed").alias("status"), F.col("s_suppkey").alias("updated_at"), F.lit("model_inference").alias("source_type"))
    named = read_table(spark, sf, "nation").select(F.lit("entity").alias("type"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).union(read_table(spark, sf, "region").select(F.lit("collection"), "r_regionkey", "r_name"))
    return memory.memory_summaries(a, r, named)


@query("e19_query_variants", "SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'A项目b' || t || '|a项目b' || lower(t) ELSE 'ab12' || t || CASE WHEN lower(t) != t THEN '|ab12' || lower(t) ELSE '' END END AS variants FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)")
def e19(spark, sf):
    folded = F.trim(F.regexp_replace("text", r"\s+", " "))
    text = F.concat(F.when(F.col("turn") % 2 == 1, "A 项目 b").otherwise("ａb１2"), folded)
    return read_table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(questions_ops.query_variants(text), "|").alias("variants"))


@query("e20_query_tags", "SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'locate' ELSE 'exists,list' END AS intents, CASE WHEN item_id % 2 = 0 THEN '我的' END AS personal, CASE WHEN item_id % 2 = 0 THEN 'contract' END AS document_type, item_id % 2 = 0 AS own FROM benchmark")
def e20(spark, sf):
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("我的合同在哪 "), "text")).otherwise(F.concat(F.lit("是否有没有 哪些 "), "text")).alias("text"))
    return questions_ops.query_tags(b).select("question_id", "intents", "personal", "document_type", F.array_contains("tokens", "合同").alias("own"))


@query("e11_align_items", f"WITH {CHUNKS}, i AS (SELECT item_id, replace(replace(text, ' ', ''), chr(10), '') AS a FROM benchmark), c AS (SELECT chunk_id, regexp_replace(text, '\\s+', '', 'g') AS b FROM chunks), r AS (SELECT DISTINCT item_id, substr(a, n, 6) AS run FROM (SELECT item_id, a, unnest(range(1, length(a) - 4)) AS n FROM i)), s AS (SELECT DISTINCT chunk_id, substr(b, n, 6) AS run FROM (SELECT chunk_id, b, unnest(range(1, length(b) - 4)) AS n FROM c)), p AS (SELECT DISTINCT item_id FROM r JOIN s USING (run)) SELECT item_id FROM p")
def e11(spark, sf):
    return questions_ops.align_items(read_table(spark, sf, "benchmark").select("item_id", "text"), chunks(spark, sf)).select("item_id")


@query("q14_ask_cases", rf"WITH {_PROFILES}, a AS (SELECT file_id, title AS t, keywords, stem FROM prof), o AS (SELECT file_id, unnest(['doc-qa', 'doc-summary', 'boolean']) AS kind, unnest([t, t, regexp_extract((SELECT text FROM files f WHERE f.file_id = a.file_id), '[A-Za-z]{{10,}}')]) AS subject FROM a), n AS (SELECT file_id AS l, t AS lt, lead(file_id) OVER (ORDER BY file_id) AS r, lead(t) OVER (ORDER BY file_id) AS rt FROM a) SELECT 'ask-' || kind || '-' || file_id AS case_id, kind, file_id::VARCHAR AS file_ids, subject FROM o WHERE subject != '' UNION ALL SELECT 'ask-compare-' || l || '-' || r, 'compare', l || ',' || r, lt || ' | ' || rt FROM n WHERE r IS NOT NULL")
def q14(spark, sf):
    p = file_profiles(spark, sf).withColumn("text", F.col("summary"))
    return questions_ops.ask_cases(p, bucket=64).withColumn("file_ids", F.array_join("file_ids", ","))
