"""Small cases of extraction, names, traces and roles, nulls and empty tables included."""

from pyspark.sql import functions as F

from docspark.operators import extraction, names, profiles, relations, traces


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_extraction(spark):
    p = spark.createDataFrame([(1, "<p>a  b<br>c<script>x</script></p><style>y</style>d &amp; e"), (2, None), (3, "")], "page_id int, html string")
    assert rows(extraction.html_visible_text(p), "page_id", "text") == {(1, "a b cd & e"), (2, None), (3, "")}
    b = spark.createDataFrame([(1, b"\xef\xbb\xbfhi"), (2, "归航".encode("gb18030")), (3, b"\xff\xff"), (4, None)], "id int, content binary")
    assert rows(b.select("id", extraction.decode_text("content").alias("t")), "id", "t") == {(1, "hi"), (2, "归航"), (3, "\ufffd\ufffd"), (4, None)}
    d = spark.createDataFrame([(1, 'a,"b,\nc"\n\nd,e'), (2, None)], "doc_id int, text string")
    assert rows(extraction.delimited_to_nodes(d), "doc_id", "ordinal", "text") == {(1, 1, "a | b,"), (1, 2, "c"), (1, 4, "d | e")}


def test_noise(spark):
    t = spark.createDataFrame([("{\\rtf1 x",), ("plain words here",), ("key=" + "0a" * 24,), (None,)], "t string")
    markup, opaque = extraction.noise_flags(F.col("t"))
    got = t.select("t", markup.alias("m"), opaque.alias("o"))
    assert rows(got, "m", "o") == {(True, False), (False, False), (False, True)}


def test_names(spark):
    q = spark.createDataFrame([(1, "What is MCP v2 in the RAG rag 2024?"), (2, None)], "i int, t string")
    assert {r.i: r.e for r in q.select("i", names.query_entities(F.col("t")).alias("e")).collect()} == {1: ["mcp", "v2", "rag"], 2: []}
    items = spark.createDataFrame([("归航",), ("它不仅好",), ("a, b, c",), ("Ends!",), ("",), (None,)], "t string")
    assert rows(items.filter(names.entity_like(F.col("t"))), "t") == {("归航",)}
    f = spark.createDataFrame([(1, "Report.pdf", "c:\\work\\Report.pdf"), (2, "reprt.txt", "c:\\report\\reprt.txt"), (3, None, None)], "file_id int, display_name string, canonical_path string")
    s = spark.createDataFrame([(1, "report"), (2, ""), (3, None), (4, "rk")], "query_id int, text string")
    assert rows(names.name_search(s, f), "query_id", "file_id", "channel") == {(1, 1, "filename"), (1, 2, "path"), (1, 2, "filename_fuzzy"), (4, 1, "path")}
    assert names.name_search(s, f.limit(0)).count() == 0


def test_sections(spark):
    n = spark.createDataFrame([(1, 1, '["a", " b "]'), (1, 2, '["b"]'), (1, 3, "[bad"), (1, 4, '["c"]'), (1, 5, "[]"), (1, 6, None)], "doc_id int, ordinal int, heading_path string")
    assert rows(names.section_titles(n), "place", "title") == {(1, "b"), (2, "c")}


def test_roles_and_containment(spark):
    g = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "group_id int, file_id int")
    f = spark.createDataFrame([(1, 10), (2, 30), (3, 20), (4, None)], "file_id int, modified_at int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "file_id int, vector array<double>")
    assert rows(relations.version_roles(g, f, v), "file_id", "role") == {(1, "copy"), (2, "latest"), (3, "version"), (4, "latest")}
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a", "c"]), (3, ["a", "b"]), (4, ["z"]), (5, []), (6, None)], "file_id int, terms array<string>")
    assert rows(relations.containment_pairs(t), "left_file_id", "right_file_id", "confidence") == {(1, 2, 1.0)}


def test_prototypes_and_failures(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None)], "file_id int, vector array<double>")
    p = spark.createDataFrame([("x", [1.0, 0.1]), ("y", [0.0, 1.0])], "type string, vector array<double>")
    assert rows(profiles.type_prototype_scores(v, p), "file_id", "type") == {(1, "x")}
    assert profiles.type_prototype_scores(v, p.limit(0)).count() == 0
    r = spark.createDataFrame([(1, False, "a", "one"), (2, False, None, None), (3, True, "a", "two"), (4, False, "a", "three")], "case_id int, passed boolean, category string, diagnosis string")
    assert rows(traces.analyze_failures(r, ["a", "other"]), "category", "failed", "diagnoses", "top") == {("a", 2, "one; three", True), ("other", 1, None, True)}
    lines = spark.createDataFrame([(1, 1, "image", "", 0.9), (2, 1, "pdf_scanned_page", "abc", None), (3, 1, "pdf_scanned_page", "abc", 0.9)], "asset_id int, page int, kind string, text string, confidence double")
    assert rows(traces.ocr_routing(lines), "asset_id", "fallback", "needs_vision") == {(1, "ocr_no_text", True), (2, "ocr_confidence_missing", True), (3, None, False)}
