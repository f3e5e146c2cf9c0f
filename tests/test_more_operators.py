"""Small cases of chunking, collections, evidence, and inventory operators, nulls and empty tables included."""

from pyspark.sql import functions as F

from docspark.operators import chunking, collections, evidence, inventory, profiles


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_cut():
    assert chunking.cut("") == [] and chunking.cut(" \n ") == [] and chunking.cut("abc") == ["abc"]
    pieces = chunking.cut("归航计划" * 150)
    assert len(pieces) == 2 and all(len(p) <= 480 for p in pieces)
    assert pieces[0][-64:] == pieces[1][:64]
    text = "归" * 400 + "。" + "航" * 300
    assert chunking.cut(text)[0] == "归" * 400 + "。"
    long = "ab cd。\n" * 3000
    got = chunking.cut(long)
    assert all(chunking.weights(p).sum() <= 480 * 4 for p in got) and got[-1].endswith("cd。")


def test_chunk_nodes_and_cap(spark):
    nodes = spark.createDataFrame([(1, 10, 2, "b"), (1, 11, 1, "归航计划" * 150), (1, 12, 3, None), (2, 13, 1, "")], "revision_id int, node_id int, ordinal int, text string")
    assert [(r.ordinal, r.node_id) for r in chunking.chunk_nodes(nodes).orderBy("ordinal").collect()] == [(1, 11), (2, 11), (3, 10)]
    capped = nodes.select("node_id", chunking.cap_tokens(F.col("text"), 5).alias("t"))
    assert rows(capped, "node_id", "t") == {(10, "b"), (11, "归航计划归"), (12, None), (13, "")}


def test_mmr(spark):
    c = spark.createDataFrame([(1, 1, 1, 1.0, "a b c"), (1, 2, 2, 0.99, "a b c"), (1, 3, 3, 0.9, "x y z"), (2, 1, 4, 0.5, None)], "query_id int, file_id int, chunk_id int, fused double, text string")
    assert rows(chunking.mmr_select(c, 2), "query_id", "chunk_id", "place") == {(1, 1, 1), (1, 3, 2), (2, 4, 1)}


def test_rules(spark):
    f = spark.createDataFrame([(1, "a.pdf", "c:\\x\\a.pdf", "pdf", "parsed", 10), (2, None, None, None, None, None)], "file_id int, display_name string, canonical_path string, extension string, parse_status string, size_bytes long")
    rules = [{"collection_id": "p", "extensions": ["PDF"], "min_size_bytes": 5}, {"collection_id": "any", "operator": "any"}, {"collection_id": "all"}]
    assert rows(collections.apply_rules(f, rules, "2024-01-01"), "collection_id", "file_id") == {("p", 1), ("all", 1), ("all", 2)}
    assert collections.apply_rules(f.limit(0), rules, "2024-01-01").count() == 0


def test_claims(spark):
    claims = spark.createDataFrame([(1, "Budget 50 plan alpha"), (2, "Budget 51 plan alpha"), (3, "abc"), (4, None)], "claim_id int, text string")
    quotes = spark.createDataFrame([(1, 1, "the plan alpha has"), (1, 2, "budget 50"), (2, 1, "budget 50 plan alpha"), (3, 1, "abc"), (4, 1, "x")], "claim_id int, ordinal int, text string")
    assert rows(evidence.claim_support(claims, quotes), "claim_id", "supported") == {(1, True), (2, False), (3, False), (4, False)}


def test_merge_memory(spark):
    schema = "key string, target_id long, status string, source_type string, hit_count long, updated_at long"
    cur = spark.createDataFrame([("a", 1, "confirmed", "user_explicit", 2, 1)], schema)
    new = spark.createDataFrame([("a", 2, "confirmed", "model_inference", 3, 9), ("b", 3, "confirmed", "document_inference", 1, 1)], schema)
    assert rows(evidence.merge_memory(cur, new), "key", "target_id", "status", "hit_count") == {("a", 1, "confirmed", 5), ("b", 3, "candidate", 1)}


def test_apply_events_twice(spark):
    cat = spark.createDataFrame([("r", "p", "present", None)], "root_id string, path string, availability string, last_ts timestamp")
    ev = spark.sql("select 'r' root_id, 'p' path, timestamp'2024-01-01' ts, 1 event_id, 'removed' event_type union all select 'r', 'q', timestamp'2024-01-02', 2, 'created'")
    once = inventory.apply_events(cat, ev)
    assert rows(once, "path", "availability") == {("p", "missing"), ("q", "present")}
    assert rows(inventory.apply_events(once, ev), "path", "availability", "last_ts") == rows(once, "path", "availability", "last_ts")


def test_job_history(spark):
    h = spark.createDataFrame([(1, 1, "queued", 0.0, 0, 5), (1, 2, "running", 0.5, 6, 5), (1, 3, "queued", 2.0, 1, None), (1, 4, None, None, None, None), (2, 1, "done", 1.0, 1, 1)], "job_id int, seq int, status string, progress double, processed long, total long")
    assert rows(inventory.job_transition_violations(h), "job_id", "seq", "problem") == {(1, 2, "counts"), (1, 3, "transition"), (1, 3, "progress")}


def test_classify_types(spark):
    schema = "file_id int, type string, score double"
    rule = spark.createDataFrame([(1, "a", 0.2), (2, "a", 0.9), (3, "a", 0.6), (4, "a", 0.1)], schema)
    proto = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.8), (3, "b", 0.6), (5, "b", 0.66), (6, "b", 0.6)], schema)
    got = rows(profiles.classify_types(rule, proto), "file_id", "document_type", "confidence")
    assert got == {(1, "a", 0.8), (2, "b", 0.8), (3, "a", 0.6), (4, None, None), (5, "b", 0.66), (6, None, None)}
