"""Golden rows of the library's functions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import catalog, evaluation, hybrid, incremental, lexical, relations, vectors
from docspark.sources import files as S
from docspark.streaming.events import coalesce_events_stream


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first().x


def test_terms(spark):
    got = one(spark, "归航计划 RRF-60", T.normalize_terms)
    assert {"归航", "航计", "计划", "rrf", "60", "归"} <= set(got)
    q = lexical.query_terms(spark.createDataFrame([(1, "归航计划"), (2, "a b")], "query_id long, text string"))
    assert {(r.query_id, r.term) for r in q.collect()} == {(1, "归航"), (1, "航计"), (1, "计划"), (2, "a"), (2, "b")}


@pytest.mark.parametrize(("text", "tokens", "script"), [("abcd", 1, "en"), ("归航 ab", 3, "mixed"), ("", 1, "unknown"), ("归", 1, "zh"), ("ab-c", 2, "en")])
def test_estimate_and_script(spark, text, tokens, script):
    assert (one(spark, text, T.token_estimate), one(spark, text, T.detect_script)) == (tokens, script)


def test_paths(spark):
    assert one(spark, "\\\\?\\C:\\A/b\\", T.path_key) == "c:\\a\\b"
    assert one(spark, "\\\\?\\UNC\\srv\\x", T.path_key) == "\\\\srv\\x"
    assert one(spark, "C:\\a\\b\\c\\d.txt", T.display_path) == "…\\b\\c\\d.txt"
    assert one(spark, "Plan v2 (1).docx", T.version_key) == "plan"
    assert one(spark, "abc", T.fnv1a32) == 0x1A47E90B
    assert one(spark, "", T.fnv1a32) == 2166136261


def test_search_metrics(spark):
    rows = [("a", ["x"], ["x", "y"], 500), ("b", ["z"], ["q", "z"], 2500)]
    r = evaluation.search_metrics(spark.createDataFrame(rows, "case_id string, relevant array<string>, returned array<string>, elapsed_ms long")).first()
    assert (r.recall, r.mrr, r.p95_ms) == (1.0, 0.75, 2500) and r.ndcg > 0.8


def test_run_metrics(spark):
    rows = [("f", True, x) for x in (500, 1000, 2000, 8000)]
    r = evaluation.run_metrics(spark.createDataFrame(rows, "feature string, passed boolean, latency_ms long")).first()
    assert (r.p50_ms, r.p95_ms, r.pass_rate) == (2000, 8000, 1.0)


def events(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("r", "created", "p", at(0), 1), ("r", "modified", "p", at(1), 2), ("r", "modified", "q", at(1), 3), ("r", "removed", "q", at(2), 4), ("r", "modified", "p", at(4), 5), ("s", "modified", "p", at(0), 6), ("s", "renamed", "p", at(1.999), 7)]
    return spark.createDataFrame(rows, "root_id string, event_type string, path string, ts timestamp, event_id long")


WANT = {("r", "p", "created"), ("r", "q", "removed"), ("r", "p", "modified"), ("s", "p", "renamed")}


def test_coalesce(spark):
    got = incremental.coalesce_events(events(spark)).collect()
    assert {(r.root_id, r.path, r.event_type) for r in got} == WANT and len(got) == 4


def test_coalesce_stream(spark, tmp_path):
    events(spark).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events(spark).schema).parquet(f"{tmp_path}/in")
    q = coalesce_events_stream(stream, "1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    late = spark.createDataFrame([("z", "modified", "p", dt.datetime(2024, 1, 2), 99)], events(spark).schema)
    late.write.mode("append").parquet(f"{tmp_path}/in")
    q = coalesce_events_stream(stream, "1 second").writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.root_id, r.path, r.event_type) for r in got} == WANT


def test_fuse(spark):
    rows = [(1, 1, 1, 9, 5, "filename", 0.5), (1, 2, 1, 9, 5, "semantic", 0.9), (1, 2, 2, 8, 6, "semantic", 0.8), (1, 2, 3, 7, 4, "semantic", 0.7)]
    h = spark.createDataFrame(rows, "query_id long, channel int, place int, file_id long, chunk_id long, reason string, score double")
    got = {r.chunk_id: r for r in hybrid.fuse_channels(h).collect()}
    assert len(got) == 3 and got[5].reasons == "filename,semantic" and got[5].fused == pytest.approx(2.45 / 61, abs=1e-9)


def test_relations_and_snapshot(spark):
    f = spark.createDataFrame([(1, "h", "a v1.txt"), (2, "h", "b.txt"), (3, "h", "c.txt"), (4, "g", "a v2.txt"), (5, None, "1.txt")], "file_id long, content_sha256 string, display_name string")
    assert {(r.left_file_id, r.right_file_id) for r in relations.exact_duplicate_pairs(f, "chain").collect()} == {(1, 2), (2, 3)}
    assert {(r.left_file_id, r.right_file_id) for r in relations.version_pairs(f).collect()} == {(1, 4)}
    s = lambda rows: spark.createDataFrame(rows, "file_key long, path string, content_sha256 string, present boolean")
    got = incremental.snapshot_diff(s([(1, "a", "h", True), (2, "b", "h", True), (3, "c", "h", False), (4, "d", "h", True)]), s([(1, "x", "h", True), (2, "b", "g", True), (3, "c", "h", True), (5, "e", "h", True)]))
    assert {(r.file_key, r.change) for r in got.collect()} == {(1, "renamed"), (2, "modified"), (3, "restored"), (4, "missing"), (5, "discovered")}


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "id long, vector array<float>").repartition(3)
    q = v.filter("id < 4").withColumnRenamed("id", "query_id")
    rows = vectors.vector_topk(q, v, 5, block=2).collect()
    exact = q.crossJoin(v.withColumnRenamed("vector", "w")).select("query_id", "id", F.round((1 + vectors.cosine(F.col("vector"), F.col("w"))) / 2, 6).alias("s")).collect()
    for k in range(4):
        want = sorted((-r.s, r.id) for r in exact if r.query_id == k)[:5]
        assert [(-r.score, r.id) for r in sorted(rows, key=lambda r: r.place) if r.query_id == k] == want


def test_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n{"case_id": "a"}\n{bad\n')
    good, bad = S.read_eval_cases(spark, f"{tmp_path}/c.jsonl", "case_id string")
    assert [r.case_id for r in good.collect()] == ["a"] and bad.count() == 1
    (tmp_path / "l.jsonl").write_text('{"level":"WARN","event":"x","sequence":1}\nnope\n')
    assert [(r.level, r.event) for r in S.read_runtime_log(spark, f"{tmp_path}/l.jsonl").collect()] == [("warning", "x")]
    S.export_table(spark.createDataFrame([(1, [1, 2], None)], "a int, b array<int>, c string"), f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").first().b == "[1,2]"
    with pytest.raises(Exception, match="(?i)exist"):
        S.export_table(spark.range(1).toDF("a"), f"{tmp_path}/out")
    assert {r.extension for r in S.scan_inventory(spark, str(tmp_path)).filter("display_name like '%.jsonl'").collect()} == {"jsonl"}


def test_roots(spark):
    f = spark.createDataFrame([(1, "C:\\a\\b\\x.txt"), (2, "C:\\ab\\y.txt")], "file_id long, canonical_path string")
    r = spark.createDataFrame([("p", "C:\\a"), ("q", "c:/a/b/")], "root_id string, path string")
    assert sorted(tuple(x) for x in catalog.assign_roots(f, r).collect()) == [(1, "p", "b\\x.txt", False), (1, "q", "x.txt", True)]
