"""Recall, answers, memory and questions on small cases with known results, Han text among them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import answers, extraction, memory, questions, recall, relations, topics


def test_decoding(spark):
    rows = [(1, "语言 ab".encode()), (2, b"\xef\xbb\xbfmark"), (3, "中文，测试 ok".encode("gb18030")), (4, b"abc\xff"), (5, None), (6, b""), (7, ("长" * 50_000).encode("gb18030"))]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, c binary").select("id", extraction.decode_text(F.col("c")).alias("t")).collect()}
    assert got == {1: "语言 ab", 2: "mark", 3: "中文，测试 ok", 4: "abc\ufffd", 5: None, 6: "", 7: "长" * 50_000}


def test_pages(spark):
    pages = [(1, "<p>a</p>b<div class='x'>c&amp;d&nbsp;e</div><script>if (a<b) x</script><STYLE>p{}</STYLE >f"), (2, "&#65;&#x4E2D;&lt;p&gt;&amp;lt;&hellip;&hellipx"), (3, None), (4, "x<!-- <p>no --> y<script>open"), (5, "<pre>k</pre><br/>l<h1>m</h1>")]
    got = {r.page_id: r.text for r in extraction.html_visible_text(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert got == {1: "ab c&d ef", 2: "A中<p>&lt;…&hellipx", 3: None, 4: "x y", 5: "k l m"}


def test_delimited(spark):
    text = 'a,"b, ""c""\nd",e\r\n\r\n,f,\n"x"y,z'
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "one")], "doc_id int, text string")
    rows = {(r.doc_id, r.row): r.cells for r in extraction.delimited_rows(docs).collect()}
    assert rows[1, 0] == ["a", 'b, "c"\nd', "e"] and ["", "f", ""] in rows.values() and ["xy", "z"] in rows.values() and rows[4, 0] == ["one"]
    assert [r.text for r in extraction.delimited_to_nodes(docs.filter("doc_id = 1")).orderBy("ordinal").collect()] == ['a | b, "c"', "d | e", "| f |", "xy | z"]


def test_code(spark):
    code = "import x\n\npub async fn go() {\n}\nclass A:\n  pass\n"
    docs = spark.createDataFrame([(1, code), (2, "\n".join(f"line {i}" for i in range(250))), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.ordinal, r.symbol, r.line_start, r.line_end) for r in extraction.code_to_nodes(docs).orderBy("doc_id", "ordinal").collect()]
    assert got == [(1, 1, None, 1, 2), (1, 2, "go", 3, 4), (1, 3, "A", 5, 6), (2, 1, None, 1, 120), (2, 2, None, 121, 240), (2, 3, None, 241, 250)]


def test_media_types(spark):
    rows = [("pdf", b"", "application/pdf"), ("kt", b"MZ", "text/plain"), ("", b"%PDF-1.4", "application/pdf"), ("dat", b"\x89PNG\r\n\x1a\n", "image/png"), ("x", b"MZ\x90", "application/vnd.microsoft.portable-executable"), ("x", "文字\n".encode(), "text/plain"), ("x", b"a\x01" * 50, "application/octet-stream"), ("x", b"\xff\xfe", "application/octet-stream"), ("x", b"", "application/octet-stream"), ("x", None, "application/octet-stream"), ("x", b"SQLite format 3\x00zz", "application/vnd.sqlite3")]
    df = spark.createDataFrame(rows, "e string, c binary, want string").select("want", extraction.detect_mime(F.col("e"), F.col("c")).alias("got"))
    assert all(r.want == r.got for r in df.collect())


PROFILE = "file_id long, display_name string, title string, document_type string, type_name string, keywords array<string>, section_titles array<string>, entities array<string>, summary string"


def test_metadata_scores(spark):
    p = spark.createDataFrame([(1, "述职报告备份.docx", "", "report", "报告", ["预算"], ["总结"], [], None), (2, "x.md", "合", None, None, None, None, None, ""), (3, "notes.txt", "Budget", "paper", "论文", ["a"], ["目标"], ["张三"], "找一下述职")], PROFILE)
    q = spark.createDataFrame([(1, "找一下述职报告"), (2, "报"), (3, " 张三的预算 "), (4, ""), (5, None)], "question_id long, text string")
    got = {(r.question_id, r.file_id): (r.score, r.signals) for r in recall.metadata_scores(q, p).collect()}
    assert got == {(1, 1): (0.8, "title_match,type_match"), (1, 3): (0.15, "summary_match"), (2, 1): (0.45, "title_match"), (3, 1): (0.3, "keyword_match"), (3, 3): (0.2, "entity_match")}


def test_best_without_all_pairs(spark):
    r = random.Random(7)
    some = lambda words, k: r.sample(words, r.randrange(k + 1)) or None
    words = ["合同", "预算", "report", "AI", "ab", "plan b", "项目", "a", " 总结 ", "长长长的标题文字"]
    rows = [(i, r.choice(["Doc 1.txt", "Doc 合同.md", f"x{i % 9}.pdf", "zz", None]), r.choice(["t", "AI plan", None, ""]), r.choice(["report", "paper", None]), r.choice(["报告", "论文", None]), some(words, 3), some(words, 2), some(words, 2), r.choice([None, "预算 report", "ab", "x"])) for i in range(160)]
    rows += [rows[3]] * 2
    p = spark.createDataFrame(rows, PROFILE).dropDuplicates(["file_id"])
    asked = ["Doc 的合同 report 预算", "AI plan b", "论文", "合", "D", "zz top", "", None, "长长长的标题文字 项目 报告 x1.pdf", "ab"]
    q = spark.createDataFrame(list(enumerate(asked)), "question_id long, text string")
    want = sorted(tuple(x) for x in recall.best(recall.metadata_scores(q, p), 7).collect())
    for common in (2, 25, 1000):
        assert sorted(tuple(x) for x in recall.best_by_metadata(q, p, 7, common).collect()) == want
    assert recall.best_by_metadata(q, p.limit(0)).collect() == [] and recall.best_by_metadata(q.limit(0), p).collect() == []


def test_scores_are_capped_and_types_by_rule(spark):
    p = spark.createDataFrame([(1, "合同.pdf", "合同", "contract", "合同", ["合同"], ["合同"], ["合同"], "合同")], PROFILE)
    got = recall.metadata_scores(spark.createDataFrame([(1, "这份合同")], "question_id long, text string"), p).first()
    assert got.score == 0.9 and got.signals.count(",") == 5 and "type_match" in got.signals
    best = recall.type_rule_scores(p.withColumn("head", F.lit("甲方 乙方"))).first()
    assert (best.type, best.score) == ("contract", 1.0)


def test_sections(spark):
    rows = [(1, i, h, "x" * n) for i, (h, n) in enumerate([(None, 10), ("A", 4000), ("a ", 3000), ("A", 10), ("B", 5), (None, 5)])] + [(2, i, f"h{i}", "y") for i in range(40)]
    got = recall.document_sections(spark.createDataFrame(rows, "doc_id long, ordinal long, heading string, text string")).orderBy("doc_id", "section").collect()
    assert [(r.title, r.chunks, r.bytes) for r in got if r.doc_id == 1] == [("未命名内容", 1, 10), ("A", 2, 7000), ("A（续 1）", 1, 10), ("B", 1, 5), ("未命名内容", 1, 5)]
    assert [r.chunks for r in got if r.doc_id == 2] == [1] * 29 + [11] and got[-1].title == "其余内容"


def test_entities_and_answers(spark):
    rows = [("rag", "we store fragments in storage", False), ("rag", "uses rag, well", True), ("rag", "检索增强生成", True), ("ai", "detail", False), ("agent", "multiagents", True), ("bm25", "best matching 25", True)]
    df = spark.createDataFrame(rows, "e string, t string, want boolean").select("want", answers.appears(F.col("e"), F.col("t")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
    q = spark.createDataFrame([(1, "What is RAG", False), (2, "RAG and LangGraph?", False), (3, "做过 Agent 项目吗", True), (4, "怎么办", False), (5, "x2 y2", False)], "question_id long, text string, needs_project boolean")
    e = spark.createDataFrame([(1, "检索增强", None), (2, "rag only", "h"), (3, "agent 是一种程序", None), (4, "内容", None)], "question_id long, text string, heading string")
    got = {r.question_id: (r.status, r.confidence, r.missing) for r in answers.answerability(q, e).collect()}
    assert got == {1: ("answerable", 0.9, ""), 2: ("partial", 0.45, "langgraph"), 3: ("not_answerable", 0.2, ""), 4: ("answerable", 0.55, ""), 5: ("not_answerable", 0.0, "")}
    hits = spark.createDataFrame([(1, i + 1, f, t) for i, (f, t) in enumerate([(1, "a"), (2, r"{\rtf1 x}"), (1, "a"), (3, "c"), (2, r"{\rtf1 x}"), (4, "d")])], "question_id long, place int, file_id long, quote string")
    assert [(r.claim, r.file_id, r.text) for r in answers.extractive_answer(hits, 5, 2).orderBy("claim").collect()] == [(1, 1, "a"), (2, 2, r"{\rtf1 x}"), (3, 1, "a")]


def test_memory(spark):
    q = spark.createDataFrame([(1, "我 的大项目 计划"), (2, "A"), (3, None)], "question_id long, text string")
    a = spark.createDataFrame([("项目", "file", 1, 0.5), ("大 项目", "file", 2, 0.5), ("大项目", "file", 3, 0.5), ("a", "file", 4, 0.5), (None, "file", 5, 0.5)], "alias string, target_type string, target_id long, confidence double")
    assert sorted((r.question_id, r.alias, r.target_id) for r in memory.match_aliases(q, a).collect()) == [(1, "大项目", 2), (1, "大项目", 3), (2, "a", 4)]


def test_questions(spark):
    rows = [("ＡＢ１ 项目 report", ["AB1 项目 report", "AB1 项目report", "ab1 项目report"]), ("我de文件", ["我的文件"]), ("plain", []), (" ", [])]
    for text, want in rows:
        got = spark.createDataFrame([(text,)], "t string").select(questions.query_variants(F.col("t")).alias("v")).first().v
        assert set(want) <= set(got) | {text.strip()} and len(got) <= 4 and len(set(got)) == len(got)
    tags = questions.query_tags(spark.createDataFrame([(1, "我的简历里有没有提到 Python 项目"), (2, None)], "question_id long, text string")).orderBy("question_id").collect()
    assert (tags[0].intents, tags[0].personal, tags[0].document_type, tags[0].tokens) == ("exists", "我的", "resume", ["简历", "python", "项目"])
    assert (tags[1].intents, tags[1].document_type, tags[1].tokens) == ("", None, [])
    items = spark.createDataFrame([(1, "abc def ghi"), (2, "zzz")], "item_id long, text string")
    got = questions.align_items(items, spark.createDataFrame([(1, "xx abcdefg yy"), (2, "abc d efgh"), (3, None)], "chunk_id long, text string")).collect()
    assert [(r.item_id, r.chunk_id, r.overlap) for r in got] == [(1, 2, 8)]


def test_pairs_groups_and_lsh(spark):
    r = random.Random(2)
    v = [[r.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, "b", [x + r.gauss(0, 0.25) for x in v[i % 12]]) for i in range(120)] + [(500, "b", None)]
    df = spark.createDataFrame(rows, "file_id long, bucket string, vector array<double>").filter("vector is not null")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if round(cos(rows[i][2], rows[j][2]), 6) >= 0.8}
    for part in (1000, 16):
        got = [(x.left_file_id, x.right_file_id) for x in topics.semantic_pairs(df, 0.8, part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    kept, every = topics.block_share(df, 0.8, 16)
    assert kept < every
    groups = topics.seed_expand_groups(df, df.filter("file_id < 5"), 0.8, 4).collect()
    files = [g.file_id for g in groups] + list({g.seed_file_id for g in groups})
    assert groups and len(files) == len(set(files)) and min(files) >= 5
    top, left = topics.refresh_suggestions(spark.createDataFrame(groups), df.filter("file_id = 7"), 3)
    assert {x.place for x in top.collect()} == {1, 2, 3} and left.first().remaining > 0
    q = df.filter("file_id % 6 = 0").select(F.col("file_id").alias("query_id"), "vector")
    near = topics.vector_topk_lsh(q, df.select(F.col("file_id").alias("id"), "vector"), 5, 16).collect()
    exact = {(i, j) for i in range(0, 120, 6) for j in sorted(range(120), key=lambda j: (-round((1 + cos(rows[i][2], rows[j][2])) / 2, 6), j))[:5]}
    assert len(exact & {(x.query_id, x.id) for x in near}) >= 0.9 * len(exact)


def one_pass(rows, threshold, k):
    """Groups of one bucket (id, vector) taken one after the other."""
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows])
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = np.round(v @ v.T, 6)
    np.fill_diagonal(near, -2.0)
    mean = np.round((v @ v.sum(axis=0) - 1) / max(1, len(ids) - 1), 6)
    free, out = set(range(len(ids))), []
    for s in sorted(range(len(ids)), key=lambda i: (-near[i].max(), -mean[i], ids[i])):
        if s in free:
            got = sorted((o for o in free if o != s and near[s, o] >= threshold), key=lambda o: (-near[s, o], ids[o]))[:k]
            if got:
                free -= {s, *got}
                out += [(ids[s], ids[o], near[s, o]) for o in got]
    return out


@pytest.mark.parametrize("threshold,k,seeds", [(0.3, 3, 2), (0.1, 5, 3), (0.6, 2, 256)])
def test_groups_as_in_one_pass(spark, threshold, k, seeds):
    r = np.random.default_rng(int(10 * threshold))
    rows = [(i, int(i % 3), r.standard_normal(6).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "file_id long, bucket int, vector array<double>")
    got = topics.seed_expand_groups(df, df.filter("file_id % 10 = 4"), threshold, k, seeds=seeds).collect()
    want = [g for b in range(3) for g in one_pass([(i, v) for i, c, v in rows if c == b and i % 10 != 4], threshold, k)]
    assert sorted((x.seed_file_id, x.file_id, x.similarity) for x in got) == sorted(want)
    assert topics.seed_expand_groups(df.limit(0), df, threshold, k).collect() == []


def test_longest_common_runs(spark):
    r = random.Random(9)
    text = lambda n: "".join(r.choice("ab c长\t") for _ in range(n))
    plain = lambda t: "".join(t.split())
    common = lambda a, b: max((n for n in range(len(a) + 1) for k in range(len(a) - n + 1) if a[k : k + n] in b), default=0)
    for _ in range(60):
        a, b = text(r.randrange(40)), text(r.randrange(40))
        assert questions.Substrings(a).longest_in(b) == common(a, b)
    items, chunks = [(i, text(60)) for i in range(12)] + [(50, None), (51, "ab")], [(i, text(50)) for i in range(60)] + [(70, None), (71, "")]
    want = []
    for i, a in items:
        best = max(((common(plain(a), plain(b or "")), -k) for k, b in chunks), default=(0, 0)) if a else (0, 0)
        if best[0] >= 6:
            want.append((i, -best[1], best[0]))
    frames = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((items, "item_id"), (chunks, "chunk_id"))]
    for rows in (4096, 3):
        assert sorted(tuple(x) for x in questions.align_items(*frames, rows=rows).collect()) == want


def test_containment_in_pieces(spark):
    r = random.Random(6)
    sets = [sorted({f"t{int(r.paretovariate(0.7)) % 40}" for _ in range(r.randrange(1, 30))}) for _ in range(140)]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {(i, j) for a, i in first.items() for b, j in first.items() if len(b) > len(a) and round(len(set(a) & set(b)) / len(a), 6) >= 0.8}
    df = spark.createDataFrame(list(enumerate(sets)), "file_id long, terms array<string>")
    for rows in (4096, 5):
        got = [(x.left_file_id, x.right_file_id) for x in relations.containment_pairs(df, 0.8, rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
