"""Nulls, empty and repeated rows, empty tables and clashing columns for the operators with SQL oracles."""

import hashlib
import re

import pytest

from docspark.llm import exact_dedup, mixing, quality, toxicity, url_reputation

ROWS = [(1, "a b", "s0"), (2, "ab ", "s0"), (3, None, None), (4, "", "s1"), (2, "ab ", "s0"), (None, "a  b", "s2"), (6, "x " * 300, "s1"), (7, " ".join(f"w{i}" for i in range(80)), "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "'c' as content", "0 as row", "1L as size", "2L as target", "'k' as key").repartition(3)


def test_exact(docs):
    rows = exact_dedup.exact_duplicates(docs).collect()
    ab = [r for r in rows if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()]
    assert len(rows) == 8 and len(ab) == 4 and sum(r.kept for r in ab) == 1
    assert {r.group_size for r in ab} == {4} and {r.keep_id for r in ab} == {None}
    assert sorted(r.doc_id for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()) == [3, 4]
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_quality(docs):
    rows = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert rows[None].n_words == 2 and not rows[None].kept
    assert (rows[6].n_words, rows[6].n_repeat_words, rows[6].base_failed) == (300, 300, True)
    assert rows[7].kept and not rows[3].kept and rows[3].n_words == 0
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [7]
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_boilerplate(spark):
    line = "shared line of five words"
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, f"{line}\n{own(i, 60)}" if i else "\n".join([line] * 1 + [own(0, 1)] + [f"{line} {k}" for k in range(12)]), "h") for i in range(30)]
    got = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_min_docs=5).collect()}
    assert all(got[i].removed_words == 5 for i in range(30)) and all(got[i].kept for i in range(1, 30))


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(r["size"] for r in rows) == sorted(len(re.findall(r"\S+", t or "")) for _, t, _ in ROWS)
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert [r.taken for r in rows if r["size"] == 0] == [0, 0]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_urls(spark):
    urls = ["http://A.example.com/en/x?q", "http://www.example.com/en/1", "https://x.net/es/9#a", "noscheme", None, "http://h.org", "ftp://b.co.uk:8/p", "http://me@b.co.uk./q"]
    pages = spark.createDataFrame([*enumerate(urls), (5, "http://h.org"), (None, "http://h.org/n")], "page_id long, url string").selectExpr("*", "1 as n", "'z' as host", "'h' as h")
    got = url_reputation.judge_urls(pages, spark.createDataFrame([(5, 0), (6, None), (None, 1)], "page_id long, good int")).collect()
    rows = {r.page_id: r for r in got}
    assert len(got) == 10 and sorted(str(r.page_id) for r in got if r.host == "h.org") == ["5", "5", "None"]
    assert [rows[i].rule for i in range(8)] == ["example.com/en/", "www.example.com/en/", "net/es/", *[None] * 5]
    assert (rows[0].host, rows[0].path, rows[0].verdict) == ("a.example.com", "/en/x", "block") and rows[1].verdict == "allow"
    assert (rows[3].host, rows[3].path) == ("", "") == (rows[4].host, rows[4].path)
    assert (rows[6].host, rows[7].host) == ("b.co.uk:8", "me@b.co.uk.") and rows[6].good_rate == rows[7].good_rate
    assert url_reputation.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, good int")).count() == 0


def test_bad_hosts_are_blocked(spark):
    """Many bad labels block a host, and its unlabelled sibling under the same domain more than one elsewhere."""
    rows = [(i, f"http://{h}/p{i}", g) for i, (h, g) in enumerate([("bad.spam.org", 0)] * 40 + [("a.fine.org", 1)] * 60 + [("b.fine.org", 1)] * 60 + [("new.spam.org", None), ("new.fine.org", None)])]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string")
    got = {r.host: r for r in url_reputation.judge_urls(pages, spark.createDataFrame([(i, g) for i, _, g in rows], "page_id long, good int")).collect()}
    assert got["bad.spam.org"].verdict == "block" and got["a.fine.org"].verdict == got["b.fine.org"].verdict == "allow"
    assert got["new.spam.org"].good_rate < got["new.fine.org"].good_rate


def test_toxicity(spark):
    words = lambda i: [f"w{(i * 31 + k * 7) % 211}" for k in range(40)]
    rows = [(i, " ".join(words(i) + (["dreadfool"] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, labels, toxicity.Settings(buckets=1 << 12)).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert held and sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.9 * len(held)
    assert got[900].score == got[901].score and len(got) == 242
    assert {r.score for r in toxicity.detect(docs, labels.limit(0)).collect()} == {0.5}


def test_toxicity_sample_of_repeated_rows(spark):
    rows = [(1, "bad words here", "x")] * 400 + [(2, "good words", "x")] * 300 + [(3, None, "x"), (None, "no id", "x"), (4, "", "x"), (5, "long " * 9000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels, toxicity.Settings())
    assert sorted(zip(texts, toxic.tolist(), strict=True)) == [("bad words here", 1), ("good words", 0)]
    out = toxicity.detect(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
