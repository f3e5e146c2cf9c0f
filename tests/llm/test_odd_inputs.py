"""Repeated rows, null ids, very long texts, empty tables and clashing columns, for operators that had no such test."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from docspark.llm import exact_dedup, line_dedup, packing, suffix_dedup, token_counts, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, key string, item string, n_tokens string, row string"
LONG = "one long text of words " * 30_000


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "p", "k", "i", "n", "r") for i, t in rows], SCHEMA)


ROWS = [(1, "a line that is long enough\nanother line, as long"), (1, "a line that is long enough\nanother line, as long"), (None, "a text without an id, long enough"), (2, None), (3, ""), (4, LONG), (5, "short")]


def test_token_lengths_and_packing(spark):
    df = table(spark, ROWS).repartition(2)
    encoder = Tokenizer.from_file(tokens.default_path())
    want = Counter((i, len(encoder.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert Counter((r.doc_id, r.n_tokens) for r in token_counts.token_lengths(df).collect()) == want
    pieces = packing.pack(df).collect()
    sizes = Counter()
    for r in pieces:
        sizes[r.doc_id] += r.length
    assert sizes == Counter({i: sum((n + 1) * c for (j, n), c in want.items() if j == i) for i, _ in ROWS})
    used = Counter()
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024
    assert packing.pack(df.limit(0)).collect() == [] and token_counts.token_lengths(df.limit(0)).collect() == []


def test_line_classes(spark):
    out = line_dedup.near_lines(table(spark, ROWS)).collect()
    assert Counter(r.doc_id for r in out) == {1: 4, None: 1, 4: 1, 5: 1}
    assert sum(r.kept for r in out) == 7  # rows of one id and number are one line
    assert line_dedup.near_lines(table(spark, [])).collect() == []


def test_exact_and_repeated_passages(spark):
    rows = [(1, LONG), (2, LONG + " "), (3, "x"), (3, "x"), (4, None), (5, "")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(table(spark, rows)).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (4, 4, 2, True), (5, 4, 2, False)} <= got
    text = "".join(chr(97 + (i * i * 7 + i // 11) % 26) for i in range(150_000))
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, [(1, text), (2, "y" + text[70_000:71_000] + "z"), (3, None)])).collect()}
    assert (out[2].n_bytes, out[2].n_spans, out[3].n_bytes) == (1002, 1, 0) and out[2].n_removed >= 1000
    assert out[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_pipeline(spark, tmp_path, kind):
    words = lambda seed, n: " ".join(f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))
    rows = [] if kind == "empty" else [(1, words(1, 80)), (1, words(1, 80)), (2, words(2, 90)), (None, words(3, 70)), (4, None), (5, ""), (6, " ".join(f"v{i}" for i in range(20_000)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == ({1, 2, 6, None} if rows else set())
