"""Packing: ids round trip, sequences are gapless and few."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docspark.llm import kernel, packing, token_counts, tokens

TEXTS = ["", None, "one two three", "a" * 900, "word " * 700, "the cat's hat\n\n  x", *(f"text number {i} " * (i % 37) for i in range(300)), "a <|endoftext|> b", "élève 语言 😀 \u0378 \U00016d40's", "long " * 90_000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string").repartition(3)


def encoded():
    t = Tokenizer.from_file(tokens.default_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack(docs, capacity):
    rows = packing.pack(docs, capacity=capacity).collect()
    ids = encoded()
    total = sum(map(len, ids))
    seen = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= capacity
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.piece == 0 or r.length == capacity
    for spans in seen.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(r.length for r in rows) == total
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == by_doc.get(r.doc_id, 0)
        by_doc[r.doc_id] = r.start + r.length
    assert by_doc == {i: len(x) for i, x in enumerate(ids)}
    assert len(seen) <= -(-total // capacity) * 1.03 + 2


def test_pack_empty(docs):
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("counts", [{900: 3, 500: 7, 124: 5, 70: 11}, {}, {1024: 9}, {s: 40 + s % 7 for s in range(200, 1000, 9)}])
def test_configurations_use_all(counts):
    uses = {}
    for choose in (packing.configurations, packing.optimal_configurations):
        got = {}
        for sizes, n in choose(counts, 1024):
            assert sum(sizes) <= 1024
            uses[choose] = uses.get(choose, 0) + n
            for s in sizes:
                got[s] = got.get(s, 0) + n
        assert got == counts
    if len(counts) > 5:
        assert uses[packing.optimal_configurations] <= uses[packing.configurations]


def test_fullest_configuration():
    """The knapsack against all configurations."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = sorted({int(x) for x in rng.integers(5, 40, 4)}, reverse=True)
        values = rng.random(len(sizes))
        best = max(float(np.dot(c, values)) for c in np.ndindex(*(60 // s + 1 for s in sizes)) if np.dot(c, sizes) <= 60)
        got = packing._fullest(values, sizes, 60)
        assert np.dot(got, sizes) <= 60 and np.dot(got, values) == pytest.approx(best)


def test_ids_are_the_tokenizers():
    """Some thousand texts mixed from words, spaces, added tokens and characters of all planes."""
    r = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "word", "It's", "'ll", "'", "é", "中文", "12", "٣", "<|endoftext|>", "<|endo", "\U00016d40", "\U0001ccf0", "\u3000", "\xa0", "😀", "!", "\u200b", "\u0378", "x́", "'S", "\r\n", "Ⅷ", "½"]
    any_ = lambda: chr(r.choice([r.randrange(32, 0x3000), r.randrange(0x3000, 0xD800), r.randrange(0xE000, 0x110000)]))
    texts = ["".join(r.choice(parts) if r.random() < 0.8 else any_() for _ in range(r.randrange(14))) for _ in range(4000)]
    library, encoder = Tokenizer.from_file(tokens.default_path()), tokens.encoder(tokens.default_path())
    for block in kernel.blocks(pa.array(texts), 3000):
        ids, ptr = encoder.encode(block)
        assert encoder.counts(block).tolist() == np.diff(ptr).tolist()
        for i in range(len(block)):
            assert ids[ptr[i] : ptr[i + 1]].tolist() == library.encode(texts[block.row + i], add_special_tokens=False).ids


def test_new_pretokens_are_one_input():
    """The library gives one result for thousands of new pre-tokens; where ids don't tell their ends, each is an input."""
    text = " ".join(f"w{i}x é{i} 中{i % 7}" for i in range(900))
    library = Tokenizer.from_file(tokens.default_path())
    want = library.encode(text, add_special_tokens=False).ids
    (block,) = kernel.blocks(pa.array([text]))

    class Counted:
        one, calls = library, []

        def __getattr__(self, name):
            self.calls.append(name)
            return getattr(self.one, name)

    for spoilt in (False, True):
        encoder = tokens.Encoder(tokens.default_path())
        encoder.tokenizer = Counted()
        encoder.tokenizer.calls.clear()
        if spoilt:
            encoder.widths[want[0]] += 1
        assert encoder.encode(block)[0].tolist() == want
        assert ("encode_batch" in encoder.tokenizer.calls) == spoilt


def test_histogram(docs):
    lengths = [len(x) - 1 for x in encoded()]
    got = token_counts.token_lengths(docs)
    assert sorted(r.n_tokens for r in got.collect()) == sorted(lengths)
    for block in (3, 4096):
        rows = token_counts.length_histogram(got, block).collect()
        assert {r.n_tokens for r in rows} == set(lengths)
        for r in rows:
            assert r.n_docs == lengths.count(r.n_tokens)
            assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths)
            assert r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
            assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
            assert r["quantile"] == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    assert token_counts.length_histogram(got.filter(F.lit(False))).count() == 0
