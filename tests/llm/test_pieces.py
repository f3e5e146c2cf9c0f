"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from docspark.llm import kernel as K
from docspark.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_tokens string"
PARTS = ["a", "the", "  ", " ", "\t", "\n", "▁", "é", "漢", "字", "😀", "\x00", "ing", "ER", "0", "12", "...", "'", "ß", "​", "x" * 20, " " * 17, "---", "ा", "्", "q", "$$$", ""]


@pytest.fixture(scope="module")
def encoder():
    return pieces.encoder(pieces.default_path())


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(40))) for _ in range(n)] + ["", " ", "  ", "▁", "<s>", "</s><0x41><unk>", "\n" * 60]


def own_ids(encoder, values):
    for block in K.blocks(pa.array(values)):
        got = [encoder.encode(b) for b in encoder.parts(block)]
        if len(got) > 1:
            yield np.concatenate([ids for ids, _ in got]).tolist()
        else:
            ids, ptr = got[0]
            yield from (ids[a:b].tolist() for a, b in zip(ptr[:-1], ptr[1:], strict=True))


def test_ids_as_the_library(encoder):
    values = texts(1, 6000)
    assert list(own_ids(encoder, values)) == encoder.model.library.encode(values)


def test_long_texts_in_parts(encoder):
    r = random.Random(3)
    values = ["a " * 400_000, "abcab" * 120_000, "".join(r.choice(PARTS) for _ in range(300_000)), "word, " * 200_000]
    assert len(list(encoder.parts(next(K.blocks(pa.array(values[:1])))))) > 2
    for v in values:
        assert list(own_ids(encoder, [v])) == [encoder.model.library.encode(v)]


def test_prefix_table_has_the_last_token_of_each_prefix(encoder):
    library, table = encoder.model.library, encoder.tokenizer
    for text in ("▁unbelievably", "▁" * 37, "▁antidisestablishmentarianism's", "▁ab"):
        last = table.last_tokens(text)
        for i in range(1, len(text) + 1):
            want = table.encode(text[:i])[-1]
            assert last[i] == (want if not encoder.model.is_byte[want] else pieces.FOREIGN)
        assert table.encode(text) == library.encode(text.replace("▁", " ")[1:])


def test_decoding_any_ids(encoder):
    r, library = random.Random(2), encoder.model.library
    lists = [[r.randrange(top) for _ in range(r.randrange(14))] for top in (32000, 400, 262) for _ in range(2000)]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    got = encoder.decode(np.array([i for x in lists for i in x], np.int64), ptr)
    assert [x.decode() for x in got] == [library.decode(x) for x in lists]
    with pytest.raises(ValueError, match="beyond"):
        encoder.decode(np.array([40000]), np.array([0, 1]))


def test_rows(spark, encoder):
    library = encoder.model.library
    values = [*texts(4, 300), None, "word " * 60_000]
    rows = [(i, t, "x", None) for i, t in enumerate(values)] + [(3, values[3], None, None), (None, "null id", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {}
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[i] = ids, library.decode(ids)
    encoded = pieces.encode(df)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r["ids"] == want[r["doc_id"]][0] for r in got)
    decoded = pieces.decode(encoded).collect()
    assert len(decoded) == len(rows) and all(r["text"] == want[r["doc_id"]][1] for r in decoded)
    digests = pieces.round_trip(df).collect()
    assert len(digests) == len(rows)
    for r in digests:
        ids, text = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert pieces.round_trip(df.limit(0)).collect() == [] and pieces.encode(df.limit(0)).collect() == []
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["text"]) for r in pieces.decode(empty).collect()} == {(1, ""), (2, "")}
