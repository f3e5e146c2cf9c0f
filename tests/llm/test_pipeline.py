"""The pipeline's stages on a small table, against plain Python."""

import re

import corpus_pipeline


def test_stages(spark, tmp_path):
    words = lambda seed, n: [f"w{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n)]
    rows = [(i, " ".join(words(i, 60 + i)), "en", f"s{i % 4}", 0) for i in range(40)]
    rows += [(100, rows[3][1].replace(" ", "  "), "en", "s0", 0), (101, rows[5][1] + " tail", "en", "s1", 0)]
    rows += [(200, "too short", "en", "s1", 0), (201, None, "en", None, 0), (202, "same words here " * 40, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert sorted(out.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    ids = [sorted(r.doc_id for r in x) for x in seen]
    assert ids[0] == [*range(40), 100, 101]
    assert ids[1] == [i for i in range(40) if i != 3] + [100, 101]
    assert ids[2] == [i for i in range(40) if i != 3] + [100]
    size = {r.doc_id: len(re.findall(r"\S+", r.text)) for r in seen[2]}
    total = sum(size.values())
    taken = sum(size[i] for i in ids[3])
    assert abs(taken - total) <= 4 * max(size.values())
    assert all(ids[3].count(i) <= 3 for i in set(ids[3]))
    assert {r.doc_id for r in seen[4]} == set(ids[3])
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).columns) == sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
