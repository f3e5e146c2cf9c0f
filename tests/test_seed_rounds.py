"""Seed groups: what the rounds write."""

import numpy as np

from docspark.operators import topics


def test_rounds_do_not_write_the_pairs_again(spark, monkeypatch):
    written, cut = [], topics.cut
    monkeypatch.setattr(topics, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    x = np.random.default_rng(2).standard_normal((150, 3))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "file_id long, bucket string, vector array<double>")
    got = {tuple(r) for r in topics.seed_expand_groups(df, df.limit(0), 0.3, 4, seeds=8).collect()}
    rows = [d.count() for d in written if not {"similarity", "confidence"}.isdisjoint(d.columns) and "seed_file_id" not in d.columns]
    pairs = max(rows)
    assert len(rows) == 1 and pairs > 2000  # before: twice the pairs, and what was left of them after each round
    assert got == {tuple(r) for r in topics.seed_expand_groups(df, df.limit(0), 0.3, 4, seeds=1000).collect()}
    assert sum(d.count() for d in written if "used" in d.columns or "nearest" in d.columns) < pairs
