"""File-disjoint batches of two splits, degradation states, and roles in groups."""

import random

import pytest

from docspark.operators import inventory, relations, scoring

CASE = "case_id long, file_id long, intent string, split string"


def cases(n, files=40, holdout=0.4):
    r = random.Random(5)
    return [(i, r.randrange(files), r.choice(["i0", "i1", "i2", "i3", None]), "HOLDOUT" if r.random() < holdout else "DEV") for i in range(n)]


def test_batches_share_no_file(spark):
    df = spark.createDataFrame(cases(600), CASE)
    got = scoring.freeze_splits(df, 12, 2).collect()
    assert len(got) == 36 and {(r.split, r.batch) for r in got} == {("DEV", 0), ("DEV", 1), ("HOLDOUT", 2)}
    files = [{r.file_id for r in got if r.batch == b} for b in range(3)]
    assert not (files[0] & files[1] or files[0] & files[2] or files[1] & files[2])
    assert all({r.intent for r in got if r.batch == b} == {"i0", "i1", "i2", "i3", "unknown"} for b in range(3))
    assert {r.batch_id.rsplit("-", 1)[0] for r in got} == {"v1-dev-00", "v1-dev-01", "v1-holdout-00"}
    assert sorted(map(tuple, scoring.freeze_splits(df.repartition(7), 12, 2).collect())) == sorted(map(tuple, got))
    other = scoring.freeze_splits(df, 12, 2, "v9").collect()
    assert {r.case_id for r in other} != {r.case_id for r in got}


def test_batches_that_cannot_be_filled(spark):
    with pytest.raises(ValueError, match="HOLDOUT batch 0 has 0 cases of 5"):
        scoring.freeze_splits(spark.createDataFrame(cases(300, holdout=0), CASE), 5, 2)
    with pytest.raises(ValueError, match="has 0 cases"):
        scoring.freeze_splits(spark.createDataFrame([], CASE), 5, 1)
    for bad in ((5, 0, "v"), (0, 1, "v"), (5, 1, " ")):
        with pytest.raises(ValueError, match="asked for"):
            scoring.freeze_splits(spark.createDataFrame([], CASE), *bad)


def test_quotas_stay_within_what_there_is():
    import pandas as pd

    c = pd.DataFrame({"batch": 0, "intent": ["a", "b", "c"], "n": [1, 2, 90]})
    assert dict(zip(*[scoring._quotas(c, 10)[x] for x in ("intent", "quota")], strict=True)) == {"a": 1, "b": 1, "c": 8}
    c["n"] = [1, 2, 3]
    assert scoring._quotas(c, 10)["quota"].sum() == 6


def test_levels(spark):
    steps = [(1, 1, "full"), (1, 2, "full"), (1, 3, "core"), (1, 4, "balanced"), (1, 5, "full"), (2, 1, "none"), (2, 2, None)]
    got = inventory.level_violations(spark.createDataFrame(steps, "job_id long, seq long, level string")).collect()
    assert sorted((r.job_id, r.seq, r.problem) for r in got) == [(1, 3, "transition"), (2, 1, "unknown level"), (2, 2, "unknown level")]
    states = [(1, 1, "full", None, [], None, None), (1, 2, "full", ["x"], None, None, None), (1, 3, "core", ["x"], [], "2024-01-01", "2023-01-01"), (1, 4, "core", ["x"], [], None, None), (1, 5, "balanced", ["x"], ["y"], "2024-01-01", None)]
    got = inventory.level_state_problems(spark.createDataFrame(states, "job_id long, seq long, level string, triggers array<string>, disabled_features array<string>, entered_at string, recover_after string")).collect()
    assert sorted((r.seq, r.problem) for r in got) == [(2, "full with causes"), (3, "recovery too early"), (4, "no cause or time")]


def test_roles(spark):
    edges = spark.createDataFrame([(1, 2, "summary"), (2, 3, "summary"), (3, 4, "version"), (5, 4, "duplicate")], "left_file_id long, right_file_id long, relation_type string")
    groups = relations.connected_groups(edges)
    assert {(r.file_id, r.role) for r in relations.group_roles(edges, groups).collect()} == {(1, "summary"), (2, "source"), (3, "source"), (4, "member"), (5, "member")}
