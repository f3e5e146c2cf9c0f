"""Connected components against a plain union-find."""

import random

import pytest
from pyspark.sql import functions as F

from docspark.operators.components import connected_components


def plain(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(random.Random(3).randrange(90), random.Random(i).randrange(90)) for i in range(70)]])
def test_components(spark, edges):
    want = plain([e for e in edges if e[0] != e[1]])
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0
    assert connected_components(spark.createDataFrame([], "u long, v long")).agg(F.count("*")).first()[0] == 0
