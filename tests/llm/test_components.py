import random

import pytest

from logstrata.llm.components import components
from logstrata.llm.scratch import Scratch


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 2), (2, 5)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(random.Random(i).randrange(90), random.Random(i + 999).randrange(90)) for i in range(70)]])
def test_equals_brute_force(spark, edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: root(x) for x in parent}
