import random

import numpy as np
import pytest

from pagemill.llm.components import components, roots


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "random": [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)],
        "path": [(k, k + 1) for k in rng.sample(range(120), 120)],
        "star": [(50, k) for k in range(100)],
        "empty": [],
    }[kind]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + edges[:5], "a long, b long").repartition(5)
    rows = components(df).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.root for r in rows} == plain(edges)


def test_roots():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 60, 40), rng.integers(0, 60, 40)
    want = plain(list(zip(a.tolist(), b.tolist(), strict=True)))
    assert roots(a, b, 60).tolist() == [want.get(k, k) for k in range(60)]
