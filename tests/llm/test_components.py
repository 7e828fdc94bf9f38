import numpy as np
import pytest

from tarmac.llm import components


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


CASES = {
    "none": [],
    "self": [(4, 4)],
    "chain": [(i, i + 1) for i in range(60)],
    "hub": [(7, i) for i in range(100, 300)],
    "repeated": [(1, 2), (2, 1), (1, 2), (3, 3)],
    "random": [tuple(map(int, p)) for p in np.random.default_rng(3).integers(0, 400, (300, 2))],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = spark.createDataFrame(CASES[name], "src long, dst long").repartition(6)
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert found == brute([p for p in CASES[name] if p[0] != p[1]])


@pytest.mark.parametrize("name", ["chain", "hub", "random"])
def test_star_rounds_alone(spark, name):
    edges = spark.createDataFrame([p for p in CASES[name] if p[0] != p[1]], "src long, dst long")
    found = {r["src"]: r["dst"] for r in components.star_rounds(edges).collect()}
    assert found == brute(CASES[name])
