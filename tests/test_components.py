import random

from rulelens.plans.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(900 - k, 901 - k) for k in range(40)] + [(2000, 2001 + k) for k in range(30)] + [(3000, 2900 + k) for k in range(30)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
