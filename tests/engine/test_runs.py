"""Closures where each node has one way on: steps of a run are laid down together, and the rest doubles."""

import random

import pytest

from lineagraph.operators import closure as cl


def reference(seeds, edges, most=None):
    way, out = dict(edges), {}
    for s, n in seeds:
        d = 0
        while True:
            out[s, n] = min(d, out.get((s, n), d))
            if n not in way or d == most:
                break
            n, d = way[n], d + 1
    return {(s, n, d) for (s, n), d in out.items()}


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("most", [None, 0, 3, 40])
def test_forests_of_any_order(spark, turned, most):
    draw = random.Random(7)
    edges = [(n, n - 1) for n in range(1, 90)] + [(n, draw.randrange(n)) for n in range(100, 300)] + [(10**6 + n, 10**6 + n - 3) for n in range(3, 60)] + [(-5, -9), (2**40, 7)]
    edges = [(-a, -b) for a, b in edges] if turned else edges
    seeds = [(n, n) for n, _ in edges[::5]] + [(1, edges[60][0]), (1, edges[80][0]), (77777, 77777)]
    edge_rows = spark.createDataFrame(edges + edges[:9], "node long, next_node long")
    got = cl.graph_closure(spark.createDataFrame(seeds + seeds[:2], "src long, node long"), edge_rows, most_rounds=most)
    rows = [tuple(r) for r in got.select("src", "node", "depth").collect()]
    assert set(rows) == reference(seeds, edges, most) and len(rows) == len(set(rows))


def test_runs_take_no_rounds(spark, monkeypatch):
    stores = []
    monkeypatch.setattr(cl, "stored", lambda df, write=cl.settle: stores.append(df.count()) or write(df))
    monkeypatch.setattr(cl, "settle", lambda df, write=cl.settle: stores.append(df.count()) or write(df))
    edges = spark.createDataFrame([(100 * a + i, 100 * a + i - 1) for a in range(50) for i in range(2, 8)], "node long, next_node long")
    seeds = spark.createDataFrame([(100 * a + i,) * 2 for a in range(50) for i in range(1, 8)], "src long, node long")
    assert cl.graph_closure(seeds, edges).count() == 50 * 28
    assert len(stores) <= 2 and sum(stores) <= 300  # the steps once, and no ends that lead on; no table of what is reached
