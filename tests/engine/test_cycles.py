"""Walks along references and callers end on cycles."""

import random

from lineagraph.operators.closure import ancestors, graph_closure
from lineagraph.operators.evaluations import reference_roots


def test_cycles_end(spark):
    tree = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None), (7, 6)], "id long, up long")
    got = {(r.node, r.ancestor): r.depth for r in ancestors(tree, "id", "up").collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (2, 1): 2, (3, 3): 0, (3, 1): 1, (3, 2): 2, (4, 4): 0, (4, 1): 1, (4, 2): 2, (4, 3): 3, (5, 5): 0, (6, 6): 0, (7, 7): 0, (7, 6): 1}


def test_last_reference_before_a_cycle_closes(spark):
    rows = [(1, 2), (2, 1), (3, 1), (4, 9)]
    dependency = spark.createDataFrame([(a, b, True) for a, b in rows], "dependent_id long, dependency_id long, reference boolean")
    assert {r.node: r.root for r in reference_roots(dependency).collect()} == {1: 2, 2: 1, 3: 2, 4: 9}


def test_a_deep_path(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id long, up long")
    got = ancestors(tree, "id", "up")
    assert got.count() == 150 * 151 // 2 and got.where("depth <> node - ancestor").count() == 0


def walk(seeds, edges, most=None):
    """Breadth first, a source at a time."""
    after, out = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for src in {s for s, _ in seeds}:
        at, depth = {n for s, n in seeds if s == src}, 0
        seen = dict.fromkeys(at, 0)
        while at and depth != most:
            depth += 1
            at = {b for a in at for b in after.get(a, ())} - seen.keys()
            seen |= dict.fromkeys(at, depth)
        out |= {(src, n): d for n, d in seen.items()}
    return out


def test_one_way_down_and_many_ways(spark):
    """Chains that double, the same with one edge more so that they are walked, and sources with several seeds."""
    draw = random.Random(7)
    down = [(n, draw.randrange(max(0, n - 3), n)) for n in range(1, 60) if draw.random() < 0.9]
    single = [(s, draw.randrange(60)) for s in range(20)]
    several = [(s % 4, draw.randrange(60)) for s in range(12)]
    for edges, cases in ((down, [(single, None), (single, 5), (several, None), (single, 0)]), ([*down, (50, 3)], [(several, 5)]), ([*down, (0, 59)], [(single, None)]), ([], [(single, None)])):
        for seeds, most in cases:
            got = graph_closure(spark.createDataFrame(seeds, "src long, node long"), spark.createDataFrame(edges, "node long, next_node long"), most_rounds=most)
            rows = [(r.src, r.node, r.depth) for r in got.collect()]
            assert {(s, n): d for s, n, d in rows} == walk(seeds, edges, most) and len(rows) == len({r[:2] for r in rows})
