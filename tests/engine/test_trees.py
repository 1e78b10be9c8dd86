"""Numbers of ordered trees, merged graphs, edit distances and merged trees against plain walks."""

import functools
import itertools
import random

import pytest

from lineagraph.operators import tree_diff as td
from lineagraph.operators import trees as tr

SCHEMA = "tree_id long, id long, parent_id long, place long, label string"


def shapes(n):
    """All ordered forests of n unlabelled nodes, as nested tuples."""
    if n == 0:
        return [()]
    return [((first,) + rest) for k in range(n) for first in shapes(k) for rest in shapes(n - 1 - k)]


def flat(forest, label):
    """Labels and sizes in pre-order."""
    labels, sizes = [], []

    def walk(tree):
        at = len(sizes)
        labels.append(label())
        sizes.append(0)
        for kid in tree:
            walk(kid)
        sizes[at] = len(sizes) - at

    for tree in forest:
        walk(tree)
    return labels, sizes


def distance(labels, sizes, other, other_sizes):
    """By taking off the last tree's root, or putting one in, or matching both."""

    def roots(low, high, lengths):
        out = []
        while low < high:
            out.append(low)
            low += lengths[low]
        return out

    @functools.cache
    def cost(a, b):  # forests as tuples of nodes, in pre-order
        if not a or not b:
            return len(a) + len(b)
        ra, rb = [i for i in a if not any(j < i < j + sizes[j] for j in a)][-1], [i for i in b if not any(j < i < j + other_sizes[j] for j in b)][-1]
        below_a, below_b = tuple(i for i in a if ra < i < ra + sizes[ra]), tuple(i for i in b if rb < i < rb + other_sizes[rb])
        match = cost(tuple(i for i in a if i < ra), tuple(i for i in b if i < rb)) + cost(below_a, below_b) + (0 if labels[ra] == other[rb] else 3)
        return min(cost(tuple(i for i in a if i != ra), b) + 1, cost(a, tuple(i for i in b if i != rb)) + 1, match)

    return cost(tuple(range(len(labels))), tuple(range(len(other))))


def check_mapping(pairs, labels, sizes, other, other_sizes):
    """One to one, names alike, and before, after, above and below as in the other."""
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    for (i, j), (k, m) in itertools.combinations(sorted(pairs), 2):
        assert i < k and j < m and (k < i + sizes[i]) == (m < j + other_sizes[j])
    return sum(labels[i] == other[j] for i, j in pairs)


def test_all_small_forests():
    """Up to five nodes in two labels; six without labels."""
    draw = random.Random(1)
    small = [f for n in range(6) for f in shapes(n)]
    cases = [(a, b, lambda: draw.choice("xy")) for a in small for b in small] + [(a, b, lambda: "x") for a in shapes(6) for b in draw.sample(shapes(6), 12)]
    for a, b, label in cases:
        (x, n), (y, m) = flat(a, label), flat(b, label)
        cost, pairs = td.edit_mapping(x, n, y, m)
        assert cost == distance(x, n, y, m)
        assert check_mapping(pairs, x, n, y, m) == len(pairs) and cost == len(x) + len(y) - 2 * len(pairs)


def random_trees(draw, count, most, labels="abc"):
    rows, ids = [], iter(range(1, 10**6))
    for t in range(count):
        nodes = []
        for k in range(draw.randint(1, most)):
            i = next(ids)
            nodes.append(i)
            rows.append((t, i, nodes[draw.randrange(k)] if k else None, draw.randrange(5), draw.choice(labels)))
    return rows


def as_tree(rows, t):
    kids = {}
    for r in sorted((r for r in rows if r[0] == t), key=lambda r: (r[3], r[1])):
        kids.setdefault(r[2], []).append(r)
    order, sizes = [], []

    def walk(r):
        at = len(order)
        order.append(r)
        sizes.append(0)
        for kid in kids.get(r[1], []):
            walk(kid)
        sizes[at] = len(order) - at

    for r in kids.get(None, []):
        walk(r)
    return order, sizes, kids


def test_numbers(spark):
    rows = random_trees(random.Random(2), 12, 25)
    rows += [(0, 9_000_001, None, 9, "a"), (0, 9_000_002, 9_000_001, 0, "b")]  # a second root
    rows += [(50, 9_000_003, 9_000_004, 0, "a"), (50, 9_000_004, 9_000_003, 0, "a")]  # a cycle is on no level
    got = {(r.tree_id, r.id): r for r in tr.numbered(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) - 2
    text = {}
    for t in range(12):
        order, sizes, kids = as_tree(rows, t)

        def shape(r):
            return r[4] + "(" + ",".join(shape(k) for k in kids.get(r[1], [])) + ")"

        above = {None: ("", "")}
        for enter, (r, size) in enumerate(zip(order, sizes)):
            n = got[t, r[1]]
            assert (n.enter, n.size, n.n_children) == (enter, size, len(kids.get(r[1], [])))
            assert kids[r[2]][n.child][1] == r[1]
            above[r[1]] = (above[r[2]][0] + "/" + r[4], above[r[2]][1] + "/" + shape(r))
            text[t, r[1]] = (shape(r), *above[r[1]])
    for one, other in itertools.product(text, repeat=2):
        a, b = got[one], got[other]
        assert ((a.s1, a.s2) == (b.s1, b.s2)) == (text[one][0] == text[other][0])
        assert ((a.l1, a.l2) == (b.l1, b.l2)) == (text[one][1] == text[other][1])
        assert ((a.e1, a.e2) == (b.e1, b.e2)) == (text[one][2] == text[other][2])


@pytest.mark.parametrize("mode", ["no_match", "exact_match", "namespace_match"])
def test_merged_graph_against_a_walk(spark, mode):
    """Nodes are looked up by their key below the merged node that was entered last, in pre-order."""
    rows = random_trees(random.Random(5), 8, 30, "ab")
    tree = tr.merged(tr.numbered(spark.createDataFrame(rows, SCHEMA)), mode)
    values = spark.createDataFrame([(r[1], r[1] % 7, f"<{r[1]}>") for r in rows], "id long, duration long, note string")
    nodes = {(r.tree_id, r.node): (r.parent, r.calls, r.duration, r.ids, r.tooltip) for r in tr.merged_nodes(tree, values).collect()}
    edges = {(r.tree_id, r.source, r.target, r.type): r["count"] for r in tr.merged_edges(tree).collect()}
    wanted_nodes, wanted_edges = {}, {}
    for t in range(8):
        order, _, kids = as_tree(rows, t)

        def shape(r):
            return r[4] + "(" + ",".join(shape(k) for k in kids.get(r[1], [])) + ")"

        key = {"no_match": lambda r: r[1], "exact_match": shape, "namespace_match": lambda r: r[4]}[mode]
        held, matches, returned = {}, {}, set()

        def add(source, target, kind):
            wanted_edges[t, source, target, kind] = wanted_edges.get((t, source, target, kind), 0) + 1

        def enter(r, parent, last):
            node = matches.get((parent, key(r)))
            fresh = node is None
            if fresh:
                node = matches[parent, key(r)] = r[1]
                held[node] = (parent, [])
            held[node][1].append(r[1])
            if parent is None:
                add(node, node, "initial")
            elif last is not None:
                add(last, node, "sequence")
            elif fresh:
                add(parent, node, "call")
            before = None
            for kid in kids.get(r[1], []):
                before = enter(kid, node, before)
            if before is not None and before not in returned:
                returned.add(before)
                add(before, node, "return")
            return node

        enter(order[0], None, None)
        for node, (parent, ids) in held.items():
            wanted_nodes[t, node] = (parent, len(ids), sum(i % 7 for i in ids), ",".join(map(str, ids)), "".join(f"<{i}>" for i in ids))
    assert nodes == wanted_nodes and edges == wanted_edges


def test_mapping_of_random_trees(spark):
    """Trees made by small changes, so that equal ends are matched first; the cost is the least."""
    draw = random.Random(8)
    rows, pairs = random_trees(draw, 10, 14), []
    ids = itertools.count(10**7)
    for t in range(10):
        for c in range(3):
            copy = {r[1]: next(ids) for r in rows if r[0] == t}
            mine = [(100 + 10 * t + c, copy[r[1]], copy.get(r[2]), r[3], r[4]) for r in rows if r[0] == t]
            for _ in range(c + 1):
                at = draw.randrange(len(mine))
                r = mine[at]
                if r[2] is None or draw.random() < 0.5:
                    mine[at] = (*r[:4], draw.choice("abcd"))
                else:
                    mine = [(*x[:2], r[2] if x[2] == r[1] else x[2], *x[3:]) for x in mine if x is not r]
            rows += mine
            pairs.append((t, 100 + 10 * t + c))
    pairs += [(t, (t + 1) % 10) for t in range(10)] + [(t, t) for t in range(10)]
    tree = tr.numbered(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame(pairs + [(3, 77)], "tree_id long, other_id long")
    mapping = td.tree_mapping(tree, asked)
    found = {}
    for r in mapping.collect():
        found.setdefault((r.tree_id, r.other_id), []).append((r.id, r.other))
    cost = {(r.tree_id, r.other_id): r.cost for r in td.tree_distances(mapping).collect()}
    assert set(cost) == set(pairs)
    for a, b in pairs:
        (order, sizes, _), (other, other_sizes, _) = as_tree(rows, a), as_tree(rows, b)
        place, other_place = {r[1]: i for i, r in enumerate(order)}, {r[1]: i for i, r in enumerate(other)}
        labels, other_labels = ["root", *(r[4] for r in order[1:])], ["root", *(r[4] for r in other[1:])]
        matched = [(place[i], other_place[j]) for i, j in found[a, b] if i is not None and j is not None]
        assert check_mapping(matched, labels, sizes, other_labels, other_sizes) == len(matched)
        assert {i for i, _ in found[a, b]} - {None} == set(place) and {j for _, j in found[a, b]} - {None} == set(other_place)
        assert cost[a, b] == distance(labels, sizes, other_labels, other_sizes)


def test_merged_tree(spark):
    """r(x(y, z), w) against q(y, w, v): r and q are the roots, x is gone, z too, v is new."""
    rows = [(1, 1, None, 0, "r"), (1, 2, 1, 0, "x"), (1, 3, 2, 0, "y"), (1, 4, 2, 1, "z"), (1, 5, 1, 1, "w")]
    rows += [(2, 11, None, 0, "q"), (2, 12, 11, 0, "y"), (2, 13, 11, 1, "w"), (2, 14, 11, 2, "v")]
    tree = tr.numbered(spark.createDataFrame(rows, SCHEMA))
    mapping = td.tree_mapping(tree, spark.createDataFrame([(1, 2)], "tree_id long, other_id long"))
    got = {(r.id, r.other): (r.parent_id, r.parent_other, r.name, r.place) for r in td.merged_tree(tree, mapping).collect()}
    assert got == {
        (1, 11): (None, None, "r|q", 0),
        (2, None): (1, 11, "x", 0),
        (3, 12): (1, 11, "y", 1),
        (4, None): (2, None, "z", 0),
        (5, 13): (1, 11, "w", 2),
        (None, 14): (1, 11, "v", 3),
    }
    edges = td.merged_tree_edges(mapping, tr.merged_edges(tr.merged(tree, "no_match")))
    counted = {(r.source_id, r.source_other, r.target_id, r.target_other, r.type): (r["count"], r.other_count) for r in edges.collect()}
    assert counted[1, 11, 1, 11, "initial"] == (1, 1) and counted[5, 13, 1, 11, "return"] == (1, 0) and counted[3, 12, 5, 13, "sequence"] == (0, 1)
    assert sum(a for a, _ in counted.values()) == 1 + 2 + 2 + 2 and sum(b for _, b in counted.values()) == 1 + 1 + 2 + 1


def test_empty(spark):
    tree = tr.numbered(spark.createDataFrame([], SCHEMA))
    assert tree.count() == 0
    mapping = td.tree_mapping(tree, spark.createDataFrame([(1, 2)], "tree_id long, other_id long"))
    assert mapping.count() == td.tree_distances(mapping).count() == td.merged_tree(tree, mapping).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cells_and_rows_give_one_mapping(monkeypatch, seed):
    """Small forests are compared cell by cell, large ones by rows of arrays."""
    rng = random.Random(seed)

    def forest(n):
        kids = {i: [] for i in range(n)}
        for i in range(1, n):
            kids[rng.choice([(i - 1) // 2, rng.randrange(i)])].append(i)
        grown = lambda i: tuple(grown(k) for k in kids[i])
        return flat((grown(0),), lambda: rng.choice("abc"))

    for _ in range(20):
        pair = (*forest(rng.randrange(1, 40)), *forest(rng.randrange(1, 40)))
        monkeypatch.setattr(td, "FEW_NODES", 0)
        by_rows = td.edit_mapping(*pair)
        monkeypatch.setattr(td, "FEW_NODES", 1000)
        assert td.edit_mapping(*pair) == by_rows
