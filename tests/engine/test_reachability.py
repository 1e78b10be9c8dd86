"""Reachability labels against walks over random graphs, with cycles and without."""

import random

import pytest
from pyspark.sql import functions as F

from lineagraph.operators import lineage as li
from lineagraph.operators.reachability import reachability


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, todo = set(), [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen - {a}
    return out


@pytest.mark.parametrize("seed,cyclic", [(1, False), (2, False), (3, True), (4, True)])
def test_random_graphs(spark, seed, cyclic):
    draw = random.Random(seed)
    edges = set()
    for _ in range(130):
        a, b = draw.randrange(80), draw.randrange(80)
        edges.add((a, b) if cyclic and draw.random() < 0.08 else (max(a, b), min(a, b)))
    dependency = spark.createDataFrame(sorted(edges), "dependent_id long, dependency_id long")
    index, expected = reachability(dependency), reach(edges)
    ids = spark.range(85)
    targets = spark.range(0, 85, 3)
    wanted = set(range(0, 85, 3))
    pairs = {(r.id, r.target_id) for r in index.pairs(ids, targets).collect()}
    assert pairs == {(a, b) for a, found in expected.items() for b in found & wanted}
    assert index.pairs(ids, targets).count() == len(pairs)
    assert {r.id: r.targets for r in index.counts(ids, targets).collect()} == {i: len(expected.get(i, set()) & wanted) for i in range(85)}
    asked = [(draw.randrange(85), draw.randrange(85)) for _ in range(300)] + [(i, i) for i in range(85)]
    got = index.among(spark.createDataFrame(asked, "id long, target_id long")).collect()
    assert len(got) >= len(set(asked)) and all(r.derived == (r.target_id in expected.get(r.id, set())) for r in got)


def test_a_chain_has_a_row_a_node(spark):
    """Of a path of n nodes the closure has n * (n + 1) / 2 rows, the index n."""
    path = spark.range(1, 200).select(F.col("id").alias("dependent_id"), (F.col("id") - 1).alias("dependency_id"))
    index = reachability(path)
    assert index.places.count() == 200 and index.stairs.count() == 0
    assert index.counts(spark.range(200), spark.range(200)).where("targets <> id").count() == 0


def test_assign_trial(spark):
    """b = f([1]): a value derives from what it was made of, not from itself."""
    names = ["f_eval", "list", "a_write", "f_variable", "f_func", "a_read", "a_arg", "x_param", "x_return", "return", "f_activation", "global", "b_write"]
    number = {n: i for i, n in enumerate(names)}
    rows = [("a_write", "list"), ("a_read", "a_write"), ("f_variable", "f_eval"), ("f_func", "f_variable"), ("a_arg", "a_read"), ("x_param", "a_arg"), ("x_return", "x_param"), ("global", "a_write"), ("return", "x_return"), ("f_activation", "return"), ("b_write", "f_activation")]
    dependency = spark.createDataFrame([(number[a], number[b]) for a, b in rows], "dependent_id long, dependency_id long")
    every, b = spark.range(len(names)), spark.createDataFrame([(number["b_write"],)], "id long")
    found = {names[r.target_id] for r in li.derived_pairs(dependency, b, every).collect()}
    assert found == {"f_activation", "return", "x_return", "x_param", "a_arg", "a_read", "a_write", "list"}
    same = spark.createDataFrame([(number["list"],), (number["a_write"],)], "id long")
    assert {names[r.id]: r.targets for r in li.was_derived_from(dependency, same, same).collect()} == {"list": 0, "a_write": 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "dependent_id long, dependency_id long")
    index = reachability(none)
    assert index.pairs(spark.range(3), spark.range(3)).count() == 0
    assert [r.targets for r in index.counts(spark.range(3), spark.range(3)).collect()] == [0, 0, 0]
    assert index.counts(spark.range(0), spark.range(3)).count() == 0


def test_runs_make_no_rounds(spark, monkeypatch):
    """A path along neighbouring ids is one run; one in any order, over many blocks of ids, has the same places."""
    from lineagraph.operators import reachability as r

    settled, plain = [], r.settle
    monkeypatch.setattr(r, "settle", lambda df: settled.append(df) or plain(df))
    path = spark.range(1, 200).select(F.col("id").alias("dependent_id"), (F.col("id") - 1).alias("dependency_id"))
    assert {x.node: (x.chain, x.place) for x in r.reachability(path).places.collect()} == {i: (0, -i) for i in range(200)}
    assert len(settled) <= 4
    ids = random.Random(7).sample(range(1 << 20), 60)
    mixed = spark.createDataFrame(list(zip(ids[1:], ids)), "dependent_id long, dependency_id long")
    links = mixed.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node"))
    placed = r.chains(spark.createDataFrame([(i,) for i in ids], "node long"), links)
    assert {x.node: (x.chain, x.place) for x in placed.collect()} == {n: (ids[0], -i) for i, n in enumerate(ids)}
