"""Walks with calls, members and an early end; bridged edges; common subsequences."""

import itertools
import random

from pyspark.sql import functions as F

from lineagraph.operators import dataflow as df
from lineagraph.operators.lineage import navigate
from lineagraph.operators.alignment import common_subsequences


def walk_tables(spark):
    evaluation = spark.createDataFrame([(i, i) for i in range(1, 9)], "id long, checkpoint long")
    dependency = spark.createDataFrame([(8, 7, "use"), (7, 6, "argument"), (6, 5, "use"), (5, 8, "use")], "dependent_id long, dependency_id long, type string")
    member = spark.createDataFrame([(7, "a", 1, 1), (7, "a", 2, 3), (7, "b", 3, 9)], "collection_id long, key string, member_id long, checkpoint long")
    called = spark.createDataFrame([(8, 4), (4, 5)], "id long, call_id long")
    return evaluation, dependency, member, called


def test_members_as_of_the_moment_and_no_step_from_a_call(spark):
    evaluation, dependency, member, called = walk_tables(spark)
    start = spark.createDataFrame([(8, 8)], "src long, node long")
    got = {(r.node, r.at, r.is_call) for r in navigate(evaluation, dependency, start, member, called, arguments=False).collect()}
    assert got == {(8, 8, False), (7, 7, False), (2, 7, False), (4, 4, True)}
    every = {r.node for r in navigate(evaluation, dependency, start).collect()}
    assert every == {8, 7, 6, 5}  # the cycle ends


def test_a_source_stops_once_all_is_found(spark):
    evaluation, dependency, _, _ = walk_tables(spark)
    start = spark.createDataFrame([(8, 8), (6, 6)], "src long, node long")
    stop = spark.createDataFrame([(8, 7), (6, 1)], "src long, node long")
    got = {(r.src, r.node) for r in navigate(evaluation, dependency, start, stop_on=stop).collect()}
    assert got == {(8, 8), (8, 7), (6, 6), (6, 5), (6, 8), (6, 7)}


def test_bridged_edges_have_the_types_of_their_ways(spark):
    rows = [(1, 2, "use"), (2, 3, "argument"), (3, 4, "use"), (1, 4, "assignment"), (4, 5, "use"), (2, 2, "loop")]
    dependency = spark.createDataFrame(rows, "dependent_id long, dependency_id long, type string")
    hidden = spark.createDataFrame([(2,), (3,)], "id long")
    got = {(r.source, r.target): (r.types, r.propagated) for r in df.bridged(dependency, hidden).collect()}
    assert got == {(1, 4): ("argument,assignment,loop,use", True), (4, 5): ("use", False)}


def test_nodes_below_a_leaf_are_hidden(spark):
    calls = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 3), (1, 5, 1)], "trial_id long, id long, caller_id long")
    got = {r.id: r.shape for r in df.calls_only(calls, 2).collect()}
    assert got == {1: "cluster", 2: "cluster", 3: "leaf", 5: "leaf"}
    assert {r.id: r.shape for r in df.calls_only(calls, 0).collect()} == {1: "cluster", 2: "leaf", 5: "leaf"}
    assert df.calls_only(calls.limit(0), 2).count() == 0


def test_subsequences_against_brute_force(spark):
    draw = random.Random(3)
    lists = {i: [draw.choice("abc") for _ in range(draw.randrange(0, 8))] for i in range(14)}
    rows = [(i, p, v) for i, vs in lists.items() for p, v in enumerate(vs)]
    pairs = [(i, i + 1) for i in range(13)]
    found = common_subsequences(spark.createDataFrame(rows, "id long, place int, value string"), spark.createDataFrame(pairs, "id long, other_id long"))
    got = {}
    for r in found.orderBy("id", "place").collect():
        got.setdefault((r.id, r.other_id), []).append((r.place, r.other_place))
    for a, b in pairs:
        x, y = lists[a], lists[b]
        common = {s for n in range(len(x) + 1) for s in itertools.combinations(x, n)} & {s for n in range(len(y) + 1) for s in itertools.combinations(y, n)}
        m = got.get((a, b), [])
        assert len(m) == max(map(len, common))
        assert all(x[i] == y[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_joined_attributes_keep_the_first(spark):
    a = spark.sql("SELECT 1L AS id, map('x', '1') AS attributes UNION ALL SELECT 2L, map('y', '2')")
    b = spark.sql("SELECT 1L AS id, map('x', '9', 'z', '3') AS attributes UNION ALL SELECT 3L, map('w', '4')")
    got = {r.id: r.attributes for r in df.joined_attributes(a, b, "id").collect()}
    assert got == {1: {"x": "1", "z": "3"}, 2: {"y": "2"}, 3: {"w": "4"}}
    assert df.with_members(spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 2), (2, 1)], "collection_id long, member_id long")).where(F.col("is_type")).count() == 0


def test_a_call_counts_among_what_is_to_be_reached(spark):
    evaluation, dependency, member, called = walk_tables(spark)
    start = spark.createDataFrame([(8, 8), (4, 4)], "src long, node long")
    stop = spark.createDataFrame([(8, 4), (4, 1)], "src long, node long")
    got = {(r.src, r.node, r.at, r.is_call) for r in navigate(evaluation, dependency, start, member, called, stop_on=stop).collect()}
    assert got == {(8, 8, 8, False), (8, 7, 7, False), (8, 4, 4, True), (4, 4, 4, False), (4, 5, 5, True)}


def test_bridged_walks_begin_beside_hidden_nodes_only(spark, monkeypatch):
    """Random edges, cycles through hidden nodes included, against a search; shown edges are walked from nowhere."""
    draw = random.Random(5)
    edges = {(draw.randrange(30), draw.randrange(30), draw.choice("abc")) for _ in range(60)}
    hid = {n for n in range(30) if n % 3 == 0}
    seeded, closure = [], df.graph_closure
    monkeypatch.setattr(df, "graph_closure", lambda seeds, *rest: seeded.append({r.node for r in seeds.collect()}) or closure(seeds, *rest))
    dependency = spark.createDataFrame(list(edges), "dependent_id long, dependency_id long, type string")
    got = {(r.source, r.target): (r.types, r.propagated) for r in df.bridged(dependency, spark.createDataFrame([(n,) for n in hid], "id long")).collect()}
    wanted = {}
    for source in {a for a, _, _ in edges} - hid:
        seen, todo = {source}, [source]
        while todo:
            todo += [b for a, b, _ in edges if a == todo[0] and b in hid and b not in seen]
            seen |= set(todo)
            todo.pop(0)
        ahead = [e for e in edges if e[0] in seen]
        for target in {b for _, b, _ in edges} - hid:
            back, todo = {target}, [target]
            while todo:
                todo += [a for a, b, _ in edges if b == todo[0] and a in hid and a not in back]
                back |= set(todo)
                todo.pop(0)
            if ways := [e for e in ahead if e[1] in back]:
                wanted[source, target] = ",".join(sorted({t for _, _, t in ways})), any((a, b) != (source, target) for a, b, _ in ways)
    assert got == wanted
    assert seeded == [{a for a, b, _ in edges if a not in hid and b in hid}, {b for a, b, _ in edges if a in hid and b not in hid}]


def test_coarse_grain_carries_columns(spark):
    draw = random.Random(7)
    activation = spark.createDataFrame([(i // 20, i, None if i % 20 == 0 else i - 1 - draw.randrange(i % 20)) for i in range(100)], "trial_id long, id long, caller_id long")
    evaluation = spark.createDataFrame([(i // 4 // 20, i, i // 4, draw.randrange(9)) for i in range(400)], "trial_id long, id long, activation_id long, code_component_id long")
    dependency = spark.createDataFrame([(i, draw.randrange(400), "use") for i in range(400)], "dependent_id long, dependency_id long, type string")
    # one call has no evaluation in the table
    own = evaluation.groupBy("activation_id").agg(F.min("id").alias("id")).withColumn("id", F.when(F.col("activation_id") == 7, 9999).otherwise(F.col("id")))
    plain = df.coarse_grain(activation, evaluation, dependency, own, 3)
    with_component = df.coarse_grain(activation, evaluation, dependency, own, 3, ("code_component_id",))
    joined = plain.join(evaluation.select("id", "code_component_id"), "id").select("trial_id", "id", "cluster_id", "code_component_id")
    assert plain.count() == joined.count() + 1 and sorted(map(tuple, joined.collect())) == sorted(map(tuple, with_component.collect()))
    assert sorted(map(tuple, df.loopless(plain, evaluation).collect())) == sorted(map(tuple, df.loopless(with_component, evaluation).collect()))
