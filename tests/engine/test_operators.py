"""Operators on hand-made fixtures."""

from __future__ import annotations

import pytest
from lineagraph.functions import scalars as sc
from lineagraph.operators import evaluations as ev
from lineagraph.operators import lineage as li
from lineagraph.operators import rules as ru
from lineagraph.operators import summaries as su
from lineagraph.operators import trials as tr
from lineagraph.operators.closure import ancestors, graph_closure
from lineagraph.sources import store as st
from pyspark.sql import functions as F

#: The program ``a = [1]; b = f(a)`` with ``def f(x): return x``: numbered evaluations and what each was made of.
ASSIGN = [("a_write", "list"), ("f_variable", "f_eval"), ("f_func", "f_variable"), ("a_arg", "a_read"), ("a_read", "a_write"), ("x_param", "a_arg"), ("x_return", "x_param"), ("return", "x_return"), ("f_activation", "return"), ("b_write", "f_activation"), ("list", "list0")]
NAMES = sorted({n for e in ASSIGN for n in e})


@pytest.fixture
def assign(spark):
    rows = [(NAMES.index(a), NAMES.index(b), "assignment", True, 1) for a, b in ASSIGN]
    return spark.createDataFrame(rows, "dependent_id long, dependency_id long, type string, reference boolean, activation_id long")


def test_lineage_of_the_assign_program(spark, assign):
    seeds = spark.createDataFrame([(NAMES.index("b_write"),)], "id long")
    got = {NAMES[r.node] for r in li.derivation(assign, seeds).where("depth > 0").collect()}
    assert got == {"f_activation", "return", "x_return", "x_param", "a_arg", "a_read", "a_write", "list", "list0"}
    targets = spark.createDataFrame([(NAMES.index("list0"),), (NAMES.index("f_eval"),)], "id long")
    assert li.was_derived_from(assign, seeds, targets).first().targets == 1


def test_reference_root(assign):
    got = {NAMES[r.node]: NAMES[r.root] for r in ev.reference_roots(assign).collect()}
    assert got["a_read"] == "list0" and got["f_func"] == "f_eval"


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "node long, next_node long")
    seeds = spark.createDataFrame([(1, 1), (4, 4)], "src long, node long")
    assert sorted((r.src, r.node, r.depth) for r in graph_closure(seeds, edges).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0)]


def test_ancestors_of_a_long_path(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "n long, p long")
    got = sorted((r.node, r.ancestor, r.depth) for r in ancestors(tree, "n", "p").collect())
    assert got == [(i, j, i - j) for i in range(40) for j in range(i + 1)]


def test_members_as_of_ties_and_moments(spark):
    rows = [(1, "k", 10, 1), (1, "k", 11, 5), (1, "k", 12, 5), (1, "m", 13, 9), (2, "k", 14, 2)]
    member = spark.createDataFrame(rows, "collection_id long, key string, member_id long, checkpoint long")
    assert sorted(map(tuple, li.members_as_of(member, F.lit(5)).collect())) == [(1, "k", 12), (2, "k", 14)]
    assert li.members_as_of(member, F.lit(0)).count() == 0
    at = li.members_at(member, spark.createDataFrame([(1, 4), (1, 9)], "collection_id long, checkpoint long"))
    assert sorted(map(tuple, at.collect())) == [(1, 4, "k", 10), (1, 9, "k", 12), (1, 9, "m", 13)]


def test_patterns_bind_filter_and_join(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (3, 3, None)], "x long, y long, z string")
    assert [r.v for r in ru.pattern(t, x="?v", y="?v").orderBy("v").collect()] == [1, 3]
    assert ru.pattern(t, z=None, x="?v").first().v == 3
    assert ru.conjunction(ru.pattern(t, x="?_k", z="?z"), ru.pattern(t, y="?_k", x="?x")).columns == ["z", "x"]
    with pytest.raises(ValueError):
        ru.conjunction(ru.pattern(t, x="?a"), ru.pattern(t, y="?b"))


def test_scalars(spark):
    df = spark.createDataFrame([("r+", "/home/now/a.txt", "1.10.b2", "1.5", 3_723_000_000)], "mode string, path string, version string, value string, micros long")
    row = df.select(
        sc.reads(F.col("mode")), sc.writes(F.col("mode")), sc.relative_path(F.col("path"), "/home/now"), sc.basename(F.col("path")), sc.version_parts(F.col("version")),
        sc.value_text(F.col("value")), sc.duration_text(F.col("micros")), sc.like_wildcard(F.col("path"), "*.txt"), sc.short_label(F.col("path"), 11),
    ).first()
    assert list(row) == [True, True, "a.txt", "a.txt", [1, 10, -1], "1.5f", "1:02:03", True, "/hom....txt"]


def test_upsert_and_content(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    assert sorted(map(tuple, st.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    put = st.put_content(spark.createDataFrame([], "hash string, value string"), spark.createDataFrame([("x",), ("x",), ("y",)], "t string"), "t")
    assert put.count() == 2


def test_tags_bump(spark):
    tag = spark.createDataFrame([(1, "AUTO", "1.2.9"), (1, "AUTO", "1.2.10"), (1, "USER", "9.9.9")], "trial_id long, type string, name string")
    row = tr.next_tags(tag).first()
    assert (row["name"], row.patch, row.minor, row.major) == ("1.2.10", "1.2.11", "1.3.1", "2.1.1")


def test_diff_sets(spark):
    rows = [(1, "PATH", "a"), (1, "HOME", "h"), (2, "PATH", "b"), (2, "HOME", "h"), (2, "LANG", "en")]
    table = spark.createDataFrame(rows, "trial_id long, name string, value string")
    assert sorted((r["name"], r.kind, r.n) for r in su.diff_sets(table, 1, 2, "name", ["value"]).collect()) == [("LANG", "added", 1), ("PATH", "replaced", 1)]


def test_bridging_hidden_nodes(spark):
    dep = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "dependent_id long, dependency_id long")
    got = su.propagated(dep, spark.createDataFrame([(2,), (3,)], "id long"))
    assert [tuple(r) for r in got.collect()] == [(1, 4)]


def test_lines_of_activations(spark):
    """Ranges that overlap give each line once, and one that ends before it begins gives none, as in SQL."""
    from lineagraph.operators import rules

    evaluation = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 3), (2, 3), (3, 1)], "activation_id long, code_component_id long")
    component = spark.createDataFrame([(1, 9, 11), (2, 10, 13), (3, 7, 5)], "id long, first_char_line int, last_char_line int")
    assert {r.activation_id: r.lines for r in rules.lines_of_activations(evaluation, component).collect()} == {1: "9,10,11,12,13", 3: "9,10,11"}
