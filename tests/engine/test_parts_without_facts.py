"""Parts of a graph need neither what is written of its nodes nor hashes of their subtrees."""

from lineagraph.operators import exports as ex
from lineagraph.operators.trees import numbered


def test_parts_are_the_same_without_facts_and_hashes(spark):
    rows = [(1, "activation", 1, None), (1, "activation", 2, 1), (1, "evaluation", 5, 1), (1, "evaluation", 6, 2), (1, "access", 9, 2), (2, "activation", 7, None)]
    parts = spark.createDataFrame(rows, "trial_id long, kind string, id long, cluster_id long")
    graph = ex.graph_nodes(parts)
    assert "value" not in graph.columns
    got = {(r.node, r.kind, r.id, r.enter, r["size"]) for r in ex.cluster_parts(graph).collect()}
    assert got == {("c_1", "activation", 1, 0, 5), ("e_5", "evaluation", 5, 1, 1), ("c_2", "activation", 2, 2, 3), ("e_6", "evaluation", 6, 3, 1), ("a_9", "access", 9, 4, 1), ("c_7", "activation", 7, 0, 1)}
    tree = graph.selectExpr("trial_id as tree_id", "node as id", "parent as parent_id", "place", "node as label")
    bare, full = numbered(tree, alike=False), numbered(tree)
    assert set(full.columns) - set(bare.columns) == {f"{c}{k}" for c in "sle" for k in (1, 2)}
    assert bare.exceptAll(full.select(*bare.columns)).count() == 0 and bare.count() == 6
    assert numbered(tree.limit(0), alike=False).columns and set(numbered(tree.limit(0), alike=False).columns) == set(bare.columns)
