"""What the heavy queries read many times is projected once; contributing cells walk cells, not their values."""

from lineagraph.operators import lineage as li
from lineagraph.plans import queries as plans
from lineagraph.sources.store import Store

FOLDER = "/root/testdata/sf0.001"


def test_kept_tables_are_read_not_projected_again(spark):
    lazy, kept = Store(spark, FOLDER), Store(spark, FOLDER, ("evaluation", "dependency"))
    for name in ("evaluation", "dependency", "activation"):
        plan = getattr(kept, name)._jdf.queryExecution().optimizedPlan().toString()
        assert ("Window" in plan) == (name == "activation")
        assert getattr(kept, name).exceptAll(getattr(lazy, name)).count() == 0 and getattr(lazy, name).exceptAll(getattr(kept, name)).count() == 0
    assert plans.MANY_READS <= set(plans.QUERIES)


def test_cells_are_walked_without_their_values(spark, monkeypatch):
    component = spark.createDataFrame([(1, None, "cell"), (2, 1, "x"), (3, None, "cell"), (4, None, "x")], "id long, container_id long, type string")
    rows = [(1, i, 2) for i in range(1, 6)] + [(1, 6, 3), (1, 7, 4), (2, 8, 2), (2, 9, 3)]
    evaluation = spark.createDataFrame(rows, "trial_id long, id long, code_component_id long")
    dependency = spark.createDataFrame([(1, 7, 3), (1, 5, 6), (2, 8, 9), (2, 9, 8)], "trial_id long, dependent_id long, dependency_id long")
    sizes = []

    def counted(seeds, edges, keys):
        sizes.append(edges.count())
        return closure(seeds, edges, keys)

    closure = li.graph_closure
    monkeypatch.setattr(li, "graph_closure", counted)
    got = {tuple(r) for r in li.contributing_cells(evaluation, dependency, component, spark.createDataFrame([(7,), (9,)], "id long"), "cell").collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 3)}
    assert sizes == [4]  # one for each dependency; none between a cell and its values
