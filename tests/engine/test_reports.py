"""Created tags, named lineage, bundles, docstrings and accesses of a path on small tables."""

import random

from pyspark.sql import functions as F

from lineagraph.operators import reports as re


def test_tags_go_up_by_level(spark):
    """Same code and command, same code, other code, other code of a backup, and no tag at all."""
    found = spark.createDataFrame([(1, 1, "1.1.1", False), (2, 2, "1.1.2", False), (3, 3, "1.2.1", False), (4, 3, "1.2.1", True), (5, 0, "1.1.1", False), (6, 1, "9.9.9", False)], "id long, level int, tag string, backup boolean")
    assert {r.id: r.name for r in re.created_tags(found, F.col("backup")).collect()} == {1: "1.1.2", 2: "1.2.1", 3: "2.1.1", 4: "2.0.0", 5: "1.1.1", 6: "9.9.10"}


def test_named_dependencies(spark):
    """d from c from b from a: values like their names and repeats are left out, long ones replaced; an argument alone doesn't count."""
    component = spark.createDataFrame([(1, "a"), (2, "b"), (3, "5"), (4, "d")], "id long, name string")
    evaluation = spark.createDataFrame([(1, 10, 1, "x" * 21), (1, 11, 2, "7"), (1, 12, 2, "7"), (1, 13, 3, "5"), (1, 14, 4, "8"), (1, 9, 1, "0")], "trial_id long, id long, code_component_id long, repr string")
    dependency = spark.createDataFrame([(14, 13, "use"), (13, 12, "use"), (12, 11, "use"), (11, 10, "use"), (10, 9, "argument")], "dependent_id long, dependency_id long, type string")
    got = {(r.variable, r.number): (r.name, r.value) for r in re.named_dependencies(dependency, evaluation, component).collect()}
    assert got == {("d", 1): ("d", "8"), ("d", 2): ("b", "7"), ("b", 1): ("b", "7"), ("5", 1): ("b", "7")}
    only = re.named_dependencies(dependency, evaluation, component, spark.createDataFrame([("b",)], "variable string"))
    assert [r.variable for r in only.collect()] == ["b"]


def test_long_values(spark):
    component = spark.createDataFrame([(1, "a")], "id long, name string")
    evaluation = spark.createDataFrame([(1, 2, 1, "y" * 21), (1, 1, 1, "0")], "trial_id long, id long, code_component_id long, repr string")
    dependency = spark.createDataFrame([(2, 1, "use")], "dependent_id long, dependency_id long, type string")
    assert [(r.name, r.value) for r in re.named_dependencies(dependency, evaluation, component).collect()] == [("a", "complex data type")]


def test_bundle_and_docstrings(spark):
    table = spark.createDataFrame([(1, 5), (2, 6)], "trial_id long, id long")
    link = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "trial_id long, id string")
    got = {tuple(r) for r in re.bundle_rows({"module": table}, {"code_block": link}, spark.createDataFrame([(1,)], "trial_id long")).collect()}
    assert got == {("module", 1, "5"), ("code_block", 1, "x")}
    block = spark.createDataFrame([(1, "doc"), (2, None)], "id long, docstring string")
    calls = spark.createDataFrame([(7, "f", 1)], "id long, name string, code_block_id long")
    told = re.docstrings(block, calls, spark.createDataFrame([(1, "def f"), (2, "g"), (3, "h")], "id long, name string"))
    assert sorted((r.model, r.id, r.docstring) for r in told.where("docstring is not null").collect()) == [("activation", 7, "doc"), ("code_block", 1, "doc"), ("code_component", 1, "doc"), ("evaluation", 7, "doc")]


def levels(trials, parent):
    """The sequential rule: scripts by their newest trial, trials from the oldest on, lines counted up."""
    children, scripts, order = {}, {}, []
    for i, script in sorted(trials.items(), reverse=True):
        if i in parent:
            children.setdefault(parent[i], []).append(i)
        if script not in order:
            order.append(script)
    for i, script in sorted(trials.items()):
        scripts.setdefault(script, []).append(i)
    out, lines = {}, [[0, None]]
    for script in order:
        level = 0
        for i in scripts[script]:
            if i not in parent or trials[parent[i]] != script or children[parent[i]].index(i) > 0:
                out[i] = level
            else:
                out[i] = out[parent[i]]
            level = max(level, out[i] + 1)
        if len(scripts[script]) == 1:
            if lines[0][0] == 0:
                lines[0][0] = 1
                for line in lines[1:]:
                    line[0] += 1
                    for i in scripts[line[1]]:
                        out[i] += 1
        else:
            total = lines[-1][0]
            lines.append([total + level, script])
            for i in scripts[script]:
                out[i] += total
    return out


def test_history_levels(spark):
    draw = random.Random(5)
    for scripts in ("abc", "aaab", "abcdefghijkl"):
        trials = {i: draw.choice(scripts) for i in range(1, 60)}
        parent = {i: draw.randrange(max(1, i - 5), i) for i in range(2, 60) if draw.random() < 0.9}
        got = re.history_levels(spark.createDataFrame(list(trials.items()), "id long, script string"), spark.createDataFrame(list(parent.items()), "id long, parent long"))
        assert {r.id: r.level for r in got.collect()} == levels(trials, parent)
    none = spark.createDataFrame([], "id long, script string")
    assert re.history_levels(none, spark.createDataFrame([], "id long, parent long")).count() == 0
