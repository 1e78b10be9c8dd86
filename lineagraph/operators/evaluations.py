"""Selections over evaluations, activations, components and file accesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.operators.closure import ancestors


def query_evaluations(evaluation: DataFrame, component: DataFrame, *conditions: Column) -> DataFrame:
    """Evaluations with their component's name, type, mode and lines, under conditions on any of these."""
    code = component.select(F.col("id").alias("code_component_id"), "name", "type", "mode", "first_char_line", "first_char_column")
    joined = evaluation.join(code, "code_component_id")
    for c in conditions:
        joined = joined.where(c)
    return joined


def by_type(evaluation: DataFrame, component: DataFrame, kind: str) -> DataFrame:
    return query_evaluations(evaluation, component, F.col("type") == kind).select("id", "name", "repr")


def first_evaluations(evaluation: DataFrame) -> DataFrame:
    """Per component its earliest evaluation."""
    return evaluation.groupBy("code_component_id").agg(F.min_by("id", F.struct("checkpoint", "id")).alias("id"))


def nth_evaluations(evaluation: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("code_component_id").orderBy("id"))
    return evaluation.withColumn("place", place).where(F.col("place") == n).select("code_component_id", "id")


def assignment_sources(dependency: DataFrame) -> DataFrame:
    """Per evaluation the first one that it was assigned from."""
    return dependency.where("type = 'assignment'").groupBy(F.col("dependent_id").alias("id")).agg(F.min("dependency_id").alias("source_id"))


def reference_roots(dependency: DataFrame) -> DataFrame:
    """Per evaluation the last one along its reference edges (the least target of each), the last before a cycle closes."""
    step = dependency.where("reference").groupBy(F.col("dependent_id").alias("node")).agg(F.min("dependency_id").alias("up"))
    up = ancestors(step, "node", "up").where("depth > 0 or ancestor = node").groupBy("node").agg(F.max_by("ancestor", "depth").alias("root"), F.max("depth").alias("depth"))
    return up.where("depth > 0").select("node", "root")


def inner_activations(activation: DataFrame) -> DataFrame:
    return activation.where("caller_id is not null").select("caller_id", "id", "name")


def without_evaluations(activation: DataFrame, evaluation: DataFrame) -> DataFrame:
    return activation.join(evaluation.select(F.col("activation_id").alias("id")), "id", "left_anti").select("id", "name")


def with_evaluations(activation: DataFrame, evaluation: DataFrame) -> DataFrame:
    return activation.join(evaluation.select(F.col("activation_id").alias("id")), "id", "left_semi").select("id", "name")


def stacks(activation: DataFrame, separator: str = " -> ") -> DataFrame:
    """(id, stack): the names from below the root down to each activation."""
    up = ancestors(activation.select("id", "caller_id"), "id", "caller_id")
    tops = activation.where("caller_id is null").select(F.col("id").alias("ancestor"))
    named = up.join(activation.select(F.col("id").alias("ancestor"), "name"), "ancestor").join(tops, "ancestor", "left_anti")
    return named.groupBy(F.col("node").alias("id")).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("depth", "name")))), lambda x: x["name"]), separator).alias("stack"))


def parameters(dependency: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Per activation the values of its argument dependencies, in order."""
    args = dependency.where("type = 'argument'").select("activation_id", F.col("dependency_id").alias("id"))
    valued = args.join(evaluation.select("id", "repr"), "id")
    return valued.groupBy("activation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "repr"))), lambda x: x["repr"]), ",").alias("arguments"))


def activation_report(activation: DataFrame, evaluation: DataFrame) -> DataFrame:
    inner = evaluation.groupBy(F.col("activation_id").alias("id")).agg(F.count("*").alias("n"), F.max_by("repr", "id").alias("last_value"))
    return activation.join(inner, "id", "left").select("id", "name", "line", (F.col("finish_checkpoint") - F.col("start_checkpoint")).alias("duration"), F.coalesce("n", F.lit(0)).alias("evaluations"), "last_value")


def contained(component: DataFrame) -> DataFrame:
    """(container, id): components at any depth inside each."""
    return ancestors(component, "id", "container_id").where("depth > 0").select(F.col("ancestor").alias("container"), F.col("node").alias("id"))


def contained_evaluations(component: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Per component how many evaluations it and its parts have."""
    inside = ancestors(component, "id", "container_id").select(F.col("ancestor").alias("container"), F.col("node").alias("code_component_id"))
    counts = evaluation.groupBy("code_component_id").agg(F.count("*").alias("n"))
    return inside.join(counts, "code_component_id").groupBy("container").agg(F.sum("n").alias("evaluations"))


def in_lines(component: DataFrame, first: int, last: int) -> DataFrame:
    return component.where((F.col("first_char_line") >= first) & (F.col("last_char_line") <= last))


def definition_members(component: DataFrame, name: str | None = None) -> DataFrame:
    """Components within the lines of the first one of that name, or of the least name."""
    named = component.where(F.col("name").isNotNull() if name is None else F.col("name") == name)
    span = named.agg(F.min(F.struct("name", "first_char_line", "last_char_line")).alias("s")).select(F.col("s.first_char_line").alias("a"), F.col("s.last_char_line").alias("b"))  # one row
    return component.join(F.broadcast(span), (F.col("first_char_line") >= F.col("a")) & (F.col("last_char_line") <= F.col("b"))).drop("a", "b")


def variable_contents(evaluation: DataFrame, component: DataFrame, mode: str = "w") -> DataFrame:
    return query_evaluations(evaluation, component, F.col("mode") == mode).select("first_char_line", "name", "id", "repr")


def innermost_container(component: DataFrame) -> DataFrame:
    """(id, block_id): of the components with lines around a line, the one with the fewest (loops of the prospective graph)."""
    spans = component.where("last_char_line > first_char_line").groupBy("first_char_line", "last_char_line").agg(F.min("id").alias("block_id"))
    lines = spans.select("block_id", "first_char_line", "last_char_line", F.explode(F.sequence("first_char_line", "last_char_line")).alias("line"))
    best = lines.groupBy("line").agg(F.min(F.struct((F.col("last_char_line") - F.col("first_char_line")).alias("size"), "block_id")).alias("b"))
    return component.select("id", F.col("first_char_line").alias("line")).join(best, "line").select("id", F.col("b.block_id").alias("block_id"))
