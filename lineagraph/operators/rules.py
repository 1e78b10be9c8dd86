"""The rule library: each rule is a view over provenance tables, each query a natural join of views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.functions.scalars import reads, writes
from lineagraph.operators.closure import ancestors, graph_closure


def pattern(table: DataFrame, **arguments) -> DataFrame:
    """A table pattern: constants filter, names given as ``"?x"`` bind (twice: equal), the rest is open."""
    binds: dict[str, list[str]] = {}
    for column, value in arguments.items():
        if isinstance(value, Column):
            table = table.where(value)
        elif isinstance(value, str) and value.startswith("?"):
            binds.setdefault(value[1:], []).append(column)
        else:
            table = table.where(F.col(column).eqNullSafe(F.lit(value)))
    for columns in binds.values():
        for other in columns[1:]:
            table = table.where(F.col(columns[0]) == F.col(other))
    return table.select(*(F.col(c[0]).alias(v) for v, c in binds.items()))


def conjunction(*patterns: DataFrame) -> DataFrame:
    """All patterns together: inner joins on shared variables; those with a leading underscore go."""

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            raise ValueError("patterns without a shared variable would be a cross join")
        return a.join(b, shared)

    out = reduce(join, patterns)
    return out.select(*(c for c in out.columns if not c.startswith("_"))).distinct()


def names(**models: DataFrame) -> DataFrame:
    """(model, id, name): the tagged union of the models' names."""
    return reduce(DataFrame.unionByName, (t.select(F.lit(m).alias("model"), "id", "name") for m, t in models.items()))


def timestamps(activation: DataFrame, evaluation: DataFrame | None = None, trial: DataFrame | None = None, access: DataFrame | None = None) -> DataFrame:
    """(trial_id, id, moment, at): starts and finishes of trials (as id 0) and activations, finishes of evaluations, and accesses.

    Moments of the clock are seconds since 1970, checkpoints are as they are.
    """
    ends = lambda t, i, a, b: t.select("trial_id", i.cast("long").alias("id"), F.explode(F.array(F.struct(F.lit("start").alias("moment"), a.cast("long").alias("at")), F.struct(F.lit("finish").alias("moment"), b.cast("long").alias("at")))).alias("x")).select("trial_id", "id", "x.moment", "x.at")
    out = ends(activation, F.col("id"), F.col("start_checkpoint"), F.col("finish_checkpoint"))
    if evaluation is not None:
        out = out.unionByName(evaluation.select("trial_id", "id", F.lit("finish").alias("moment"), F.col("checkpoint").cast("long").alias("at")))
    if trial is not None:
        out = out.unionByName(ends(trial.where("start is not null").withColumn("trial_id", F.col("id")), F.lit(0), F.unix_timestamp("start"), F.unix_timestamp("finish")))
    if access is not None:
        out = out.unionByName(access.select("trial_id", "id", F.lit("access").alias("moment"), F.unix_timestamp("checkpoint").alias("at")))
    return out


def durations(activation: DataFrame) -> DataFrame:
    return activation.select("id", (F.col("finish_checkpoint") - F.col("start_checkpoint")).alias("duration"))


def successors(activation: DataFrame) -> DataFrame:
    """(before, after) in one trial: the second finishes no earlier than the first starts."""
    a = activation.select("trial_id", F.col("id").alias("before"), F.col("start_checkpoint").alias("at"))
    b = activation.select("trial_id", F.col("id").alias("after"), F.col("finish_checkpoint").alias("then"))
    return a.join(b, "trial_id").where("at <= then and before <> after").select("trial_id", "before", "after")


def modes(component: DataFrame, access: DataFrame) -> DataFrame:
    return component.select(F.lit("code").alias("model"), "id", "mode").unionByName(access.select(F.lit("access").alias("model"), "id", "mode"))


def hashes(access: DataFrame, content: DataFrame) -> DataFrame:
    """(model, id, moment, hash): contents before and after accesses, and of code blocks."""
    both = access.select("id", F.explode(F.array(F.struct(F.lit("before").alias("moment"), F.col("content_hash_before").alias("hash")), F.struct(F.lit("after").alias("moment"), F.col("content_hash_after").alias("hash")))).alias("x"))
    rows = both.select(F.lit("access").alias("model"), "id", "x.moment", "x.hash").where("hash is not null")
    return rows.unionByName(content.select(F.lit("block").alias("model"), "id", F.lit("").alias("moment"), "hash"))


def changed(access: DataFrame) -> DataFrame:
    return access.where(~F.col("content_hash_before").eqNullSafe(F.col("content_hash_after"))).select("id", "name")


def code_lines(component: DataFrame) -> DataFrame:
    return component.select("id", F.explode(F.sequence("first_char_line", "last_char_line")).alias("line"))


def evaluation_lines(evaluation: DataFrame, component: DataFrame) -> DataFrame:
    return evaluation.select("id", "code_component_id").join(code_lines(component).withColumnRenamed("id", "code_component_id"), "code_component_id").select("id", "line")


def lines_of_activations(evaluation: DataFrame, component: DataFrame) -> DataFrame:
    """Per activation the sorted distinct lines of its evaluations; their ranges are gathered, not a row a line."""
    ranges = component.where("first_char_line <= last_char_line").select(F.col("id").alias("code_component_id"), F.sequence("first_char_line", "last_char_line").alias("lines"))
    held = evaluation.select("activation_id", "code_component_id").join(ranges, "code_component_id").groupBy("activation_id").agg(F.collect_set("lines").alias("held"))
    return held.select("activation_id", F.array_join(F.array_sort(F.array_distinct(F.flatten("held"))), ",").alias("lines"))


def scopes(component: DataFrame) -> DataFrame:
    """The container's type, or 'project'."""
    outer = component.select(F.col("id").alias("container_id"), F.col("type").alias("scope"))
    return component.join(outer, "container_id", "left").select("id", F.coalesce("scope", F.lit("project")).alias("scope"))


def files_read(access: DataFrame) -> DataFrame:
    return access.where(reads(F.col("mode"))).select("trial_id", "id", "name")


def files_written(access: DataFrame) -> DataFrame:
    return access.where(writes(F.col("mode"))).select("trial_id", "id", "name")


def activation_stacks(activation: DataFrame) -> DataFrame:
    """(id, stack): callers, the nearest first."""
    up = ancestors(activation, "id", "caller_id").where("depth > 0")
    return up.groupBy(F.col("node").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"].cast("string")), ",").alias("stack"))


def indirect_activations(activation: DataFrame) -> DataFrame:
    """(caller, called) at any distance."""
    return ancestors(activation, "id", "caller_id").where("depth > 0").select(F.col("ancestor").alias("caller"), F.col("node").alias("called"))


def internal_evaluations(activation: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Per activation the number of evaluations in it and in all that it calls."""
    inner = ancestors(activation, "id", "caller_id").select(F.col("ancestor").alias("activation_id"), F.col("node").alias("called"))
    counts = evaluation.groupBy(F.col("activation_id").alias("called")).agg(F.count("*").alias("n"))
    return inner.join(counts, "called").groupBy("activation_id").agg(F.sum("n").alias("evaluations"))


def indirect_accesses(activation: DataFrame, access: DataFrame) -> DataFrame:
    """(activation, access): accesses in an activation or in one that it calls."""
    inner = ancestors(activation, "id", "caller_id").select(F.col("ancestor").alias("activation"), F.col("node").alias("activation_id"))
    return access.select(F.col("id").alias("access"), "activation_id").join(inner, "activation_id").select("activation", "access")


def access_influence(access: DataFrame, activation: DataFrame) -> DataFrame:
    """(trial_id, read, written): each access that reads with each one of the trial that writes at the same time or
    later, where the reading activation starts no later than the writing one finishes.

    Every such pair is asked for, so the result is quadratic in a trial's accesses.
    """
    starts, ends = activation.select(F.col("id").alias("activation_id"), "start_checkpoint"), activation.select(F.col("id").alias("activation_id"), "finish_checkpoint")
    r = access.where(reads(F.col("mode"))).join(starts, "activation_id").select("trial_id", F.col("id").alias("read"), F.col("checkpoint").alias("at"), "start_checkpoint")
    w = access.where(writes(F.col("mode"))).join(ends, "activation_id").select("trial_id", F.col("id").alias("written"), F.col("checkpoint").alias("then"), "finish_checkpoint")
    return r.join(w, "trial_id").where("at <= then and start_checkpoint <= finish_checkpoint").select("trial_id", "read", "written")


def slice_edges(dependency: DataFrame) -> DataFrame:
    """Dependencies that a slice follows: all but arguments."""
    return dependency.where(~F.col("type").startswith("arg")).select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node"))


def backward_slices(dependency: DataFrame, seeds: DataFrame) -> DataFrame:
    """(src, node): all evaluations that each seed (column id) derives from, itself included."""
    return graph_closure(seeds.select(F.col("id").alias("src"), F.col("id").alias("node")), slice_edges(dependency), one_seed=True).select("src", "node")


def slice_lines(dependency: DataFrame, seeds: DataFrame, evaluation: DataFrame, component: DataFrame) -> DataFrame:
    inside = backward_slices(dependency, seeds).withColumnRenamed("node", "id").join(evaluation.select("id", "code_component_id"), "id")
    return inside.join(code_lines(component).withColumnRenamed("id", "code_component_id"), "code_component_id").select("src", "line").distinct()
