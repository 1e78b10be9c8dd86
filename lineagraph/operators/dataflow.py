"""Dataflow graphs: which nodes a drawing shows, in which clusters, and the edges between them.

An activation without a caller is the main cluster of its trial. ``own`` tables (activation_id, id)
say which evaluation stands for an activation's call.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.operators.closure import ancestors, graph_closure


def _edges(dependency: DataFrame) -> DataFrame:
    return dependency.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node"), "type")


def activation_nodes(activation: DataFrame, inner: DataFrame, max_depth: int) -> DataFrame:
    """(trial_id, id, cluster_id, shape): activations in the cluster of their caller.

    One is a leaf if ``inner`` (column id) lacks it or the next depth is hidden, and nothing below a
    leaf is shown. Main activations are clusters at depth one, in no cluster.
    """
    depth = ancestors(activation, "id", "caller_id").groupBy(F.col("node").alias("id")).agg((F.max("depth") + 1).alias("level"))
    filled = inner.select("id").distinct().withColumn("filled", F.lit(True))
    placed = activation.select("trial_id", "id", F.col("caller_id").alias("cluster_id")).join(depth, "id").join(filled, "id", "left")
    cluster = F.col("cluster_id").isNull() | (F.col("filled").isNotNull() & (F.col("level") <= max_depth))
    # a caller has something in it, so only its depth decides whether it is a cluster
    shown = placed.where((F.col("level") <= 2) | (F.col("level") - 1 <= max_depth))
    return shown.select("trial_id", "id", "cluster_id", F.when(cluster, "cluster").otherwise("leaf").alias("shape"))


def calls_only(activation: DataFrame, max_depth: int) -> DataFrame:
    """The graph of activations: those that call others are clusters."""
    return activation_nodes(activation, activation.where("caller_id is not null").select(F.col("caller_id").alias("id")), max_depth)


def fine_grain(activation: DataFrame, evaluation: DataFrame, access: DataFrame, max_depth: int) -> DataFrame:
    """(trial_id, kind, id, cluster_id): activations, and the evaluations and accesses in their clusters.

    Accesses of a hidden activation or a leaf go to the nearest cluster above.
    """
    inner = evaluation.select(F.col("activation_id").alias("id")).unionByName(activation.where("caller_id is not null").select(F.col("caller_id").alias("id")))
    calls = activation_nodes(activation, inner, max_depth)
    clusters = calls.where("shape = 'cluster'").select("trial_id", F.col("id").alias("cluster_id"))
    evaluations = evaluation.select("id", F.col("activation_id").alias("cluster_id")).join(clusters, "cluster_id")
    above = ancestors(activation, "id", "caller_id").join(clusters.withColumnRenamed("cluster_id", "ancestor"), "ancestor")
    nearest = above.groupBy(F.col("node").alias("activation_id")).agg(F.min_by(F.struct("trial_id", "ancestor"), "depth").alias("c"))
    files = access.select("id", "activation_id").join(nearest, "activation_id").select(F.col("c.trial_id").alias("trial_id"), "id", F.col("c.ancestor").alias("cluster_id"))
    parts = {"activation": calls, "evaluation": evaluations, "access": files}
    return reduce(DataFrame.unionByName, (t.select("trial_id", F.lit(k).alias("kind"), "id", "cluster_id") for k, t in parts.items()))


def one_cluster(activation: DataFrame, evaluation: DataFrame, own: DataFrame) -> DataFrame:
    """(trial_id, id, cluster_id): all evaluations of a trial but the main one's, in its main cluster."""
    main = activation.where("caller_id is null").groupBy("trial_id").agg(F.min("id").alias("cluster_id"))
    itself = main.join(own.withColumnRenamed("activation_id", "cluster_id"), "cluster_id").select("id")
    return evaluation.select("trial_id", "id").join(itself, "id", "left_anti").join(main, "trial_id").select("trial_id", "id", "cluster_id")


def coarse_grain(activation: DataFrame, evaluation: DataFrame, dependency: DataFrame, own: DataFrame, max_depth: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(trial_id, id, cluster_id): the calls' evaluations, and those that they depend on or that depend
    on them, each of these in the cluster of its activation if that is one. With ``carried`` columns of
    evaluations, only nodes that are evaluations."""
    calls = stored(calls_only(activation, max_depth))
    clusters = calls.where("shape = 'cluster'").select("trial_id", F.col("id").alias("cluster_id"))
    called = stored(calls.where("cluster_id is not null").join(own.select(F.col("activation_id").alias("act"), F.col("id").alias("node")), F.col("id") == F.col("act")).select("trial_id", "node", "cluster_id"))
    both = _edges(dependency).select("node", "next_node").unionByName(_edges(dependency).select(F.col("next_node").alias("node"), F.col("node").alias("next_node")))
    near = called.select("node").join(both, "node").select(F.col("next_node").alias("id")).distinct().join(called.select(F.col("node").alias("id")), "id", "left_anti")
    own_of = evaluation.select("id", F.col("activation_id").alias("cluster_id"), *carried)
    if not carried:
        beside = own_of.join(near, "id", "left_semi")
        return called.select("trial_id", F.col("node").alias("id"), "cluster_id").unionByName(beside.join(clusters, "cluster_id").select("trial_id", "id", "cluster_id"))
    none = F.lit(None).cast("long")
    marks = called.select(F.col("node").alias("id"), F.col("trial_id").alias("call_trial"), F.col("cluster_id").alias("call_cluster"), F.lit(True).alias("call")).unionByName(near.select("id", none.alias("call_trial"), none.alias("call_cluster"), F.lit(False).alias("call")))
    met = own_of.join(marks, "id").join(clusters, "cluster_id", "left").where("call or trial_id is not null")
    of = lambda a, b: F.when(F.col("call"), F.col(a)).otherwise(F.col(b)).alias(b)
    return met.select(of("call_trial", "trial_id"), "id", of("call_cluster", "cluster_id"), *carried)


def loopless(nodes: DataFrame, evaluation: DataFrame) -> DataFrame:
    """The nodes (trial_id, id, cluster_id) with at most one a code component: its least. Nodes may carry code_component_id."""
    of = nodes if "code_component_id" in nodes.columns else nodes.join(evaluation.select("id", "code_component_id"), "id")
    first = of.groupBy("trial_id", "code_component_id").agg(F.min_by(F.struct("id", "cluster_id"), "id").alias("n"))
    return first.select("trial_id", "n.id", "n.cluster_id")


def with_members(shown: DataFrame, member: DataFrame) -> DataFrame:
    """(id, is_type): the shown nodes (column id), the collections they are in, and all their members.

    A node that is only reached as a member is a type, whose own collections are not shown.
    """
    at = lambda df: df.select(F.lit(0).alias("src"), F.col("id").alias("node"))
    up = member.select(F.col("member_id").alias("node"), F.col("collection_id").alias("next_node")).distinct()
    down = up.select(F.col("next_node").alias("node"), F.col("node").alias("next_node"))
    above = graph_closure(at(shown), up).select(F.col("node").alias("id"))
    below = graph_closure(at(above), down).where("depth > 0").select(F.col("node").alias("id")).join(above, "id", "left_anti")
    return above.withColumn("is_type", F.lit(False)).unionByName(below.withColumn("is_type", F.lit(True)))


def bridged(dependency: DataFrame, hidden: DataFrame) -> DataFrame:
    """(source, target, types, propagated): the edges between shown nodes once hidden ones (column id) are taken out.

    An edge has the types of all dependencies on its ways through hidden nodes, in order and with
    commas, and is propagated if one of its ways has a hidden node. Loops are kept.
    """
    out = hidden.select(F.col("id").alias("hid")).distinct()
    # both ends are marked once; a walk only begins at shown nodes beside a hidden one, and only hidden ones are reached
    edges = _edges(dependency).where("node is not null and next_node is not null")
    for end, mark in (("node", "from_hidden"), ("next_node", "to_hidden")):
        edges = edges.join(out, F.col(end) == F.col("hid"), "left").withColumn(mark, F.col("hid").isNotNull()).drop("hid")
    edges = stored(edges)
    into = edges.where("to_hidden").select("node", "next_node").distinct()
    from_ = edges.where("from_hidden").select(F.col("next_node").alias("node"), F.col("node").alias("next_node")).distinct()
    begun = lambda of, c: edges.where(of).select(F.col(c).alias("node")).distinct().select(F.col("node").alias("src"), "node")
    ahead = graph_closure(begun("to_hidden and not from_hidden", "node"), into).where("depth > 0").select(F.col("src").alias("source"), "node")
    behind = graph_closure(begun("from_hidden and not to_hidden", "next_node"), from_).where("depth > 0").select(F.col("src").alias("target"), F.col("node").alias("next_node"))
    columns = ["source", "next_node", "type", "to_hidden", "through"]
    begins = edges.where("not from_hidden").select(F.col("node").alias("source"), "next_node", "type", "to_hidden", F.col("to_hidden").alias("through"))
    begins = begins.unionByName(edges.where("from_hidden").join(ahead, "node").withColumn("through", F.lit(True)).select(*columns))
    ways = begins.where("not to_hidden").select("source", F.col("next_node").alias("target"), "type", "through")
    ways = ways.unionByName(begins.where("to_hidden").join(behind, "next_node").select("source", "target", "type", "through"))
    return ways.groupBy("source", "target").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"), F.bool_or("through").alias("propagated"))


def joined_attributes(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, attributes): maps (key, attributes) of both tables; of an attribute in both the first's value stays."""
    a, b = first.select(key, F.col("attributes").alias("a")), second.select(key, F.col("attributes").alias("b"))
    only = F.map_filter("b", lambda k, _: ~F.array_contains(F.map_keys("a"), k))
    return a.join(b, key, "full").select(key, F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.map_concat("a", only)).alias("attributes"))
