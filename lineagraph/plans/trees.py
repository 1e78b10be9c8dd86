"""Registered queries of call trees: merged graphs, edit distances and merged trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagraph.operators import tree_diff as td
from lineagraph.operators import trees as tr
from lineagraph.plans.queries import query
from lineagraph.sources.store import Store

#: Calls with their place among siblings, the places from the root down (in pre-order when sorted) and the labels likewise.
WALK = (
    ", kid AS (SELECT trial_id, id, caller_id, line, line || '-' || name AS label, finish_checkpoint - start_checkpoint AS duration, "
    "row_number() OVER (PARTITION BY trial_id, caller_id ORDER BY start_checkpoint, id) - 1 AS child, lead(id) OVER (PARTITION BY trial_id, caller_id ORDER BY start_checkpoint, id) AS next_id FROM activation), "
    "walk AS (SELECT *, lpad(child::VARCHAR, 9, '0') AS route, label AS path FROM kid WHERE caller_id IS NULL "
    "UNION ALL SELECT k.*, w.route || '.' || lpad(k.child::VARCHAR, 9, '0'), w.path || '/' || k.label FROM kid k JOIN walk w ON w.id = k.caller_id) "
)
SHAPE = ", shape AS (SELECT w.id, md5(string_agg(substr(d.route, length(w.route) + 1) || '=' || d.label, ';' ORDER BY d.route)) AS shape FROM walk w JOIN walk d ON d.trial_id = w.trial_id AND starts_with(d.route, w.route) GROUP BY 1) "
DEEP = SHAPE + ", deep AS (SELECT w.id, shape AS path FROM walk w JOIN shape s USING (id) WHERE caller_id IS NULL UNION ALL SELECT w.id, md5(d.path || s.shape) FROM walk w JOIN deep d ON d.id = w.caller_id JOIN shape s ON s.id = w.id) "
MARKED = {
    "no_match": ", marked AS (SELECT *, id AS node FROM walk) ",
    "exact_match": DEEP + ", marked AS (SELECT w.*, first_value(w.id) OVER (PARTITION BY w.trial_id, d.path ORDER BY w.route) AS node FROM walk w JOIN deep d ON d.id = w.id) ",
    "namespace_match": ", marked AS (SELECT *, first_value(id) OVER (PARTITION BY trial_id, path ORDER BY route) AS node FROM walk) ",
}
NODES = "SELECT m.trial_id, m.node, min(p.node) AS parent, count(*) AS calls, sum(m.duration)::BIGINT AS duration, string_agg(m.id::VARCHAR, ',' ORDER BY m.route) AS ids FROM marked m LEFT JOIN marked p ON p.id = m.caller_id GROUP BY 1, 2"
EDGES = (
    "SELECT trial_id, source, target, type, count(*) AS count FROM ("
    "SELECT trial_id, node AS source, node AS target, 'initial' AS type FROM marked WHERE caller_id IS NULL AND node = id "
    "UNION ALL SELECT m.trial_id, p.node, m.node, 'call' FROM marked m JOIN marked p ON p.id = m.caller_id WHERE m.node = m.id AND m.child = 0 "
    "UNION ALL SELECT m.trial_id, m.node, n.node, 'sequence' FROM marked m JOIN marked n ON n.id = m.next_id WHERE m.caller_id IS NOT NULL "
    "UNION ALL SELECT DISTINCT m.trial_id, m.node, p.node, 'return' FROM marked m JOIN marked p ON p.id = m.caller_id WHERE m.next_id IS NULL) GROUP BY 1, 2, 3, 4"
)


def calls(s: Store, label: tuple[str, ...] = ("line", "name")) -> DataFrame:
    """The activations of all trials as numbered trees."""
    return tr.numbered(s.activation.select(F.col("trial_id").alias("tree_id"), "id", F.col("caller_id").alias("parent_id"), F.col("start_checkpoint").alias("place"), F.concat_ws("-", *(F.col(c).cast("string") for c in label)).alias("label")))


def values(s: Store) -> DataFrame:
    note = F.concat(F.lit("T"), F.col("trial_id").cast("string"), F.lit(" - "), F.col("id").cast("string"), F.lit("<br>Line "), F.col("line").cast("string"), F.lit("<br>"))
    return s.activation.select("id", (F.col("finish_checkpoint") - F.col("start_checkpoint")).alias("duration"), note.alias("note"))


def nodes(s: Store, mode: str) -> DataFrame:
    return tr.merged_nodes(tr.merged(calls(s), mode), values(s)).withColumnRenamed("tree_id", "trial_id")


def edges(s: Store, mode: str) -> DataFrame:
    return tr.merged_edges(tr.merged(calls(s), mode)).withColumnRenamed("tree_id", "trial_id")


query("sum_02_equal_subtrees", "activation", WALK + SHAPE + "SELECT w.trial_id, w.id, min(w.id) OVER (PARTITION BY w.trial_id, s.shape) AS same_as, (SELECT count(*) FROM walk d WHERE d.trial_id = w.trial_id AND starts_with(d.route, w.route)) AS size FROM walk w JOIN shape s ON s.id = w.id")(
    lambda s: (t := calls(s)).join(t.groupBy("tree_id", "s1", "s2").agg(F.min("id").alias("same_as")), ["tree_id", "s1", "s2"]).select(F.col("tree_id").alias("trial_id"), "id", "same_as", "size")
)
query("sum_02_graph_edges", "activation", WALK + MARKED["no_match"] + EDGES)(lambda s: edges(s, "no_match"))
query("sum_03_exact_match", "activation", WALK + MARKED["exact_match"] + NODES)(lambda s: nodes(s, "exact_match").drop("tooltip"))
query("sum_03_graph_edges", "activation", WALK + MARKED["exact_match"] + EDGES)(lambda s: edges(s, "exact_match"))
query("sum_04_graph_nodes", "activation", WALK + MARKED["namespace_match"] + NODES)(lambda s: nodes(s, "namespace_match").drop("tooltip"))
query("sum_04_graph_edges", "activation", WALK + MARKED["namespace_match"] + EDGES)(lambda s: edges(s, "namespace_match"))
query(
    "sum_06_merged_calls",
    "activation",
    WALK + MARKED["namespace_match"] + "SELECT trial_id, node, count(*) AS calls, sum(duration)::BIGINT AS duration, string_agg('T' || trial_id || ' - ' || id || '<br>Line ' || line || '<br>', '' ORDER BY route) AS tooltip FROM marked GROUP BY 1, 2",
)(lambda s: nodes(s, "namespace_match").select("trial_id", "node", "calls", "duration", "tooltip"))


def parents(s: Store) -> DataFrame:
    """Each trial with its parent, as two trees to compare."""
    return s.trial.where("parent_id is not null").select(F.col("id").alias("tree_id"), F.col("parent_id").alias("other_id"))


def mapping(s: Store) -> tuple[DataFrame, DataFrame]:
    tree = calls(s, ("name",))
    return tree, td.tree_mapping(tree, parents(s))


def merged_trials(s: Store) -> DataFrame:
    tree, found = mapping(s)
    took = lambda i, name: s.activation.select(F.col("id").alias(i), (F.col("finish_checkpoint") - F.col("start_checkpoint")).alias(name))
    return td.merged_tree(tree, found).join(took("id", "duration"), "id", "left").join(took("other", "other_duration"), "other", "left").withColumnRenamed("tree_id", "trial_id")


def merged_trial_edges(s: Store) -> DataFrame:
    tree, found = mapping(s)
    return td.merged_tree_edges(found, tr.merged_edges(tr.merged(tree, "no_match"))).withColumnRenamed("tree_id", "trial_id")


# an edit script is beyond SQL; the tests hold costs and mappings against brute force
query("dif_07_tree_distances", "activation trial", None)(lambda s: td.tree_distances(mapping(s)[1]).withColumnRenamed("tree_id", "trial_id"))
query("dif_07_mapping", "activation trial", None)(lambda s: mapping(s)[1].withColumnRenamed("tree_id", "trial_id"))
query("dif_08_merged_tree", "activation trial", None)(merged_trials)
query("dif_08_merged_edges", "activation trial", None)(merged_trial_edges)
