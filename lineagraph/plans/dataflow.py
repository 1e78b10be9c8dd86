"""Registered queries of whole lineage walks, dataflow graphs, bundles and the rest of the summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.operators import alignment as al
from lineagraph.operators import dataflow as df
from lineagraph.operators import evaluations as ev
from lineagraph.operators import lineage as li
from lineagraph.operators import lookups as lo
from lineagraph.operators import summaries as su
from lineagraph.plans.queries import DEP, LCS, _up, query
from lineagraph.sources import store as st
from lineagraph.sources.store import Store

#: The last evaluation of an activation is a collection of the evaluations flagged R, by their values.
PARTS = ", parts AS (SELECT m.id AS collection_id, e.repr AS key, e.id AS member_id, e.checkpoint FROM evaluation e JOIN (SELECT activation_id, max(id) AS id FROM evaluation GROUP BY 1) m USING (activation_id) WHERE e.flag = 'R' AND e.id <> m.id) "
#: The first evaluation of an activation stands for its call.
OWN = ", own AS (SELECT activation_id, min(id) AS id FROM evaluation GROUP BY 1) "
#: An evaluation made the calls of the activations that its own activation called.
CALLED = ", called AS (SELECT e.id, o.id AS call_id FROM evaluation e JOIN activation a ON a.caller_id = e.activation_id JOIN own o ON o.activation_id = a.id WHERE e.flag = 'A') "
WALK = (
    ", v AS (SELECT *, lead(checkpoint) OVER (PARTITION BY collection_id, key ORDER BY checkpoint, member_id) AS until FROM parts), own_at AS (SELECT id, checkpoint FROM evaluation), "
    "walk AS (SELECT id AS src, id AS node, checkpoint AS at, false AS is_call FROM evaluation UNION (SELECT w.src, d.dependency_id, o.checkpoint, false FROM walk w JOIN dep d ON d.dependent_id = w.node AND d.type <> 'argument' JOIN own_at o ON o.id = d.dependency_id WHERE NOT w.is_call "
    "UNION ALL SELECT w.src, c.call_id, o.checkpoint, true FROM walk w JOIN called c ON c.id = w.node JOIN own_at o ON o.id = c.call_id WHERE NOT w.is_call "
    "UNION ALL SELECT w.src, v.member_id, w.at, false FROM walk w JOIN v ON v.collection_id = w.node AND v.checkpoint <= w.at AND (v.until IS NULL OR w.at < v.until) WHERE NOT w.is_call)) "
)


def parts(s: Store) -> DataFrame:
    last = s.evaluation.groupBy("activation_id").agg(F.max("id").alias("collection_id"))
    return s.evaluation.where("flag = 'R'").join(last, "activation_id").where("id <> collection_id").select("collection_id", F.col("repr").alias("key"), F.col("id").alias("member_id"), "checkpoint")


def own(s: Store) -> DataFrame:
    return s.evaluation.groupBy("activation_id").agg(F.min("id").alias("id"))


def called(s: Store) -> DataFrame:
    calls = s.activation.where("caller_id is not null").select(F.col("caller_id").alias("activation_id"), F.col("id").alias("inner")).join(own(s).select(F.col("activation_id").alias("inner"), F.col("id").alias("call_id")), "inner")
    return s.evaluation.where("flag = 'A'").select("id", "activation_id").join(calls, "activation_id").select("id", "call_id")


def seeds(s: Store) -> DataFrame:
    return s.evaluation.select(F.col("id").alias("src"), F.col("id").alias("node"))


# --- lineage ---
query("lin_01_navigate", "evaluation dependency activation", DEP + PARTS + OWN + CALLED + WALK + 'SELECT src, node, "at", is_call FROM walk')(lambda s: li.navigate(s.evaluation, s.dependency, seeds(s), parts(s), called(s), arguments=False))


def wanted_sources(s: Store) -> DataFrame:
    """(id, target_id): each evaluation with the first one of its activation and the one before it."""
    first = s.evaluation.join(own(s).withColumnRenamed("id", "first"), "activation_id")
    return first.select("id", F.explode(F.array("first", F.greatest("first", F.col("id") - 1))).alias("target_id")).distinct()


query(
    "lin_03_derived_from_all",
    "evaluation dependency",
    DEP + OWN + ", wanted AS (SELECT e.id, o.id AS node FROM evaluation e JOIN own o USING (activation_id) UNION SELECT e.id, greatest(o.id, e.id - 1) FROM evaluation e JOIN own o USING (activation_id)), "
    "walk AS (SELECT id AS src, id AS node FROM evaluation UNION SELECT w.src, d.dependency_id FROM walk w JOIN dep d ON d.dependent_id = w.node) SELECT wanted.id, bool_and(walk.src IS NOT NULL) AS derived FROM wanted LEFT JOIN walk ON walk.src = wanted.id AND walk.node = wanted.node AND walk.node <> walk.src GROUP BY 1",
)(lambda s: li.derived_from_all(s.dependency, wanted_sources(s)))
query(
    "lin_06_marked_edges",
    "evaluation dependency",
    DEP + ", walk AS (SELECT id AS node FROM evaluation WHERE flag = 'R' UNION SELECT d.dependency_id FROM walk w JOIN dep d ON d.dependent_id = w.node) SELECT dependent_id AS source_id, dependency_id AS target_id, type, dependent_id IN (SELECT node FROM walk) AS visited FROM dep",
)(lambda s: li.marked_edges(s.dependency, li.derivation(s.dependency, s.evaluation.where("flag = 'R'"))))
query(
    "lin_08_contributing_cells",
    "evaluation dependency code_component",
    DEP + _up("code_component", "id", "container_id") + ", cell AS (SELECT u.node AS id, arg_min(u.ancestor, u.depth) AS cell_id FROM up u JOIN code_component c ON c.id = u.ancestor AND c.type = 'PROMO' GROUP BY 1), "
    "inside AS (SELECT e.trial_id, e.id, cell_id FROM evaluation e JOIN cell ON cell.id = e.code_component_id), "
    "walk AS (SELECT trial_id, 'value' AS kind, max(id)::BIGINT AS node FROM evaluation GROUP BY 1 UNION (SELECT w.trial_id, 'value', d.dependency_id FROM walk w JOIN dep d ON d.dependent_id = w.node WHERE w.kind = 'value' "
    "UNION ALL SELECT w.trial_id, 'cell', i.cell_id FROM walk w JOIN inside i ON i.id = w.node WHERE w.kind = 'value' UNION ALL SELECT w.trial_id, 'value', i.id FROM walk w JOIN inside i ON i.cell_id = w.node AND i.trial_id = w.trial_id WHERE w.kind = 'cell')) "
    "SELECT trial_id, node AS cell_id FROM walk WHERE kind = 'cell'",
)(lambda s: li.contributing_cells(s.evaluation, s.dependency, s.code_component, s.evaluation.groupBy("trial_id").agg(F.max("id").alias("id")), "PROMO"))

# --- dataflow graphs ---
LEVEL = _up("activation", "id", "caller_id") + ", level AS (SELECT node AS id, max(depth) + 1 AS level FROM up GROUP BY 1) "
NODES = ", shown AS (SELECT a.trial_id, a.id, a.caller_id AS cluster_id, CASE WHEN a.caller_id IS NULL OR (a.id IN (SELECT id FROM filled) AND level <= 3) THEN 'cluster' ELSE 'leaf' END AS shape FROM activation a JOIN level USING (id) WHERE level <= 2 OR level - 1 <= 3) "
CALLS = LEVEL + ", filled AS (SELECT caller_id AS id FROM activation WHERE caller_id IS NOT NULL) " + NODES
COARSE = (
    CALLS + DEP + OWN + ", called AS (SELECT s.trial_id, o.id, s.cluster_id FROM shown s JOIN own o ON o.activation_id = s.id WHERE s.cluster_id IS NOT NULL), "
    "near AS (SELECT d.dependency_id AS id FROM dep d JOIN called c ON c.id = d.dependent_id UNION SELECT d.dependent_id FROM dep d JOIN called c ON c.id = d.dependency_id), "
    "coarse AS (SELECT trial_id, id, cluster_id FROM called UNION ALL SELECT s.trial_id, e.id, e.activation_id FROM near JOIN evaluation e USING (id) JOIN shown s ON s.id = e.activation_id AND s.shape = 'cluster' WHERE e.id NOT IN (SELECT id FROM called)) "
)
query(
    "clu_01_fine_grain",
    "activation evaluation file_access",
    LEVEL + ", filled AS (SELECT caller_id AS id FROM activation WHERE caller_id IS NOT NULL UNION SELECT activation_id FROM evaluation) " + NODES
    + ", near AS (SELECT u.node, arg_min(s.id, u.depth) AS cluster_id, arg_min(s.trial_id, u.depth) AS trial_id FROM up u JOIN shown s ON s.id = u.ancestor AND s.shape = 'cluster' GROUP BY 1) "
    "SELECT trial_id, 'activation' AS kind, id, cluster_id FROM shown UNION ALL SELECT s.trial_id, 'evaluation', e.id, s.id FROM evaluation e JOIN shown s ON s.id = e.activation_id AND s.shape = 'cluster' "
    "UNION ALL SELECT n.trial_id, 'access', f.id, n.cluster_id FROM file_access f JOIN near n ON n.node = f.activation_id",
)(lambda s: df.fine_grain(s.activation, s.evaluation, s.file_access, 3))
query(
    "clu_02_one_cluster",
    "activation evaluation",
    OWN + ", main AS (SELECT trial_id, min(id) AS cluster_id FROM activation WHERE caller_id IS NULL GROUP BY 1) SELECT e.trial_id, e.id, m.cluster_id FROM evaluation e JOIN main m USING (trial_id) WHERE e.id NOT IN (SELECT o.id FROM own o JOIN main ON o.activation_id = main.cluster_id)",
)(lambda s: df.one_cluster(s.activation, s.evaluation, own(s)))
query("clu_03_calls", "activation", CALLS + "SELECT * FROM shown")(lambda s: df.calls_only(s.activation, 3))
query("clu_04_coarse_grain", "activation evaluation dependency", COARSE + "SELECT * FROM coarse")(lambda s: df.coarse_grain(s.activation, s.evaluation, s.dependency, own(s), 3))
query(
    "clu_05_loopless",
    "activation evaluation dependency",
    COARSE + "SELECT c.trial_id, min(c.id) AS id, arg_min(c.cluster_id, c.id) AS cluster_id FROM coarse c JOIN evaluation e ON e.id = c.id GROUP BY c.trial_id, e.code_component_id",
)(lambda s: df.loopless(df.coarse_grain(s.activation, s.evaluation, s.dependency, own(s), 3, ("code_component_id",)), s.evaluation))
query(
    "clu_09_bridged",
    "evaluation dependency",
    DEP + ", hid AS (SELECT id FROM evaluation WHERE checkpoint % 3 = 0), ahead AS (SELECT dependent_id AS source, dependent_id AS node FROM dep WHERE dependent_id NOT IN (SELECT id FROM hid) UNION SELECT a.source, d.dependency_id FROM ahead a JOIN dep d ON d.dependent_id = a.node WHERE d.dependency_id IN (SELECT id FROM hid)), "
    "behind AS (SELECT dependency_id AS target, dependency_id AS node FROM dep WHERE dependency_id NOT IN (SELECT id FROM hid) UNION SELECT b.target, d.dependent_id FROM behind b JOIN dep d ON d.dependency_id = b.node WHERE d.dependent_id IN (SELECT id FROM hid)) "
    "SELECT source, target, string_agg(DISTINCT d.type, ',' ORDER BY d.type) AS types, bool_or(d.dependent_id <> source OR d.dependency_id <> target) AS propagated FROM ahead a JOIN dep d ON d.dependent_id = a.node JOIN behind b ON b.node = d.dependency_id GROUP BY 1, 2",
)(lambda s: df.bridged(s.dependency, s.evaluation.where("checkpoint % 3 = 0")))
query(
    "clu_20_members",
    "evaluation",
    PARTS + ", above AS (SELECT id FROM evaluation WHERE flag = 'N' UNION SELECT p.collection_id FROM above a JOIN parts p ON p.member_id = a.id), below AS (SELECT id FROM above UNION SELECT p.member_id FROM below b JOIN parts p ON p.collection_id = b.id) SELECT id, id NOT IN (SELECT id FROM above) AS is_type FROM below",
)(lambda s: df.with_members(s.evaluation.where("flag = 'N'"), parts(s)))
query(
    "clu_21_joined_attributes",
    "code_component evaluation",
    ", e AS (SELECT code_component_id AS id, min(repr) AS repr FROM evaluation GROUP BY 1) SELECT coalesce(c.id, e.id) AS id, coalesce(c.type, 'value') AS type, e.repr FROM code_component c FULL JOIN e ON e.id = c.id",
)(
    lambda s: df.joined_attributes(
        s.code_component.select("id", F.create_map(F.lit("type"), "type").alias("attributes")),
        s.evaluation.groupBy(F.col("code_component_id").alias("id")).agg(F.create_map(F.lit("type"), F.lit("value"), F.lit("repr"), F.min("repr")).alias("attributes")),
        "id",
    ).select("id", F.col("attributes")["type"].alias("type"), F.col("attributes")["repr"].alias("repr"))
)

# --- summaries, differences and history ---
query(
    "sum_05_definition_tree",
    "code_component",
    _up("code_component", "id", "container_id") + "SELECT c.id, n.parent_id FROM code_component c LEFT JOIN (SELECT u.node, arg_min(u.ancestor, u.depth) AS parent_id FROM up u JOIN code_component a ON a.id = u.ancestor AND a.type <> 'MEDIUM' WHERE u.depth > 0 GROUP BY 1) n ON n.node = c.id WHERE c.type <> 'MEDIUM'",
)(lambda s: su.definition_tree(s.code_component, ["MEDIUM"]))
REPORT = ", report AS (SELECT a.id, a.line::VARCHAR AS line, (finish_checkpoint - start_checkpoint)::VARCHAR AS duration, coalesce(n, 0)::VARCHAR AS evaluations, last_value FROM activation a LEFT JOIN (SELECT activation_id, count(*) AS n, arg_max(repr, id) AS last_value FROM evaluation GROUP BY 1) e ON e.activation_id = a.id) "
query(
    "dif_05_activations",
    "activation evaluation",
    REPORT + ", pairs AS (SELECT id, lag(id) OVER (PARTITION BY trial_id, name ORDER BY id) AS other_id FROM activation) SELECT p.id, p.other_id, k.attribute, k.before, k.after FROM pairs p JOIN report a ON a.id = p.id JOIN report b ON b.id = p.other_id, "
    "LATERAL (SELECT unnest([{'attribute': 'line', 'before': b.line, 'after': a.line}, {'attribute': 'duration', 'before': b.duration, 'after': a.duration}, {'attribute': 'evaluations', 'before': b.evaluations, 'after': a.evaluations}, {'attribute': 'last_value', 'before': b.last_value, 'after': a.last_value}], recursive := true)) k WHERE k.before IS DISTINCT FROM k.after",
)(
    lambda s: su.diff_activations(
        s.activation.select("id", F.lag("id").over(Window.partitionBy("trial_id", "name").orderBy("id")).alias("other_id")).where("other_id is not null"),
        ev.activation_report(s.activation, s.evaluation).select("id", "line", "duration", "evaluations", "last_value"),
    )
)
CODE = "CASE WHEN role = 'assistant' THEN '=' || trim(text) ELSE notebook_id || ' ' || position END"


def merged_notebooks(s: Store) -> DataFrame:
    """Each notebook merged with the next one as its history; what the assistant says is code."""
    cells = s.cell.select(F.col("notebook_id").alias("id"), "position", "text", "role")
    return al.merged_lists(cells, su.next_notebooks(s.cell), F.col("role") == "assistant")


query("mrg_01_merged", "cell", None)(merged_notebooks)
query(
    "mrg_01_sizes",
    "cell",
    LCS.format(value=CODE) + ", own AS (SELECT notebook_id AS id, count(*) AS n, count(*) FILTER (role = 'assistant') AS code FROM cell GROUP BY 1) "
    "SELECT c.id, o.n - o.code AS only_original, h.n - c.n AS only_history, c.n AS matched FROM common c JOIN own o ON o.id = c.id JOIN own h ON h.id = c.id + 1",
)(lambda s: merged_notebooks(s).groupBy("id").agg(F.count(F.when(F.col("from_history").isNull(), 1)).alias("only_original"), F.count(F.when(F.col("from_original").isNull(), 1)).alias("only_history"), F.count(F.when(F.col("from_original").isNotNull() & F.col("from_history").isNotNull(), 1)).alias("matched")))
query("dif_06_index_maps", "cell", None)(lambda s: al.common_subsequences(s.cell.select(F.col("notebook_id").alias("id"), F.col("position").alias("place"), F.col("role").alias("value")), su.next_notebooks(s.cell)))
query(
    "his_04_group_distances",
    "trial tag",
    _up("trial", "id", "parent_id") + ", g AS (SELECT DISTINCT trial_id, array_to_string(string_split(name, '.')[1:2], '.') AS version FROM tag WHERE type = 'AUTO') SELECT a.version, b.version AS above, min(u.depth) AS distance FROM up u JOIN g a ON a.trial_id = u.node JOIN g b ON b.trial_id = u.ancestor WHERE u.depth > 0 AND a.version <> b.version GROUP BY 1, 2",
)(lambda s: su.history_group_distances(s.trial, s.tag))
query(
    "vtg_04_side_by_side",
    "trial evaluation",
    ", v AS (SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY id) AS place, repr AS value FROM evaluation), p AS (SELECT id AS trial_id, parent_id AS other_id FROM trial WHERE parent_id IS NOT NULL), "
    "a AS (SELECT p.*, place, value FROM p JOIN v USING (trial_id)), b AS (SELECT p.*, place, value FROM p JOIN v ON v.trial_id = p.other_id) "
    "SELECT coalesce(a.trial_id, b.trial_id) AS trial_id, coalesce(a.other_id, b.other_id) AS other_id, coalesce(a.place, b.place) AS place, CASE WHEN a.place IS NULL THEN '<' WHEN b.place IS NULL THEN '>' WHEN a.value IS NOT DISTINCT FROM b.value THEN '=' ELSE '|' END AS mark, b.value AS before, a.value AS after "
    "FROM a FULL JOIN b ON a.trial_id = b.trial_id AND a.other_id = b.other_id AND a.place = b.place",
)(
    lambda s: su.side_by_side_values(
        s.trial.where("parent_id is not null").select(F.col("id").alias("trial_id"), F.col("parent_id").alias("other_id")),
        s.evaluation.select("trial_id", F.row_number().over(Window.partitionBy("trial_id").orderBy("id")).alias("place"), F.col("repr").alias("value")),
    )
)

# --- code ---
query(
    "psp_09_handlers",
    "code_component",
    "SELECT t.id AS try_id, h.id AS handler_id FROM code_component t JOIN code_component h ON t.type = 'PROMO' AND h.type IN ('SMALL', 'LARGE') AND h.first_char_column = t.first_char_column AND h.first_char_line > t.first_char_line AND h.first_char_line <= t.last_char_line",
)(lambda s: lo.handlers(s.code_component, ["PROMO"], ["SMALL", "LARGE"]))
query(
    "psp_10_called_definitions",
    "evaluation code_component activation",
    ", d AS (SELECT min(id) AS id, split_part(name, '-', 2) AS name FROM activation GROUP BY 2) SELECT a.id AS call_id, d.id AS definition_id FROM activation a JOIN d ON d.name <> '' AND contains(a.name, d.name)",
)(lambda s: lo.called_definitions(s.activation.select("id", "name"), s.activation.groupBy(F.split_part("name", F.lit("-"), F.lit(2)).alias("name")).agg(F.min("id").alias("id"))))

# --- bundles and people ---
query(
    "src_10_import_bundle",
    "trial",
    "SELECT id, CASE WHEN status = 'backup' THEN 99 ELSE experiment_id END AS experiment_id, status FROM trial",
)(lambda s: st.import_bundle({"trial": s.trial}, st.bundle({"trial": s.trial.withColumn("trial_id", F.col("id"))}, s.trial.where("status = 'backup'").select(F.col("id").alias("trial_id"))), 99, {"trial": ["id"]})["trial"].select("id", "experiment_id", "status"))
query("col_01_users_of_group", "trial", "SELECT DISTINCT c_custkey AS id, c_name AS name FROM customer WHERE c_nationkey = 3")(
    lambda s: st.users_of_group(s.source("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), s.source("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id")), 3)
)
query("col_02_annotations", "trial", "SELECT doc_id AS id, source AS experiment_id, lang FROM documents WHERE source = (SELECT min(source) FROM documents)")(
    lambda s: st.annotations_of(
        s.source("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("experiment_id"), "lang", F.col("text").alias("annotation")).join(F.broadcast(s.source("documents").agg(F.min("source").alias("experiment_id"))), "experiment_id")
    ).select("id", "experiment_id", "lang")
)
