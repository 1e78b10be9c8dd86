"""Registered queries of dataflow graphs written as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagraph.functions.scalars import reads, writes
from lineagraph.operators import dataflow as df
from lineagraph.operators import exports as ex
from lineagraph.plans.dataflow import LEVEL, NODES, PARTS, parts
from lineagraph.plans.queries import DEP, query
from lineagraph.sources.store import Store

#: The shown nodes in their clusters with what is written of them, and the walk of their trees: routes are in pre-order when sorted.
GRAPH = (
    LEVEL + ", filled AS (SELECT caller_id AS id FROM activation WHERE caller_id IS NOT NULL UNION SELECT activation_id FROM evaluation) " + NODES
    + ", near AS (SELECT u.node, arg_min(s.id, u.depth) AS cluster_id, arg_min(s.trial_id, u.depth) AS trial_id FROM up u JOIN shown s ON s.id = u.ancestor AND s.shape = 'cluster' GROUP BY 1) "
    ", part AS (SELECT trial_id, 1 AS rank, 'c_' AS letter, id, cluster_id, shape = 'cluster' AS is_cluster, name, NULL AS value, line::BIGINT AS line, start_checkpoint::VARCHAR AS checkpoint FROM shown JOIN (SELECT id, name, line, start_checkpoint FROM activation) USING (id) "
    "UNION ALL SELECT s.trial_id, 0, 'e_', e.id, s.id, false, c.name, e.repr, c.first_char_line, e.checkpoint::VARCHAR FROM evaluation e JOIN shown s ON s.id = e.activation_id AND s.shape = 'cluster' LEFT JOIN code_component c ON c.id = e.code_component_id "
    "UNION ALL SELECT n.trial_id, 2, 'a_', f.id, n.cluster_id, false, f.name, NULL, NULL, NULL FROM file_access f JOIN near n ON n.node = f.activation_id) "
    ", placed AS (SELECT *, letter || id AS node, 'c_' || cluster_id AS parent, lpad((row_number() OVER (PARTITION BY trial_id, cluster_id ORDER BY rank, id))::VARCHAR, 9, '0') AS step FROM part) "
    ", tree AS (SELECT *, step AS route, 0 AS depth FROM placed WHERE parent IS NULL UNION ALL SELECT p.*, t.route || '.' || p.step, t.depth + 1 FROM placed p JOIN tree t ON t.trial_id = p.trial_id AND t.node = p.parent) "
)


def _label(text: str) -> str:
    return f"coalesce(replace(CASE WHEN length({text}) > 55 THEN left({text}, 25) || ' ... ' || right({text}, 25) ELSE {text} END, '\"', '\\\"'), '')"


_VALUE = f"CASE WHEN {_label('value')} = '' THEN '' ELSE ' =\\n' || {_label('value')} END"
_DRAWN = "node || ' [label=\"' || coalesce(line, 0) || ' ' || {name} || " + _VALUE + " || '\" {style}];'"
_LEAF = f"CASE letter WHEN 'e_' THEN {_DRAWN.format(name=_label('name'), style=ex.VALUE_STYLE)} WHEN 'a_' THEN node || ' [label=\"' || {_label('name')} || '\" {ex.ACCESS_STYLE}];' ELSE {_DRAWN.format(name=_label('name'), style=ex.CALL_STYLE)} END"
DOT = (
    ", opening AS (SELECT trial_id, route, depth, unnest(CASE WHEN is_cluster AND parent IS NULL THEN ['digraph cluster_' || id || ' {', '    rankdir=RL;', '    node[fontsize=20]'] "
    f"WHEN is_cluster THEN ['subgraph cluster_' || id || ' {{', '    color=\"#3A85B9\";', '    fontsize=30;', '    label = \"' || {_label('name')} || '\";', '    ' || {_DRAWN.format(name=chr(39) + 'return' + chr(39), style=ex.CALL_STYLE)}] ELSE [{_LEAF}] END) AS text, "
    "unnest(range(CASE WHEN is_cluster AND parent IS NULL THEN 3 WHEN is_cluster THEN 5 ELSE 1 END)) AS i FROM tree) "
    ", ranked AS (SELECT trial_id, parent AS node, line, '    {rank=same ' || string_agg(node, ' ' ORDER BY id) || '}' AS text FROM tree WHERE letter = 'e_' GROUP BY 1, 2, 3) "
    ", shut AS (SELECT t.trial_id, t.route, t.depth, r.text, coalesce(r.line, -1) AS i FROM tree t JOIN ranked r ON r.trial_id = t.trial_id AND r.node = t.node UNION ALL SELECT trial_id, route, depth, '}', 1000000000 FROM tree WHERE is_cluster AND parent IS NOT NULL) "
    ", link AS (SELECT e.trial_id, 'e_' || d.dependent_id AS source, 'e_' || d.dependency_id AS target, CASE WHEN d.reference THEN '[arrowhead=\"empty\"]' ELSE '' END AS style FROM dep d JOIN evaluation e ON e.id = d.dependent_id "
    "UNION ALL SELECT n.trial_id, 'c_' || n.cluster_id, 'a_' || f.id, '[style=\"dashed\"]' FROM file_access f JOIN near n ON n.node = f.activation_id WHERE regexp_matches(f.mode, '[r+]') "
    "UNION ALL SELECT n.trial_id, 'a_' || f.id, 'c_' || n.cluster_id, '[style=\"dashed\"]' FROM file_access f JOIN near n ON n.node = f.activation_id WHERE regexp_matches(f.mode, '[wxa+]')) "
    ", line AS (SELECT trial_id, 0 AS part, route || ' ' AS key, i, '' AS k, repeat('    ', depth) || text AS text FROM opening UNION ALL SELECT trial_id, 0, route || '~', i, '', repeat('    ', depth) || text FROM shut "
    "UNION ALL SELECT l.trial_id, 1, l.source, 0, l.target, '    ' || l.source || ' -> ' || l.target || ' ' || l.style || ';' FROM link l WHERE EXISTS (SELECT 1 FROM tree t WHERE t.trial_id = l.trial_id AND t.node = l.source) AND EXISTS (SELECT 1 FROM tree t WHERE t.trial_id = l.trial_id AND t.node = l.target) "
    "UNION ALL SELECT DISTINCT trial_id, 2, '', 0, '', '}' FROM tree WHERE parent IS NULL) "
    "SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY part, key, i, k, text) - 1 AS line_no, text FROM line"
)


def shown(s: Store) -> DataFrame:
    """The fine-grained graph of each trial, three levels of calls deep."""
    return df.fine_grain(s.activation, s.evaluation, s.file_access, 3)


def nodes(s: Store) -> DataFrame:
    """The nodes of the graph with what is written of them."""
    no = lambda t: F.lit(None).cast(t)
    of_call = s.activation.select(F.lit("activation").alias("kind"), "id", "name", no("string").alias("value"), F.col("line").cast("long").alias("line"), F.col("start_checkpoint").cast("string").alias("checkpoint"))
    of_value = s.evaluation.join(s.code_component.select(F.col("id").alias("code_component_id"), "name", F.col("first_char_line").cast("long").alias("line")), "code_component_id", "left")
    of_value = of_value.select(F.lit("evaluation").alias("kind"), "id", "name", F.col("repr").alias("value"), "line", F.col("checkpoint").cast("string").alias("checkpoint"))
    of_file = s.file_access.select(F.lit("access").alias("kind"), "id", "name", no("string").alias("value"), no("long").alias("line"), no("string").alias("checkpoint"))
    return ex.graph_nodes(shown(s), of_call.unionByName(of_value).unionByName(of_file))


def edges(s: Store, shown: DataFrame) -> DataFrame:
    """(trial_id, source, target, type, checkpoint, reference): dependencies, and accesses with the cluster that they are in."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    of = s.evaluation.select(F.col("id").alias("dependent_id"), F.col("checkpoint").cast("string").alias("checkpoint"))
    own = s.dependency.join(of, "dependent_id").select("trial_id", named("e_", "dependent_id").alias("source"), named("e_", "dependency_id").alias("target"), "type", "checkpoint", "reference")
    file = s.file_access.select("id", "mode", F.col("checkpoint").cast("string").alias("checkpoint")).join(shown.where("kind = 'access'").select("trial_id", "id", "node", "parent"), "id")
    rest = (F.lit("access").alias("type"), "checkpoint", F.lit(False).alias("reference"))
    read = file.where(reads(F.col("mode"))).select("trial_id", F.col("parent").alias("source"), F.col("node").alias("target"), *rest)
    written = file.where(writes(F.col("mode"))).select("trial_id", F.col("node").alias("source"), F.col("parent").alias("target"), *rest)
    return own.unionByName(read).unionByName(written)


def dot(s: Store) -> DataFrame:
    drawn = nodes(s)
    style = F.when(F.col("type") == "access", '[style="dashed"]').when(F.col("reference"), '[arrowhead="empty"]').otherwise("")
    return ex.dot_document(drawn, edges(s, drawn).select("trial_id", "source", "target", style.alias("style")))


def members(s: Store) -> DataFrame:
    named = lambda c: F.concat(F.lit("e_"), F.col(c).cast("string"))
    at = s.evaluation.select(F.col("id").alias("collection_id"), "trial_id")
    return parts(s).join(at, "collection_id").select("trial_id", named("collection_id").alias("collection"), "key", named("member_id").alias("member"), F.col("checkpoint").cast("string").alias("checkpoint"))


def prov(s: Store) -> DataFrame:
    drawn = nodes(s)
    return ex.prov_document(drawn, edges(s, drawn), members(s))


_LINE = "coalesce(line::VARCHAR, '0')"
_ENTITY = f"'entity(' || node || ', [value=\"' || {_label('value')} || '\", type=\"script:eval\", script:line=\"' || {_LINE} || '\", label=\"' || CASE WHEN is_cluster THEN 'return' ELSE {_label('name')} END || '\"])'"
_CALL = f"'activity(call_' || id || ', [type=\"script:call\", label=\"' || {_label('name')} || '\"])', 'wasGeneratedBy(g_' || node || '; ' || node || ', call_' || id || ', -,[version:checkpoint=\"' || coalesce(checkpoint, '') || '\"])'"
_ACT = "CASE WHEN starts_with(source, 'c_') THEN 'call_' || substr(source, 3) ELSE type || '_' || source END"
_GEN = "CASE WHEN starts_with(source, 'c_') THEN 'g_' || source ELSE 'g_' || type || '_' || source END"
_USE = "'u_' || type || '_' || source || '_' || target"
_AT = "'version:checkpoint=\"' || coalesce(checkpoint, '') || '\"'"
PROV = (
    f", opening AS (SELECT trial_id, route, unnest(CASE WHEN is_cluster AND parent IS NULL THEN ['{ex.PREFIXES[0]}', '{ex.PREFIXES[1]}'] WHEN letter = 'c_' THEN [{_ENTITY}, {_CALL}] "
    f"WHEN letter = 'a_' THEN ['entity(' || node || ', [type=\"script:access\", label=\"' || {_label('name')} || '\"])'] ELSE [{_ENTITY}] END) AS text, unnest(range(CASE WHEN is_cluster AND parent IS NULL THEN 2 WHEN letter = 'c_' THEN 3 ELSE 1 END)) AS i FROM tree) "
    ", link AS (SELECT e.trial_id, 'e_' || d.dependent_id AS source, 'e_' || d.dependency_id AS target, d.type, e.checkpoint::VARCHAR AS checkpoint, d.reference FROM dep d JOIN evaluation e ON e.id = d.dependent_id "
    "UNION ALL SELECT n.trial_id, 'c_' || n.cluster_id, 'a_' || f.id, 'access', f.checkpoint::VARCHAR, false FROM file_access f JOIN near n ON n.node = f.activation_id WHERE regexp_matches(f.mode, '[r+]') "
    "UNION ALL SELECT n.trial_id, 'a_' || f.id, 'c_' || n.cluster_id, 'access', f.checkpoint::VARCHAR, false FROM file_access f JOIN near n ON n.node = f.activation_id WHERE regexp_matches(f.mode, '[wxa+]')) "
    ", inner_node AS (SELECT trial_id, node FROM tree WHERE parent IS NOT NULL) "
    ", kept AS (SELECT l.* FROM link l JOIN inner_node a ON a.trial_id = l.trial_id AND a.node = l.source JOIN inner_node b ON b.trial_id = l.trial_id AND b.node = l.target) "
    ", head AS (SELECT trial_id, source, type, max(checkpoint) AS checkpoint FROM kept WHERE NOT starts_with(source, 'c_') GROUP BY 1, 2, 3) "
    ", line AS (SELECT trial_id, 0 AS part, route AS k1, '' AS k2, '' AS k3, i AS k4, text FROM opening "
    f"UNION ALL SELECT trial_id, 1, source, type, '', 0, 'activity(' || {_ACT} || ', [type=\"script:operation\"])' FROM head "
    f"UNION ALL SELECT trial_id, 1, source, type, '', 1, 'wasGeneratedBy(' || {_GEN} || '; ' || source || ', ' || {_ACT} || ', -,[' || {_AT} || '])' FROM head "
    f"UNION ALL SELECT trial_id, 1, source, type, target, 2, 'used(' || {_USE} || '; ' || {_ACT} || ', ' || target || ', -,[' || {_AT} || '])' FROM kept "
    f"UNION ALL SELECT trial_id, 1, source, type, target, 3, 'wasDerivedFrom(' || source || ', ' || target || ', ' || {_ACT} || ', ' || {_GEN} || ', ' || {_USE} || ', [' || {_AT} || CASE WHEN reference THEN ', type=\"version:Reference\"' ELSE '' END || '])' FROM kept "
    "UNION ALL SELECT e.trial_id, 2, 'e_' || p.collection_id, p.key, 'e_' || p.member_id, 4, 'hadMember(e_' || p.collection_id || ', e_' || p.member_id || ', [type=\"version:Put\", version:key=\"' || p.key || '\", version:checkpoint=\"' || p.checkpoint || '\"])' "
    "FROM parts p JOIN evaluation e ON e.id = p.collection_id JOIN inner_node a ON a.trial_id = e.trial_id AND a.node = 'e_' || p.collection_id JOIN inner_node b ON b.trial_id = e.trial_id AND b.node = 'e_' || p.member_id) "
    "SELECT trial_id, row_number() OVER (PARTITION BY trial_id ORDER BY part, k1, k2, k3, k4, text) - 1 AS line_no, text FROM line"
)
TABLES = "activation evaluation file_access code_component dependency"

query("snk_08_prov_document", TABLES, GRAPH + DEP + PARTS + PROV)(prov)
query("snk_09_dot_document", TABLES, GRAPH + DEP + DOT)(dot)
query(
    "snk_10_part_sizes",
    TABLES,
    GRAPH + "SELECT t.trial_id, t.node, (SELECT count(*) FROM tree d WHERE d.trial_id = t.trial_id AND starts_with(d.route, t.route)) AS size FROM tree t WHERE letter = 'c_'",
)(lambda s: ex.cluster_parts(ex.graph_nodes(shown(s))).where("kind = 'activation'").select("trial_id", "node", "size"))
query(
    "snk_10_parts",
    TABLES,
    GRAPH + "SELECT t.trial_id, t.node AS top, d.node FROM tree t JOIN tree d ON d.trial_id = t.trial_id AND starts_with(d.route, t.route) WHERE t.letter = 'c_' AND t.id IN (SELECT id FROM activation WHERE name = '1-URGENT')",
)(lambda s: ex.part_of(ex.graph_nodes(shown(s)), s.activation.where("name = '1-URGENT'")))
