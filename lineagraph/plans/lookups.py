"""Registered queries of the lookups, rules and dataflow parts in ``operators.lookups``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineagraph.functions.scalars import reads, writes
from lineagraph.operators import evaluations as ev
from lineagraph.operators import lookups as lo
from lineagraph.operators import rules as ru
from lineagraph.operators.closure import ancestors
from lineagraph.plans.queries import DEP, MOMENT, SLICE, _up, query

# --- rows and values ---
query("src_05_point_lookup", "trial", "SELECT id, script, status FROM trial WHERE id = 7")(lambda s: lo.point(s.trial, id=7).select("id", "script", "status"))
query("src_06_record", "trial", "SELECT script || '#' || id AS label, id, coalesce(parent_id, -1) AS parent_id, experiment_id FROM trial")(
    lambda s: lo.as_record(s.trial, ("start", "finish", "command", "script", "status", "inherited_id"), {"label": F.concat("script", F.lit("#"), "id"), "parent_id": F.coalesce("parent_id", F.lit(-1).cast("long"))})
)
query("scl_05_local", "file_access", "SELECT id, coalesce(NOT starts_with(name, '/') OR starts_with(name, '/tmp/file1'), false) AS local FROM file_access")(lambda s: s.file_access.select("id", lo.is_local(F.col("name"), "/tmp/file1").alias("local")))
query("scl_09_moments", "trial evaluation", "SELECT e.id, epoch(t.start)::BIGINT + e.checkpoint AS moment FROM evaluation e JOIN trial t ON e.trial_id = t.id")(lambda s: lo.moments(s.evaluation, s.trial))
query("scl_10_activation_durations", "activation", "SELECT id, (finish_checkpoint - start_checkpoint) * 1000000 AS duration FROM activation")(lambda s: s.activation.select("id", ((F.col("finish_checkpoint") - F.col("start_checkpoint")) * 1000000).cast("long").alias("duration")))
query("scl_16_partial_moments", "file_access", "SELECT id FROM file_access WHERE starts_with(strftime(checkpoint, '%Y-%m-%d %H:%M:%S'), '2024-01-1')")(lambda s: s.file_access.where(lo.matches_moment(F.col("checkpoint"), "2024-01-1")).select("id"))
query("scl_19_member", "code_component", "SELECT id, type FROM code_component WHERE type IN ('PROMO', 'SMALL')")(lambda s: lo.member(s.code_component, "type", ("PROMO", "SMALL")).select("id", "type"))
query("scl_20_once", "activation evaluation", "SELECT id FROM activation WHERE id IN (SELECT activation_id FROM evaluation WHERE flag = 'R')")(lambda s: lo.once(s.activation, s.evaluation.where("flag = 'R'").select(F.col("activation_id").alias("id")), "id").select("id"))

# --- trials, tags and files ---
query("trl_02_last_trial_of_none", "trial", "SELECT id FROM trial WHERE start = (SELECT max(start) FROM trial)")(lambda s: lo.last_trial(s.trial, "NO SUCH SCRIPT").select("id"))
query("trl_05_load_parent", "trial tag", "SELECT coalesce((SELECT max(t.trial_id) FROM tag t JOIN trial r ON r.id = t.trial_id WHERE t.type = 'USER' AND r.script = 'BUILDING'), (SELECT arg_max(id, (start, id)) FROM trial WHERE script = 'BUILDING')) AS id")(
    lambda s: lo.parent_for(s.trial, s.tag.where("type = 'USER'").join(s.trial.select(F.col("id").alias("trial_id"), "script"), "trial_id").select("script", "trial_id"), "BUILDING")
)
query("trl_09_of_experiment", "trial", "SELECT t.id, n_name AS experiment FROM trial t LEFT JOIN nation ON n_nationkey = experiment_id WHERE experiment_id = 3")(
    lambda s: s.trial.where("experiment_id = 3").join(s.source("nation").select(F.col("n_nationkey").alias("experiment_id"), F.col("n_name").alias("experiment")), "experiment_id", "left").select("id", "experiment")
)
query("trl_15_initial_activations", "activation", "SELECT trial_id, min(id) AS id, arg_min(name, id) AS name FROM activation WHERE caller_id IS NULL GROUP BY 1")(lambda s: lo.initial_activations(s.activation))
query(
    "tag_01_automatic_tags",
    "trial tag",
    ", v AS (SELECT r.script, r.command, [x::INT FOR x IN string_split(t.name, '.')] AS v FROM tag t JOIN trial r ON r.id = t.trial_id WHERE t.type = 'AUTO') "
    "SELECT id, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 ELSE 0 END AS level, array_to_string(coalesce(a.v, b.v, c.v, [1, 1, 1]), '.') AS tag "
    "FROM (SELECT id, script, status AS command FROM trial) t LEFT JOIN (SELECT script, status AS command, max(v) AS v FROM (SELECT v.v, r.script, r.status FROM (SELECT t.trial_id, [x::INT FOR x IN string_split(t.name, '.')] AS v FROM tag t WHERE t.type = 'AUTO') v JOIN trial r ON r.id = v.trial_id) GROUP BY 1, 2) a USING (script, command) "
    "LEFT JOIN (SELECT script, max(v) AS v FROM v GROUP BY 1) b USING (script) CROSS JOIN (SELECT max(v) AS v FROM v) c",
)(lambda s: lo.automatic_tags(s.trial.select("id", "script", F.col("status").alias("command")), s.tag))
query(
    "rst_01_files_at",
    "file_access",
    ", p AS (SELECT *, row_number() OVER (PARTITION BY trial_id, name ORDER BY checkpoint, id) AS place FROM file_access) "
    f"SELECT trial_id, name, coalesce(arg_max(content_hash_after, (checkpoint, id)) FILTER (WHERE checkpoint <= TIMESTAMP '{MOMENT}'), min(content_hash_after) FILTER (WHERE starts_with(content_hash_after, 'ab')), max(content_hash_after) FILTER (WHERE place = 2)) AS hash FROM p GROUP BY 1, 2",
)(lambda s: lo.files_at(s.file_access, F.lit(MOMENT).cast("timestamp"), "ab", 2))
query("fil_01_first_access", "file_access", "SELECT trial_id, arg_min(id, (checkpoint, id)) AS id FROM file_access WHERE name = 'file7.dat' AND starts_with(strftime(checkpoint, '%Y-%m-%d %H:%M:%S'), '2024-01') GROUP BY 1")(lambda s: lo.first_access(s.file_access, "file7.dat", "2024-01"))
query("fil_02_files_of_trials", "file_access trial module", "SELECT trial_id, string_split(name, '/')[-1] AS name FROM file_access WHERE name <> 'nul' UNION SELECT id, script FROM trial UNION SELECT trial_id, name FROM module")(lambda s: lo.files_of_trials(s.file_access, s.trial, s.module))
query("vtg_01_tag_values", "environment_attr", "SELECT trial_id, right(trial_id::VARCHAR, 5) AS short, name, value FROM environment_attr WHERE name = 'purchase'")(lambda s: lo.tag_values(s.environment_attr, "purchase"))
query("vtg_02_tag_plot", "environment_attr", "SELECT trial_id, right(trial_id::VARCHAR, 5) AS short, TRY_CAST(value AS DOUBLE) AS value FROM environment_attr WHERE name = 'click' ORDER BY trial_id DESC, value NULLS FIRST LIMIT 30")(lambda s: lo.tag_plot(s.environment_attr, "click"))
query(
    "vtg_03_parent_differences",
    "trial evaluation",
    ", v AS (SELECT trial_id, code_component_id, arg_max(repr, (checkpoint, id)) AS r FROM evaluation GROUP BY 1, 2) "
    "SELECT a.trial_id, t.parent_id, a.code_component_id, b.r AS before, a.r AS after FROM v a JOIN trial t ON t.id = a.trial_id JOIN v b ON b.trial_id = t.parent_id AND b.code_component_id = a.code_component_id",
)(lambda s: lo.parent_differences(s.trial, s.evaluation))

# --- evaluations, activations and components ---
query("eva_04_names_and_lines", "evaluation code_component", "SELECT e.id, c.name, c.first_char_line AS line FROM evaluation e JOIN code_component c ON c.id = e.code_component_id")(
    lambda s: s.evaluation.select("id", "code_component_id").join(s.code_component.select(F.col("id").alias("code_component_id"), "name", F.col("first_char_line").alias("line")), "code_component_id").select("id", "name", "line")
)
query("act_03_callers", "activation", "SELECT a.id, a.caller_id, c.name AS caller, a.line FROM activation a LEFT JOIN activation c ON c.id = a.caller_id")(lambda s: lo.callers(s.activation))
query(
    "act_04_folded_accesses",
    "activation file_access",
    _up("activation", "id", "caller_id") + ", own AS (SELECT node, max(depth) AS own FROM up GROUP BY 1) SELECT u.ancestor AS activation_id, count(*) AS accesses FROM file_access f JOIN up u ON u.node = f.activation_id JOIN own o ON o.node = u.node WHERE u.depth = greatest(0, o.own - 1) GROUP BY 1",
)(lambda s: lo.folded_accesses(s.activation, s.file_access, 1))
query("cbk_01_block_parts", "code_component", "SELECT container_id, CASE type WHEN 'PROMO' THEN 'globals' WHEN 'SMALL' THEN 'parameters' ELSE 'calls' END AS part, id FROM code_component WHERE type IN ('PROMO', 'SMALL', 'LARGE') AND container_id IS NOT NULL")(
    lambda s: lo.block_parts(s.code_component, {"globals": "PROMO", "parameters": "SMALL", "calls": "LARGE"})
)
query("cbk_04_compositions", "code_component", "SELECT container_id AS whole_id, id AS part_id FROM code_component WHERE type NOT IN ('MEDIUM') AND NOT suffix(type, 'op_pos') AND container_id IS NOT NULL")(lambda s: lo.compositions(s.code_component, ["MEDIUM"]))
query("psp_01_code_order", "code_component", "SELECT id, row_number() OVER (ORDER BY first_char_line, first_char_column, id) AS place FROM code_component WHERE first_char_line <> -1")(lambda s: lo.code_order(s.code_component))
query("psp_02_lines", "code_component", "SELECT id, first_char_line FROM code_component WHERE first_char_line >= 10 AND last_char_line <= 20")(lambda s: lo.codes_in_lines(s.code_component, 10, 20))
query("psp_02_from_line", "code_component", "SELECT id, first_char_line FROM code_component WHERE first_char_line >= 40")(lambda s: lo.codes_in_lines(s.code_component, 40))
query("psp_03_by_type_and_name", "code_component", "SELECT id, type, name FROM code_component WHERE type = 'ECONOMY' AND name = 'red widget'")(lambda s: lo.point(s.code_component, type="ECONOMY", name="red widget").select("id", "type", "name"))
query("ast_01_components", "code_component", "SELECT id, type FROM code_component WHERE type <> 'MEDIUM'")(lambda s: s.code_component.where("type <> 'MEDIUM'").select("id", "type"))
query("ast_02_parts_of_definitions", "code_component", "SELECT id, name, container_id FROM code_component WHERE container_id IN (SELECT id FROM code_component WHERE type IN ('PROMO', 'LARGE'))")(lambda s: lo.parts_of_definitions(s.code_component, ["PROMO", "LARGE"]))

# --- rules and patterns ---
query("rul_01_evaluation_code", "evaluation", "SELECT trial_id, id, code_component_id AS code FROM evaluation")(lambda s: s.evaluation.select("trial_id", "id", F.col("code_component_id").alias("code")))
query("rul_02_code_name", "code_component", "SELECT id, name FROM code_component")(lambda s: s.code_component.select("id", "name"))
query("rul_04_activation_and_access_names", "activation file_access", "SELECT 'activation' AS model, id, name FROM activation UNION ALL SELECT 'access', id, name FROM file_access")(lambda s: ru.names(activation=s.activation, access=s.file_access))
query("rul_09_duration_by_name", "activation", "SELECT id, name, finish_checkpoint - start_checkpoint AS duration FROM activation")(lambda s: lo.with_name(ru.durations(s.activation), s.activation).select("id", "name", "duration"))
query(
    "rul_09_timestamp_by_name",
    "activation",
    "SELECT name, 'start' AS moment, start_checkpoint AS at FROM activation UNION ALL SELECT name, 'finish', finish_checkpoint FROM activation",
)(lambda s: lo.with_name(ru.timestamps(s.activation), s.activation).select("name", "moment", "at"))
SUCC = "SELECT DISTINCT a.name AS before, b.name AS after FROM activation a JOIN activation b ON a.trial_id = b.trial_id AND a.start_checkpoint <= b.finish_checkpoint AND a.id <> b.id"
query("rul_09_successor_by_name", "activation", SUCC)(lambda s: lo.successor_names(ru.successors(s.activation), s.activation))
query("rul_15_is_activation", "activation evaluation", "SELECT id FROM evaluation WHERE id IN (SELECT id FROM activation)")(lambda s: lo.once(s.evaluation, s.activation, "id").select("id"))
query("rul_16_called", "activation", "SELECT a.trial_id, a.caller_id AS caller, a.id AS called FROM activation a JOIN activation c ON c.id = a.caller_id")(
    lambda s: s.activation.join(s.activation.select(F.col("id").alias("caller_id")), "caller_id", "left_semi").select("trial_id", F.col("caller_id").alias("caller"), F.col("id").alias("called"))
)
query("rul_22_accesses", "file_access", "SELECT trial_id, activation_id AS activation, id FROM file_access")(lambda s: s.file_access.select("trial_id", F.col("activation_id").alias("activation"), "id"))
query("rul_25_temporal_influence", "activation", "SELECT a.trial_id, a.id AS influencer, b.id AS influenced FROM activation a JOIN activation b ON a.trial_id = b.trial_id AND a.start_checkpoint <= b.finish_checkpoint AND a.id <> b.id")(
    lambda s: ru.successors(s.activation).select("trial_id", F.col("before").alias("influencer"), F.col("after").alias("influenced"))
)
query(
    "rul_26_access_stacks",
    "activation file_access",
    _up("activation", "id", "caller_id") + ", st AS (SELECT node, string_agg(ancestor::VARCHAR, ',' ORDER BY depth) AS stack FROM up GROUP BY 1) SELECT f.id, st.stack FROM file_access f JOIN st ON st.node = f.activation_id",
)(lambda s: lo.access_stacks(s.activation, s.file_access))
query("rul_32_influence", "evaluation dependency", DEP + ", " + SLICE.format(cond=" AND NOT starts_with(d.type, 'arg')") + "SELECT node AS influencer, src AS influenced FROM walk WHERE node <> src")(
    lambda s: ru.backward_slices(s.dependency, s.evaluation).where("node <> src").select(F.col("node").alias("influencer"), F.col("src").alias("influenced"))
)
query("pat_05_null_query", "trial", "SELECT id FROM trial WHERE false")(lambda s: lo.restricted(lo.rule(lambda t: t), s.trial, "status", []).select("id"))
query("pat_06_rule", "activation", "SELECT id, name FROM activation WHERE finish_checkpoint - start_checkpoint > 50 AND name = '1-URGENT'")(lambda s: lo.rule(lambda a, least: a.where(F.col("finish_checkpoint") - F.col("start_checkpoint") > least).select("id", "name"), least=50)(s.activation, name="1-URGENT"))
query("pat_07_restricted", "trial", "SELECT id, status FROM trial WHERE status IN ('finished', 'backup')")(lambda s: lo.restricted(lo.rule(lambda t: t), s.trial, "status", ["finished", "backup"]).select("id", "status"))
query(
    "pat_09_lifted_names",
    "evaluation code_component",
    "SELECT e.activation_id AS id, string_agg(c.name, ';' ORDER BY e.id) AS names FROM evaluation e JOIN code_component c ON c.id = e.code_component_id GROUP BY 1",
)(
    lambda s: lo.lifted(
        s.evaluation.groupBy(F.col("activation_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "code_component_id"))), lambda x: x["code_component_id"]).alias("keys")),
        s.code_component.select(F.col("id").alias("key"), "name"),
        "key",
        "name",
    ).select("id", F.array_join("values", ";").alias("names"))
)
query("pat_10_lines_of_blocks", "code_component", "SELECT container_id AS id, array_to_string(list_sort(list_distinct(list(line))), ',') AS lines FROM (SELECT container_id, unnest(range(first_char_line, last_char_line + 1)) AS line FROM code_component WHERE container_id IS NOT NULL) GROUP BY 1")(
    lambda s: s.code_component.where("container_id is not null").select(F.col("container_id").alias("id"), F.explode(F.sequence("first_char_line", "last_char_line")).alias("line")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"))
)

# --- dataflow, summaries and differences ---
query("clu_06_node_shapes", "activation evaluation", _up("activation", "id", "caller_id") + "SELECT node AS id, CASE WHEN node NOT IN (SELECT activation_id FROM evaluation) OR max(depth) + 1 > 2 THEN 'leaf' ELSE 'cluster' END AS shape FROM up GROUP BY 1")(lambda s: lo.node_shapes(s.activation, s.evaluation, 2))
EDGES = DEP + ", edge AS (SELECT dependent_id AS source_id, dependency_id AS target_id, type, NULL::VARCHAR AS key FROM dep UNION ALL SELECT collection_id, member_id, 'member', key FROM member) "
query("clu_08_edges", "dependency member", EDGES + "SELECT source_id, target_id, type, coalesce(key, '') AS key FROM edge")(lambda s: lo.graph_edges(s.dependency, s.member).withColumn("key", F.coalesce("key", F.lit(""))))
query("clu_10_shown_edges", "dependency member", EDGES + "SELECT source_id, target_id, type FROM edge WHERE source_id <> target_id AND type <> 'argument' AND source_id <> 101 AND target_id <> 101")(lambda s: lo.shown_edges(lo.graph_edges(s.dependency, s.member), 101).select("source_id", "target_id", "type"))
SAME = DEP + ", src AS (SELECT dependent_id AS id, min(dependency_id) AS s FROM dep WHERE type = 'assignment' GROUP BY 1) "
query("clu_11_same_synonyms", "evaluation dependency", SAME + "SELECT e.id, coalesce(s.s, e.id) AS synonym FROM evaluation e LEFT JOIN src s ON s.id = e.id")(lambda s: lo.synonyms(s.evaluation, ev.assignment_sources(s.dependency).withColumnRenamed("source_id", "synonym")))
ROOT = ", step AS (SELECT dependent_id AS n, min(dependency_id) AS p FROM dep WHERE reference GROUP BY 1), ref AS (SELECT n AS node, p AS a, 1 AS depth FROM step UNION ALL SELECT u.node, s.p, u.depth + 1 FROM ref u JOIN step s ON s.n = u.a), root AS (SELECT node AS id, arg_max(a, depth) AS s FROM ref GROUP BY node) "
query("clu_12_reference_synonyms", "evaluation dependency", DEP + ROOT + "SELECT e.id, coalesce(r.s, e.id) AS synonym FROM evaluation e LEFT JOIN root r ON r.id = e.id")(lambda s: lo.synonyms(s.evaluation, ev.reference_roots(s.dependency).select(F.col("node").alias("id"), F.col("root").alias("synonym"))))
query("clu_14_joined_synonyms", "evaluation dependency", SAME + ROOT + "SELECT e.id, coalesce(s.s, r.s, e.id) AS synonym FROM evaluation e LEFT JOIN src s ON s.id = e.id LEFT JOIN root r ON r.id = e.id")(
    lambda s: lo.synonyms(s.evaluation, ev.assignment_sources(s.dependency).withColumnRenamed("source_id", "synonym"), ev.reference_roots(s.dependency).select(F.col("node").alias("id"), F.col("root").alias("synonym")))
)
query("clu_15_visible_nodes", "code_component", "SELECT id FROM code_component WHERE NOT starts_with(name, 'small') AND type <> 'PROMO'")(lambda s: lo.visible(s.code_component, ~F.col("name").startswith("small"), F.col("type") != "PROMO").select("id"))
query("clu_16_node_names", "evaluation code_component activation", ", f AS (SELECT activation_id, min(id) AS id FROM evaluation GROUP BY 1) SELECT e.id, coalesce(a.name, c.name) AS name FROM evaluation e JOIN code_component c ON c.id = e.code_component_id LEFT JOIN f ON f.id = e.id LEFT JOIN activation a ON a.id = f.activation_id")(
    lambda s: lo.node_names(s.evaluation, s.code_component, s.activation)
)
query("clu_17_joined_filter", "file_access", "SELECT id FROM file_access WHERE NOT starts_with(name, '/') AND regexp_matches(mode, '[r+]') AND regexp_matches(mode, '[wxa+]')")(lambda s: lo.visible(s.file_access, lo.is_local(F.col("name"), "/none"), reads(F.col("mode")), writes(F.col("mode"))).select("id"))
query(
    "dif_04_side_by_side",
    "module environment_attr",
    ", m AS (SELECT trial_id AS key, name AS module, row_number() OVER (PARTITION BY trial_id ORDER BY name) AS place FROM (SELECT DISTINCT trial_id, name FROM module)), "
    "e AS (SELECT trial_id AS key, name AS variable, row_number() OVER (PARTITION BY trial_id ORDER BY name) AS place FROM (SELECT DISTINCT trial_id, name FROM environment_attr)) "
    "SELECT coalesce(m.key, e.key) AS key, coalesce(m.place, e.place) AS place, module, variable FROM m FULL JOIN e ON m.key = e.key AND m.place = e.place",
)(lambda s: lo.side_by_side(module=s.module.select(F.col("trial_id").alias("key"), F.col("name").alias("value")).distinct(), variable=s.environment_attr.select(F.col("trial_id").alias("key"), F.col("name").alias("value")).distinct()))
query("his_03_filtered_nodes", "trial tag", "SELECT id, script, coalesce(g.tag, '') AS tag FROM trial LEFT JOIN (SELECT trial_id, max(name) AS tag FROM tag GROUP BY 1) g ON g.trial_id = id WHERE status = 'finished' AND script LIKE '%URNI%'")(lambda s: lo.history_nodes(s.trial, s.tag, "finished", "*URNI*"))
query("his_06_enriched_nodes", "trial tag", "SELECT id, script, coalesce(g.tag, '') AS tag FROM trial LEFT JOIN (SELECT trial_id, max(name) AS tag FROM tag GROUP BY 1) g ON g.trial_id = id")(lambda s: lo.history_nodes(s.trial, s.tag, "*", "*"))
query("his_02_depths", "trial", _up("trial", "id", "parent_id") + "SELECT node AS id, max(depth) AS depth FROM up GROUP BY 1")(lambda s: ancestors(s.trial, "id", "parent_id").groupBy(F.col("node").alias("id")).agg(F.max("depth").alias("depth")))
