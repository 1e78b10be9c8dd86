"""Registered queries over the provenance tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.functions import scalars as sc
from lineagraph.operators import evaluations as ev
from lineagraph.operators import lineage as li
from lineagraph.operators import rules as ru
from lineagraph.operators import summaries as su
from lineagraph.operators import trials as tr
from lineagraph.sources import store as st
from lineagraph.sources.store import Store, duck_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MOMENT = "2024-01-15 12:00:00"
#: Paths from each node of a forest to all above it, itself at depth 0.
UP = "up AS (SELECT {n} AS node, {n} AS ancestor, {p} AS next, 0 AS depth FROM {t} UNION ALL SELECT u.node, x.{n}, x.{p}, u.depth + 1 FROM up u JOIN {t} x ON x.{n} = u.next) "
#: A dependency table without the first evaluation of each activation.
DEP = ", dep AS (SELECT * FROM dependency WHERE dependency_id IS NOT NULL) "
SLICE = "walk AS (SELECT id AS src, id AS node FROM evaluation UNION SELECT w.src, d.dependency_id FROM walk w JOIN dep d ON w.node = d.dependent_id{cond}) "


#: Queries that read the projected tables in many jobs: each of ``PROJECTED`` that they use is computed once.
MANY_READS = {
    "lin_01_navigate", "lin_08_contributing_cells", "snk_08_prov_document", "snk_09_dot_document", "snk_10_part_sizes", "snk_10_parts", "lin_01_through_members",
    "lin_01_derivation", "lin_03_derived_from_all", "lin_03_was_derived_from", "lin_04_derived_pairs", "lin_06_marked_edges", "lin_07_numbered_dependencies", "lin_07_named_dependencies", "lin_09_only_derived",
    "rul_30_slices", "rul_31_slice_lines", "cbk_06_marked_code", "clu_05_loopless", "clu_09_bridged", "clu_09_propagated",
}
PROJECTED = ("evaluation", "activation", "dependency")


def query(name: str, tables: str, sql: str | None):
    """Register a function of a Store; ``sql`` follows a WITH clause of the named tables."""

    def register(build: Callable[[Store], DataFrame]):
        kept = tuple(t for t in PROJECTED if t in tables.split()) if name in MANY_READS else ()
        QUERIES[name] = lambda spark, folder: build(Store(spark, folder, kept))
        if sql is not None:
            ORACLE_SQL[name] = duck_sql(*tables.split()) + sql
        return build

    return register


def _up(table: str, node: str, parent: str) -> str:
    return ", " + UP.format(t=table, n=node, p=parent)


# --- sources and sinks ---
query("src_03_full_scan", "trial", "SELECT id, coalesce(parent_id, -1) AS parent_id, script, status FROM trial")(lambda s: s.trial.select("id", F.coalesce("parent_id", F.lit(-1).cast("long")).alias("parent_id"), "script", "status"))
query("src_04_load_by_trials", "evaluation", "SELECT id, repr FROM evaluation WHERE trial_id IN (1, 2, 3, 5, 8)")(lambda s: s.evaluation.where(F.col("trial_id").isin(1, 2, 3, 5, 8)).select("id", "repr"))
query("src_08_find_subhash", "content", "SELECT min(hash) AS hash FROM content WHERE hash LIKE 'a%'")(lambda s: st.find_subhash(s.content, "a"))
query("src_09_list_all", "content", "SELECT DISTINCT hash FROM content")(lambda s: s.content.select("hash").distinct())
query("src_11_missing_trials", "trial", "SELECT id FROM trial WHERE id NOT IN (SELECT id FROM trial WHERE status = 'finished')")(lambda s: st.missing(s.trial.select("id"), s.trial.where("status = 'finished'")))
query("snk_01_upsert", "trial", "SELECT id, CASE WHEN id % 7 = 0 THEN 'done' ELSE status END AS status FROM trial")(lambda s: st.upsert(s.trial.select("id", "status"), s.trial.where("id % 7 = 0").select("id", F.lit("done").alias("status")), ["id"]))
query("snk_02_content_put", "", "SELECT sha1(text) AS hash, any_value(text) AS value FROM documents WHERE text IS NOT NULL GROUP BY 1".replace("SELECT", "x AS (SELECT 1) SELECT", 1))(lambda s: st.put_content(s.spark.createDataFrame([], "hash string, value string"), s.source("documents").where("text is not null"), "text"))
query("snk_05_bundle", "trial evaluation", "SELECT e.id, e.trial_id FROM evaluation e WHERE e.trial_id IN (SELECT id FROM trial WHERE status = 'backup')")(lambda s: st.bundle({"evaluation": s.evaluation}, s.trial.where("status = 'backup'").select(F.col("id").alias("trial_id")))["evaluation"].select("id", "trial_id"))
query("snk_06_prolog_facts", "trial", "SELECT 'trial(' || id || ', ' || coalesce(CAST(parent_id AS VARCHAR), 'nil') || ', ''' || script || ''', ''' || status || ''').' AS fact FROM trial")(lambda s: su.prolog_facts(s.trial, "trial", ["id", "parent_id", "script", "status"]))
query("snk_07_prov_derivations", "dependency", "SELECT 'wasDerivedFrom(e' || dependent_id || ', e' || dependency_id || ', [type=''' || type || '''])' AS statement FROM dependency WHERE dependency_id IS NOT NULL")(lambda s: su.prov_derivations(s.dependency))

# --- scalars ---
ACC = "FROM file_access"
query("scl_01_read_mode", "file_access", f"SELECT id, regexp_matches(mode, '[r+]') AS reads, regexp_matches(mode, '[wxa+]') AS writes {ACC}")(lambda s: s.file_access.select("id", sc.reads(F.col("mode")).alias("reads"), sc.writes(F.col("mode")).alias("writes")))
query("scl_03_delete_mode", "file_access", f"SELECT id, contains(mode, 'd') AS deletes {ACC}")(lambda s: s.file_access.select("id", sc.deletes(F.col("mode")).alias("deletes")))
query("scl_04_is_internal", "file_access", f"SELECT id, NOT starts_with(name, '/') OR contains(name, '/tmp') AS internal {ACC}")(lambda s: s.file_access.select("id", sc.is_internal(F.col("name"), F.lit("/tmp")).alias("internal")))
query("scl_06_relative_path", "file_access", f"SELECT id, CASE WHEN NOT starts_with(name, '/') THEN name WHEN starts_with(name, '/tmp/') THEN substr(name, 6) END AS path {ACC}")(lambda s: s.file_access.select("id", sc.relative_path(F.col("name"), "/tmp").alias("path")))
query("scl_07_duration", "trial", "SELECT id, coalesce(epoch_us(finish) - epoch_us(start), 0)::BIGINT AS micros FROM trial")(lambda s: tr.durations(s.trial))
query("scl_08_status", "trial", "SELECT id, CASE status WHEN 'finished' THEN '' WHEN 'backup' THEN 'b' ELSE '*' END AS letter FROM trial WHERE script LIKE 'B%'")(lambda s: s.trial.where(sc.like_wildcard(F.col("script"), "B*")).select("id", sc.status_letter(F.col("status")).alias("letter")))
query(
    "scl_11_checkpoint_order",
    "activation evaluation member",
    "SELECT trial_id, checkpoint, dense_rank() OVER (PARTITION BY trial_id ORDER BY checkpoint) AS place FROM (SELECT trial_id, start_checkpoint::BIGINT AS checkpoint FROM activation UNION SELECT trial_id, checkpoint::BIGINT FROM evaluation UNION SELECT collection_id, epoch_us(checkpoint) // 1000000 FROM member)",
)(lambda s: su.checkpoint_order(s.activation.select("trial_id", F.col("start_checkpoint").alias("checkpoint")), s.evaluation, s.member.select(F.col("collection_id").alias("trial_id"), F.unix_timestamp("checkpoint").alias("checkpoint"))))
query("scl_12_brief", "file_access", f"SELECT id, '(' || mode || ') ' || name || CASE WHEN content_hash_before IS NULL THEN ' (new)' ELSE '' END AS brief {ACC}")(lambda s: s.file_access.select("id", sc.brief_access(F.col("mode"), F.col("name"), F.col("content_hash_before")).alias("brief")))
query("scl_14_version_parts", "tag", "SELECT trial_id, arg_max(name, list_transform(string_split(name, '.'), lambda x: CAST(x AS INT))) AS name FROM tag WHERE type = 'AUTO' GROUP BY trial_id")(lambda s: tr.latest_tag(s.tag))
query("scl_17_basename", "file_access", f"SELECT id, regexp_extract(name, '[^/]*$') AS base {ACC}")(lambda s: s.file_access.select("id", sc.basename(F.col("name")).alias("base")))

# --- trials and tags ---
query("trl_01_distinct_scripts", "trial", "SELECT DISTINCT script FROM trial")(lambda s: tr.distinct_scripts(s.trial))
query("trl_02_last_trial", "trial", "SELECT id, script FROM trial WHERE start IN (SELECT max(start) FROM trial WHERE script = 'BUILDING')")(lambda s: tr.last_trial(s.trial, "BUILDING").select("id", "script"))
query("trl_03_find_by_name_and_time", "trial", "SELECT id FROM trial WHERE script = 'BUILDING' AND (strftime(start, '%Y-%m-%d %H:%M:%S') LIKE '1996%' OR strftime(finish, '%Y-%m-%d %H:%M:%S') LIKE '1996%') ORDER BY start, id LIMIT 1")(lambda s: tr.find_by_name_and_time(s.trial, "BUILDING", "1996").select("id"))
query("trl_04_load_trial", "trial tag", "SELECT DISTINCT t.id, t.script FROM trial t LEFT JOIN tag g ON g.trial_id = t.id WHERE CAST(t.id AS VARCHAR) = '1.2.3' OR g.name = '1.2.3'")(lambda s: tr.load_trial(s.trial, s.tag, "1.2.3").select("id", "script"))
query("trl_06_last_own_modules", "trial", "SELECT id FROM trial WHERE inherited_id IS NULL AND start IS NOT NULL ORDER BY start DESC, id DESC LIMIT 1")(lambda s: tr.last_own_modules(s.trial))
query("trl_07_reverse_trials", "trial", "SELECT id FROM trial WHERE experiment_id = 3 ORDER BY start DESC NULLS LAST, id LIMIT 10")(lambda s: tr.reverse_trials(s.trial, 10, 3).select("id"))
query("trl_08_count", "trial", "SELECT experiment_id, count(*) AS trials FROM trial GROUP BY experiment_id")(lambda s: tr.count_by_experiment(s.trial))
query("trl_11_modules", "trial module", "SELECT t.id AS trial, m.id AS module, m.name, m.version FROM trial t JOIN module m ON m.trial_id = coalesce(t.inherited_id, t.id)")(lambda s: tr.modules(s.trial, s.module))
query("trl_12_environment", "environment_attr", "SELECT trial_id, name, max(value) AS value FROM environment_attr GROUP BY trial_id, name")(lambda s: tr.environment(s.environment_attr))
query("trl_13_versioned_files", "trial module file_access", "SELECT trial_id, path, kind, id FROM (SELECT trial_id, name AS path, 'access' AS kind, 2 AS rank, id FROM file_access UNION ALL SELECT trial_id, name, 'module', 1, id FROM module UNION ALL SELECT id, script, 'script', 0, 0 FROM trial) QUALIFY row_number() OVER (PARTITION BY trial_id, path ORDER BY rank DESC, id) = 1")(lambda s: tr.versioned_files(s.trial, s.module, s.file_access))
query("trl_14_access_versions", "file_access", "SELECT trial_id, id, name, 0 AS moment, content_hash_before AS hash FROM file_access WHERE name LIKE '%7.dat' AND content_hash_before IS NOT NULL UNION ALL SELECT trial_id, id, name, 1, content_hash_after FROM file_access WHERE name LIKE '%7.dat'")(lambda s: tr.access_versions(s.file_access, "7.dat"))
query("trl_16_report", "trial tag", "SELECT t.id, t.script, t.status, coalesce(g.tags, '') AS tags, coalesce(g.n, 0) AS n_tags FROM trial t LEFT JOIN (SELECT trial_id, string_agg(DISTINCT name, ',' ORDER BY name) AS tags, count(*) AS n FROM tag GROUP BY trial_id) g ON g.trial_id = t.id")(lambda s: tr.report(s.trial, s.tag))
query("tag_02_next_tags", "tag", "SELECT trial_id, name, p[1] || '.' || p[2] || '.' || (p[3] + 1) AS patch, p[1] || '.' || (p[2] + 1) || '.1' AS minor, (p[1] + 1) || '.1.1' AS major FROM (SELECT trial_id, arg_max(name, list_transform(string_split(name, '.'), lambda x: CAST(x AS INT))) AS name, max(list_transform(string_split(name, '.'), lambda x: CAST(x AS INT))) AS p FROM tag WHERE type = 'AUTO' GROUP BY trial_id)")(lambda s: tr.next_tags(s.tag))
query("tag_03_auto_tags", "tag", "SELECT id, trial_id, name FROM tag WHERE type = 'AUTO'")(lambda s: s.tag.where("type = 'AUTO'").select("id", "trial_id", "name"))
query("rst_02_differing_files", "file_access", "SELECT path, stored, found FROM (SELECT name AS path, max(content_hash_before) AS stored FROM file_access GROUP BY name) FULL JOIN (SELECT name AS path, max(content_hash_after) AS found FROM file_access GROUP BY name) USING (path) WHERE stored IS DISTINCT FROM found")(lambda s: tr.differing_files(s.file_access.groupBy(F.col("name").alias("path")).agg(F.max("content_hash_before").alias("hash")), s.file_access.groupBy(F.col("name").alias("path")).agg(F.max("content_hash_after").alias("hash"))))

# --- evaluations, activations, components ---
EC = "FROM evaluation e JOIN code_component c ON c.id = e.code_component_id"
query("eva_01_query_evaluations", "evaluation code_component", f"SELECT e.id, c.name, e.repr {EC} WHERE c.mode = 'w' AND c.first_char_line BETWEEN 10 AND 20")(lambda s: ev.query_evaluations(s.evaluation, s.code_component, F.col("mode") == "w", F.col("first_char_line").between(10, 20)).select("id", "name", "repr"))
query("eva_02_by_type", "evaluation code_component", f"SELECT e.id, c.name, e.repr {EC} WHERE c.type LIKE 'PROMO%'")(lambda s: ev.query_evaluations(s.evaluation, s.code_component, F.col("type").like("PROMO%")).select("id", "name", "repr"))
query("eva_03_first_evaluation", "evaluation", "SELECT code_component_id, arg_min(id, (checkpoint, id)) AS id FROM evaluation GROUP BY 1")(lambda s: ev.first_evaluations(s.evaluation))
query("eva_01_nth_evaluation", "evaluation", "SELECT code_component_id, id FROM evaluation QUALIFY row_number() OVER (PARTITION BY code_component_id ORDER BY id) = 2")(lambda s: ev.nth_evaluations(s.evaluation, 2))
query("eva_05_assignment_sources", "dependency", "SELECT dependent_id AS id, min(dependency_id) AS source_id FROM dependency WHERE dependency_id IS NOT NULL AND type = 'assignment' GROUP BY 1")(lambda s: ev.assignment_sources(s.dependency))
query("eva_06_reference_roots", "dependency", DEP[2:].join([", ", ""]) + ", step AS (SELECT dependent_id AS n, min(dependency_id) AS p FROM dep WHERE reference GROUP BY 1), up AS (SELECT n AS node, p AS a, 1 AS depth FROM step UNION ALL SELECT u.node, s.p, u.depth + 1 FROM up u JOIN step s ON s.n = u.a) SELECT node, arg_max(a, depth) AS root FROM up GROUP BY node")(lambda s: ev.reference_roots(s.dependency))
query("act_01_inner_activations", "activation", "SELECT caller_id, id, name FROM activation WHERE caller_id IS NOT NULL")(lambda s: ev.inner_activations(s.activation))
query("act_02_without_evaluations", "activation evaluation", "SELECT id, name FROM activation a WHERE NOT EXISTS (SELECT 1 FROM evaluation e WHERE e.activation_id = a.id)")(lambda s: ev.without_evaluations(s.activation, s.evaluation))
query("act_02_with_evaluations", "activation evaluation", "SELECT id, name FROM activation a WHERE EXISTS (SELECT 1 FROM evaluation e WHERE e.activation_id = a.id)")(lambda s: ev.with_evaluations(s.activation, s.evaluation))
query("act_05_stacks", "activation", _up("activation", "id", "caller_id") + "SELECT u.node AS id, string_agg(a.name, ' -> ' ORDER BY u.depth DESC) AS stack FROM up u JOIN activation a ON a.id = u.ancestor WHERE a.caller_id IS NOT NULL GROUP BY 1")(lambda s: ev.stacks(s.activation))
query("act_06_parameters", "evaluation dependency", DEP + "SELECT d.activation_id, string_agg(e.repr, ',' ORDER BY e.id) AS arguments FROM dep d JOIN evaluation e ON e.id = d.dependency_id WHERE d.type = 'argument' GROUP BY 1")(lambda s: ev.parameters(s.dependency, s.evaluation))
query("act_07_report", "activation evaluation", "SELECT a.id, a.name, a.line, finish_checkpoint - start_checkpoint AS duration, coalesce(n, 0) AS evaluations, last_value FROM activation a LEFT JOIN (SELECT activation_id, count(*) AS n, arg_max(repr, id) AS last_value FROM evaluation GROUP BY 1) e ON e.activation_id = a.id")(lambda s: ev.activation_report(s.activation, s.evaluation))
query("cbk_02_contained", "code_component", _up("code_component", "id", "container_id") + "SELECT ancestor AS container, node AS id FROM up WHERE depth > 0")(lambda s: ev.contained(s.code_component))
query("cbk_03_contained_evaluations", "code_component evaluation", _up("code_component", "id", "container_id") + "SELECT ancestor AS container, count(*) AS evaluations FROM up JOIN evaluation e ON e.code_component_id = node GROUP BY 1")(lambda s: ev.contained_evaluations(s.code_component, s.evaluation))
query("cbk_05_in_lines", "code_component", "SELECT id, name FROM code_component WHERE first_char_line >= 5 AND last_char_line <= 15")(lambda s: ev.in_lines(s.code_component, 5, 15).select("id", "name"))
query(
    "psp_04_definition_members",
    "code_component",
    "SELECT c.id FROM code_component c, (SELECT first_char_line AS a, last_char_line AS b FROM code_component WHERE name = (SELECT min(name) FROM code_component) ORDER BY 1, 2 LIMIT 1) s WHERE c.first_char_line >= a AND c.last_char_line <= b",
)(lambda s: ev.definition_members(s.code_component).select("id"))
query("psp_05_variable_contents", "evaluation code_component", f"SELECT c.first_char_line, c.name, e.id, e.repr {EC} WHERE c.mode = 'w'")(lambda s: ev.variable_contents(s.evaluation, s.code_component))
query("psp_08_innermost", "code_component", "SELECT id, block_id FROM (SELECT c.id, b.id AS block_id, row_number() OVER (PARTITION BY c.id ORDER BY b.last_char_line - b.first_char_line, b.id) AS r FROM code_component c JOIN code_component b ON c.first_char_line BETWEEN b.first_char_line AND b.last_char_line AND b.last_char_line > b.first_char_line) WHERE r = 1")(lambda s: ev.innermost_container(s.code_component))

# --- patterns and rules ---
query("pat_03_conjunction", "evaluation code_component", f"SELECT DISTINCT c.name, e.repr {EC} WHERE e.flag = 'A'")(lambda s: ru.conjunction(ru.pattern(s.evaluation, code_component_id="?_c", repr="?repr", flag="A"), ru.pattern(s.code_component, id="?_c", name="?name")))
query("rul_03_evaluation_name", "evaluation code_component", f"SELECT e.id, c.name {EC}")(lambda s: ev.query_evaluations(s.evaluation, s.code_component).select("id", "name"))
query(
    "rul_06_timestamps",
    "activation evaluation trial file_access",
    "SELECT trial_id, id, 'start' AS moment, start_checkpoint::BIGINT AS at FROM activation UNION ALL SELECT trial_id, id, 'finish', finish_checkpoint FROM activation UNION ALL SELECT trial_id, id, 'finish', checkpoint FROM evaluation "
    "UNION ALL SELECT id, 0, 'start', epoch_us(start) // 1000000 FROM trial WHERE start IS NOT NULL UNION ALL SELECT id, 0, 'finish', epoch_us(finish) // 1000000 FROM trial WHERE start IS NOT NULL UNION ALL SELECT trial_id, id, 'access', epoch_us(checkpoint) // 1000000 FROM file_access",
)(lambda s: ru.timestamps(s.activation, s.evaluation, s.trial, s.file_access))
query("rul_07_durations", "activation", "SELECT id, finish_checkpoint - start_checkpoint AS duration FROM activation")(lambda s: ru.durations(s.activation))
query("rul_08_successors", "activation", "SELECT a.trial_id, a.id AS before, b.id AS after FROM activation a JOIN activation b ON a.trial_id = b.trial_id AND a.start_checkpoint <= b.finish_checkpoint AND a.id <> b.id")(lambda s: ru.successors(s.activation))
query("rul_10_modes", "code_component file_access", "SELECT 'code' AS model, id, mode FROM code_component UNION ALL SELECT 'access', id, mode FROM file_access")(lambda s: ru.modes(s.code_component, s.file_access))
query("rul_11_hashes", "file_access content", "SELECT 'access' AS model, id, 'before' AS moment, content_hash_before AS hash FROM file_access WHERE content_hash_before IS NOT NULL UNION ALL SELECT 'access', id, 'after', content_hash_after FROM file_access UNION ALL SELECT 'block', id, '', hash FROM content")(lambda s: ru.hashes(s.file_access, s.content))
query("rul_12_changed", "file_access", "SELECT id, name FROM file_access WHERE content_hash_before IS DISTINCT FROM content_hash_after")(lambda s: ru.changed(s.file_access))
query("rul_13_code_lines", "code_component", "SELECT id, CAST(unnest(range(first_char_line, last_char_line + 1)) AS INT) AS line FROM code_component")(lambda s: ru.code_lines(s.code_component))
query("rul_14_lines_of_activations", "evaluation code_component", f", l AS (SELECT DISTINCT e.activation_id, unnest(range(first_char_line, last_char_line + 1)) AS line {EC}) SELECT activation_id, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines FROM l GROUP BY 1")(lambda s: ru.lines_of_activations(s.evaluation, s.code_component))
query("rul_17_evaluation_lines", "evaluation code_component", f"SELECT e.id, CAST(unnest(range(first_char_line, last_char_line + 1)) AS INT) AS line {EC}")(lambda s: ru.evaluation_lines(s.evaluation, s.code_component))
query("rul_18_internal_evaluations", "activation evaluation", _up("activation", "id", "caller_id") + "SELECT ancestor AS activation_id, count(*) AS evaluations FROM up JOIN evaluation e ON e.activation_id = node GROUP BY 1")(lambda s: ru.internal_evaluations(s.activation, s.evaluation))
query("rul_20_scopes", "code_component", "SELECT c.id, coalesce(p.type, 'project') AS scope FROM code_component c LEFT JOIN code_component p ON p.id = c.container_id")(lambda s: ru.scopes(s.code_component))
query("rul_21_files_read", "file_access", f"SELECT trial_id, id, name {ACC} WHERE regexp_matches(mode, '[r+]')")(lambda s: ru.files_read(s.file_access))
query("rul_21_files_written", "file_access", f"SELECT trial_id, id, name {ACC} WHERE regexp_matches(mode, '[wxa+]')")(lambda s: ru.files_written(s.file_access))
query("rul_23_activation_stacks", "activation", _up("activation", "id", "caller_id") + "SELECT node AS id, string_agg(CAST(ancestor AS VARCHAR), ',' ORDER BY depth) AS stack FROM up WHERE depth > 0 GROUP BY 1")(lambda s: ru.activation_stacks(s.activation))
query("rul_24_indirect_activations", "activation", _up("activation", "id", "caller_id") + "SELECT ancestor AS caller, node AS called FROM up WHERE depth > 0")(lambda s: ru.indirect_activations(s.activation))
query("rul_27_indirect_accesses", "activation file_access", _up("activation", "id", "caller_id") + "SELECT ancestor AS activation, f.id AS access FROM up JOIN file_access f ON f.activation_id = node")(lambda s: ru.indirect_accesses(s.activation, s.file_access))
query(
    "rul_28_access_influence",
    "file_access activation",
    "SELECT r.trial_id, r.id AS read, w.id AS written FROM file_access r JOIN file_access w ON w.trial_id = r.trial_id AND r.checkpoint <= w.checkpoint JOIN activation a ON a.id = r.activation_id JOIN activation b ON b.id = w.activation_id "
    "WHERE regexp_matches(r.mode, '[r+]') AND regexp_matches(w.mode, '[wxa+]') AND a.start_checkpoint <= b.finish_checkpoint",
)(lambda s: ru.access_influence(s.file_access, s.activation))
query("rul_30_slices", "evaluation dependency", DEP + ", " + SLICE.format(cond=" AND d.type NOT LIKE 'arg%'") + "SELECT src, node FROM walk")(lambda s: ru.backward_slices(s.dependency, s.evaluation))
query("rul_31_slice_lines", "evaluation dependency code_component", DEP + ", " + SLICE.format(cond=" AND d.type NOT LIKE 'arg%'") + "SELECT DISTINCT src, CAST(unnest(range(first_char_line, last_char_line + 1)) AS INT) AS line FROM walk JOIN evaluation e ON e.id = node JOIN code_component c ON c.id = e.code_component_id")(lambda s: ru.slice_lines(s.dependency, s.evaluation, s.evaluation, s.code_component))

# --- lineage ---
query("lin_01_derivation", "evaluation dependency", DEP + ", walk AS (SELECT id AS src, id AS node, 0 AS depth FROM evaluation UNION SELECT w.src, d.dependency_id, w.depth + 1 FROM walk w JOIN dep d ON w.node = d.dependent_id) SELECT src, node, min(depth) AS depth FROM walk GROUP BY src, node")(lambda s: li.derivation(s.dependency, s.evaluation))
query("lin_02_members_as_of", "member", f"SELECT collection_id, key, arg_max(member_id, (checkpoint, member_id)) AS member_id FROM member WHERE checkpoint <= TIMESTAMP '{MOMENT}' GROUP BY 1, 2")(lambda s: li.members_as_of(s.member, F.lit(MOMENT).cast("timestamp_ntz")))
query("lin_02_members_at", "member", "SELECT c.collection_id, c.checkpoint AS at, m.key, arg_max(m.member_id, (m.checkpoint, m.member_id)) AS member_id FROM (SELECT DISTINCT collection_id, checkpoint FROM member) c JOIN member m ON m.collection_id = c.collection_id AND m.checkpoint <= c.checkpoint GROUP BY 1, 2, 3")(lambda s: li.members_at(s.member, s.member))
query("lin_03_was_derived_from", "evaluation dependency", DEP + ", " + SLICE.format(cond="") + "SELECT e.id, count(w.node) AS targets FROM evaluation e LEFT JOIN (SELECT src, node FROM walk WHERE node % 100 = 1 AND node <> src) w ON w.src = e.id GROUP BY e.id")(lambda s: li.was_derived_from(s.dependency, s.evaluation, s.evaluation.where("checkpoint = 1")))
query(
    "lin_04_derived_pairs",
    "evaluation dependency code_component",
    DEP + ", " + SLICE.format(cond="") + "SELECT w.src AS id, w.node AS target_id FROM walk w JOIN evaluation e ON e.id = w.src JOIN code_component c ON c.id = e.code_component_id AND c.mode = 'w' JOIN evaluation t ON t.id = w.node AND t.flag = 'R' AND w.node <> w.src",
)(lambda s: li.derived_pairs(s.dependency, ev.query_evaluations(s.evaluation, s.code_component, F.col("mode") == "w"), s.evaluation.where("flag = 'R'")))
query(
    "lin_09_only_derived",
    "evaluation dependency",
    DEP + ", last AS (SELECT trial_id, max(id) AS id FROM evaluation GROUP BY 1), walk AS (SELECT id AS node FROM last UNION SELECT d.dependency_id FROM walk w JOIN dep d ON d.dependent_id = w.node) SELECT trial_id, id, repr FROM evaluation WHERE id IN (SELECT node FROM walk)",
)(lambda s: li.only_derived(s.evaluation, s.dependency, s.evaluation.groupBy("trial_id").agg(F.max("id").alias("id"))).select("trial_id", "id", "repr"))
query("lin_07_numbered_dependencies", "evaluation dependency", DEP + ", walk AS (SELECT id AS src, id AS node, 0 AS depth FROM evaluation UNION SELECT w.src, d.dependency_id, w.depth + 1 FROM walk w JOIN dep d ON w.node = d.dependent_id) SELECT w.src, w.node, e.repr, row_number() OVER (PARTITION BY w.src ORDER BY w.depth, w.node) AS number FROM walk w JOIN evaluation e ON e.id = w.node WHERE w.depth > 0")(lambda s: li.numbered_dependencies(s.dependency, s.evaluation, s.evaluation))

# --- dataflow, summaries, diffs, history ---
query("clu_05_one_per_component", "evaluation", "SELECT trial_id, code_component_id, min(id) AS id FROM evaluation GROUP BY 1, 2")(lambda s: su.one_per_component(s.evaluation))
query("clu_07_access_edges", "file_access", "SELECT 'e_' || activation_id AS source, 'a_' || id AS target FROM file_access WHERE regexp_matches(mode, '[r+]') UNION ALL SELECT 'a_' || id, 'e_' || activation_id FROM file_access WHERE regexp_matches(mode, '[wxa+]')")(lambda s: su.access_edges(s.file_access))
query("clu_09_propagated", "evaluation dependency", DEP + ", walk AS (SELECT d.dependent_id AS source, d.dependency_id AS node FROM dep d WHERE d.dependent_id % 100 % 3 <> 0 UNION SELECT w.source, d.dependency_id FROM walk w JOIN dep d ON d.dependent_id = w.node WHERE w.node % 100 % 3 = 0) SELECT source, node AS target FROM walk WHERE node % 100 % 3 <> 0 AND source <> node")(lambda s: su.propagated(s.dependency, s.evaluation.where("checkpoint % 3 = 0")))
query("clu_13_name_synonyms", "file_access", "SELECT trial_id, id, min(id) OVER (PARTITION BY trial_id, name) AS synonym FROM file_access")(lambda s: su.name_synonyms(s.file_access))
query("clu_18_ranks", "evaluation code_component", f"SELECT e.activation_id, c.first_char_line AS line, string_agg(CAST(e.id AS VARCHAR), ',' ORDER BY e.id) AS nodes {EC} GROUP BY 1, 2")(lambda s: su.ranks(s.evaluation, s.code_component))
TREE = ", tree AS (SELECT caller_id, id, row_number() OVER (PARTITION BY caller_id ORDER BY start_checkpoint, id) - 1 AS child, lead(id) OVER (PARTITION BY caller_id ORDER BY start_checkpoint, id) AS nxt FROM activation WHERE caller_id IS NOT NULL) "
EDGES = TREE + ", edge AS (SELECT caller_id AS source, id AS target, 'call' AS type FROM tree WHERE child = 0 UNION ALL SELECT id, nxt, 'sequence' FROM tree WHERE nxt IS NOT NULL UNION ALL SELECT id, caller_id, 'return' FROM tree WHERE nxt IS NULL) "
query("sum_01_call_tree", "activation", TREE + "SELECT caller_id, id, CAST(child AS INT) AS child FROM tree")(lambda s: su.call_tree(s.activation))
query("sum_02_sequence_edges", "activation", EDGES + "SELECT * FROM edge")(lambda s: su.sequence_edges(s.activation))
query("sum_04_namespace_match", "activation", _up("activation", "id", "caller_id") + ", path AS (SELECT u.node, string_agg(a.line || ':' || a.name, '/' ORDER BY u.depth DESC) AS path FROM up u JOIN activation a ON a.id = u.ancestor GROUP BY 1) SELECT a.trial_id, p.path, count(*) AS calls, CAST(sum(finish_checkpoint - start_checkpoint) AS BIGINT) AS duration FROM path p JOIN activation a ON a.id = p.node GROUP BY 1, 2")(lambda s: su.namespace_match(s.activation))
query("sum_07_edge_counts", "activation", EDGES + "SELECT a.trial_id, a.name AS source_name, b.name AS target_name, type, count(*) AS n FROM edge JOIN activation a ON a.id = source JOIN activation b ON b.id = target GROUP BY 1, 2, 3, 4")(lambda s: su.edge_counts(s.activation))
query("sum_08_duration_range", "activation", "SELECT trial_id, min(finish_checkpoint - start_checkpoint) AS least, max(finish_checkpoint - start_checkpoint) AS most FROM activation GROUP BY 1")(lambda s: su.duration_range(s.activation))
query("dif_01_attributes", "trial", "SELECT attribute, before, after FROM (UNPIVOT (SELECT script AS script, status, CAST(experiment_id AS VARCHAR) AS experiment_id FROM trial WHERE id = 1) ON script, status, experiment_id INTO NAME attribute VALUE before) JOIN (UNPIVOT (SELECT script, status, CAST(experiment_id AS VARCHAR) AS experiment_id FROM trial WHERE id = 2) ON script, status, experiment_id INTO NAME attribute VALUE after) USING (attribute) WHERE before IS DISTINCT FROM after")(lambda s: su.diff_attributes(s.trial, "id", 1, 2, ["script", "status", "experiment_id"]))
query("dif_03_environment", "environment_attr", ", a AS (SELECT name, value FROM environment_attr WHERE trial_id = 2 EXCEPT SELECT name, value FROM environment_attr WHERE trial_id = 1), r AS (SELECT name, value FROM environment_attr WHERE trial_id = 1 EXCEPT SELECT name, value FROM environment_attr WHERE trial_id = 2), b AS (SELECT name, coalesce(x.n, 0) AS x, coalesce(y.n, 0) AS y FROM (SELECT name, count(*) AS n FROM a GROUP BY 1) x FULL JOIN (SELECT name, count(*) AS n FROM r GROUP BY 1) y USING (name)) SELECT * FROM (SELECT name, 'replaced' AS kind, least(x, y) AS n FROM b UNION ALL SELECT name, 'added', x - least(x, y) FROM b UNION ALL SELECT name, 'removed', y - least(x, y) FROM b) WHERE n > 0")(lambda s: su.diff_sets(s.environment_attr, 1, 2, "name", ["value"]))
#: Lengths of longest common subsequences, a row of the table of lengths at a time.
LCS = (
    ", lists AS (SELECT notebook_id AS id, list({value} ORDER BY position) AS v FROM cell GROUP BY 1), "
    "pairs AS (SELECT a.id, b.id AS other_id, a.v AS a, b.v AS b FROM lists a JOIN lists b ON b.id = a.id + 1), "
    "dp AS (SELECT id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS row FROM pairs UNION ALL SELECT id, a, b, i + 1, "
    "list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND a[i + 1] = b[k - 1] THEN greatest(row[k], row[k - 1] + 1) ELSE row[k] END))) FROM dp WHERE i < len(a)), "
    "common AS (SELECT id, row[len(b) + 1]::BIGINT AS n FROM dp WHERE i = len(a)) "
)
query("dif_06_lcs", "cell", LCS.format(value="role") + "SELECT id AS notebook_id, n AS common FROM common")(lambda s: su.lcs_lengths(s.cell))
query("his_01_history_edges", "trial", _up("trial", "id", "parent_id") + "SELECT u.node AS id, arg_min(u.ancestor, u.depth) AS ancestor, min(u.depth) AS distance FROM up u JOIN trial a ON a.id = u.ancestor AND a.status = 'finished' JOIN trial n ON n.id = u.node AND n.status = 'finished' WHERE u.depth > 0 GROUP BY 1")(lambda s: su.history_edges(s.trial, s.trial.where("status = 'finished'")))
query("his_02_distances", "trial", _up("trial", "id", "parent_id") + "SELECT node AS id, ancestor, depth AS distance FROM up WHERE depth > 0")(lambda s: su.trial_distances(s.trial))
query("his_04_by_version", "tag", "SELECT array_to_string(string_split(name, '.')[1:2], '.') AS version, count(DISTINCT trial_id) AS trials, count(*) AS tags FROM tag WHERE type = 'AUTO' GROUP BY 1")(lambda s: su.history_by_version(s.tag))
query("lin_01_through_members", "member evaluation dependency", DEP + ", v AS (SELECT collection_id, member_id, checkpoint AS since, lead(checkpoint) OVER (PARTITION BY collection_id, key ORDER BY checkpoint, member_id) AS until FROM member), walk AS (SELECT member_id AS src, collection_id AS node, checkpoint AS at FROM member UNION (SELECT w.src, v.member_id, w.at FROM walk w JOIN v ON v.collection_id = w.node AND v.since <= w.at AND (v.until IS NULL OR w.at < v.until) UNION ALL SELECT w.src, d.dependency_id, w.at FROM walk w JOIN dep d ON d.dependent_id = w.node)) SELECT src, node, \"at\" FROM walk")(
    lambda s: li.derivation_through_members(s.member, s.member.select(F.col("member_id").alias("src"), F.col("collection_id").alias("node"), F.col("checkpoint").alias("at")), s.dependency)
)
from lineagraph.plans import dataflow, exports, flow, lookups, reports, succession, trees  # noqa: E402, F401  (they register their queries)
