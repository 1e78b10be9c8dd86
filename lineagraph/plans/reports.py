"""Registered queries of whole reports, names and docstrings of all models, bundles, tags and named lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.functions import scalars as sc
from lineagraph.operators import lookups as lo
from lineagraph.operators import reports as re
from lineagraph.operators import rules as ru
from lineagraph.operators import summaries as su
from lineagraph.plans.queries import DEP, SLICE, query
from lineagraph.sources.store import Store

#: Component types that stand for globals, parameters and variables.
KINDS = {"globals": "PROMO", "parameters": "SMALL", "variables": "LARGE"}
_LISTED = "(SELECT e.activation_id, string_agg(c.name || ' = ' || e.repr, ';' ORDER BY e.id) AS {0} FROM evaluation e JOIN code_component c ON c.id = e.code_component_id WHERE c.type = '{1}' GROUP BY 1) {0} ON {0}.activation_id = a.id"
REPORT = (
    ", report AS (SELECT a.id, a.trial_id, a.name, a.line, a.start_checkpoint AS start, a.finish_checkpoint AS finish, a.finish_checkpoint - a.start_checkpoint AS duration, coalesce(globals, '') AS globals, coalesce(parameters, '') AS parameters, coalesce(variables, '') AS variables, "
    "return_value, coalesce(b.code_hash, '') AS hash, coalesce(accesses, '') AS accesses FROM activation a LEFT JOIN code_block b ON b.id = a.code_block_id "
    + " ".join("LEFT JOIN " + _LISTED.format(*kind) for kind in KINDS.items())
    + " LEFT JOIN (SELECT activation_id, arg_max(repr, id) AS return_value FROM evaluation GROUP BY 1) r ON r.activation_id = a.id "
    "LEFT JOIN (SELECT activation_id, string_agg(mode || ' ' || name, ';' ORDER BY id) AS accesses FROM file_access GROUP BY 1) f ON f.activation_id = a.id) "
)
COLUMNS = ("line", "duration", *KINDS, "return_value", "hash", "accesses")
TABLES = "activation evaluation code_component code_block file_access"


def report(s: Store) -> DataFrame:
    return re.whole_report(s.activation, s.evaluation, s.code_component, s.code_block, s.file_access, KINDS)


query("act_07_whole_report", TABLES, REPORT + "SELECT * EXCLUDE (trial_id) FROM report")(report)
query(
    "dif_05_whole_reports",
    TABLES,
    REPORT.replace(", report AS (", ", report AS MATERIALIZED (") + ", pairs AS (SELECT id, lag(id) OVER (PARTITION BY trial_id, name ORDER BY id) AS other_id FROM activation), "
    "both_sides AS (" + " UNION ALL ".join(f"SELECT p.id, p.other_id, '{c}' AS attribute, b.{c}::VARCHAR AS before, a.{c}::VARCHAR AS after FROM pairs p JOIN report a ON a.id = p.id JOIN report b ON b.id = p.other_id" for c in COLUMNS) + ") "
    "SELECT * FROM both_sides WHERE before IS DISTINCT FROM after",
)(lambda s: su.diff_activations(s.activation.select("id", F.lag("id").over(Window.partitionBy("trial_id", "name").orderBy("id")).alias("other_id")).where("other_id is not null"), report(s).select("id", *COLUMNS)))

query(
    "rul_05_names",
    "activation code_component file_access evaluation trial",
    "SELECT 'activation' AS model, id, name FROM activation UNION ALL SELECT 'code_component', id, name FROM code_component UNION ALL SELECT 'code_block', id, name FROM code_component UNION ALL SELECT 'access', id, name FROM file_access "
    "UNION ALL SELECT 'trial', id, script FROM trial UNION ALL SELECT 'evaluation', e.id, c.name FROM evaluation e JOIN code_component c ON c.id = e.code_component_id",
)(
    lambda s: ru.names(
        activation=s.activation, code_component=s.code_component, code_block=s.code_component, access=s.file_access, trial=s.trial.withColumnRenamed("script", "name"),
        evaluation=s.evaluation.select("id", "code_component_id").join(s.code_component.select(F.col("id").alias("code_component_id"), "name"), "code_component_id"),
    )
)
query(
    "rul_19_docstrings",
    "activation code_component code_block",
    ", own AS (SELECT b.id, c.name, b.docstring FROM code_block b JOIN code_component c ON c.id = b.id), calls AS (SELECT a.id, a.name, b.docstring FROM activation a JOIN code_block b ON b.id = a.code_block_id) "
    "SELECT m.model, x.* FROM own x, (VALUES ('code_component'), ('code_block')) m(model) UNION ALL SELECT m.model, x.* FROM calls x, (VALUES ('evaluation'), ('activation')) m(model)",
)(lambda s: re.docstrings(s.code_block, s.activation, s.code_component))

ARGUED = DEP + ", " + SLICE.format(cond=" AND NOT starts_with(d.type, 'arg')")
query("cbk_06_marked_code", "evaluation dependency", ARGUED + "SELECT DISTINCT w.src AS evaluation_id, e.code_component_id AS id FROM walk w JOIN evaluation e ON e.id = w.node")(
    lambda s: ru.backward_slices(s.dependency, s.evaluation).join(s.evaluation.select(F.col("id").alias("node"), "code_component_id"), "node").select(F.col("src").alias("evaluation_id"), F.col("code_component_id").alias("id")).distinct()
)
query(
    "lin_07_named_dependencies",
    "evaluation dependency code_component",
    DEP + ", told AS (SELECT e.trial_id, e.id, c.name, e.repr FROM evaluation e JOIN code_component c ON c.id = e.code_component_id), seed AS (SELECT trial_id, name AS variable, max(id) AS id FROM told GROUP BY 1, 2), "
    "walk AS (SELECT id AS src, id AS node, 0 AS depth FROM seed UNION SELECT w.src, d.dependency_id, w.depth + 1 FROM walk w JOIN dep d ON d.dependent_id = w.node), near AS (SELECT src, node, min(depth) AS depth FROM walk GROUP BY 1, 2), "
    "entry AS (SELECT n.src, n.node, n.depth, t.name, CASE WHEN length(t.repr) > 20 THEN 'complex data type' ELSE t.repr END AS value FROM near n JOIN told t ON t.id = n.node WHERE EXISTS (SELECT 1 FROM dep d WHERE d.dependent_id = n.node AND d.type <> 'argument')), "
    "kept AS (SELECT * FROM (SELECT *, lag({'n': name, 'v': value}) OVER (PARTITION BY src ORDER BY depth, node) AS before FROM entry WHERE name IS DISTINCT FROM value) WHERE before IS DISTINCT FROM {'n': name, 'v': value}) "
    "SELECT s.trial_id, s.variable, row_number() OVER (PARTITION BY k.src ORDER BY k.depth, k.node) AS number, k.name, k.value FROM kept k JOIN seed s ON s.id = k.src",
)(lambda s: re.named_dependencies(s.dependency, s.evaluation, s.code_component))

TAGGED = (
    ", v AS (SELECT r.script, r.status, [x::INT FOR x IN string_split(t.name, '.')] AS v FROM tag t JOIN trial r ON r.id = t.trial_id WHERE t.type = 'AUTO'), "
    "found AS (SELECT t.id, t.status, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.v IS NOT NULL THEN 3 ELSE 0 END AS level, coalesce(a.v, b.v, c.v, [1, 1, 1]) AS v FROM trial t "
    "LEFT JOIN (SELECT script, status, max(v) AS v FROM v GROUP BY 1, 2) a USING (script, status) LEFT JOIN (SELECT script, max(v) AS v FROM v GROUP BY 1) b USING (script) CROSS JOIN (SELECT max(v) AS v FROM v) c) "
)
query(
    "tag_02_created_tags",
    "trial tag",
    TAGGED + "SELECT id, array_to_string(CASE level WHEN 1 THEN [v[1], v[2], v[3] + 1] WHEN 2 THEN [v[1], v[2] + 1, 1] WHEN 3 THEN CASE WHEN status = 'backup' THEN [v[1] + 1, 0, 0] ELSE [v[1] + 1, 1, 1] END ELSE v END, '.') AS name FROM found",
)(lambda s: re.created_tags(lo.automatic_tags(s.trial.select("id", "script", F.col("status").alias("command")), s.tag).join(s.trial.select("id", "status"), "id"), F.col("status") == "backup"))

OWN_TABLES = ("activation", "evaluation", "file_access", "module", "tag")
query(
    "snk_05_bundle_rows",
    "trial activation evaluation dependency code_component code_block environment_attr file_access module tag member",
    ", asked AS (SELECT id AS trial_id FROM trial WHERE status = 'backup'), r AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", trial_id, id::VARCHAR AS id FROM {t}" for t in OWN_TABLES)
    + " UNION ALL SELECT 'trial', id, id::VARCHAR FROM trial UNION ALL SELECT 'dependency', trial_id, dependent_id || ' ' || dependency_id FROM dependency WHERE dependency_id IS NOT NULL UNION ALL SELECT 'environment_attr', trial_id, name || '=' || value FROM environment_attr "
    "UNION ALL SELECT 'member', collection_id, member_id::VARCHAR FROM member UNION ALL SELECT DISTINCT 'code_component', trial_id, code_component_id::VARCHAR FROM evaluation UNION ALL SELECT DISTINCT 'code_block', trial_id, code_block_id::VARCHAR FROM activation "
    "UNION ALL SELECT DISTINCT 'composition', e.trial_id, c.id || ' ' || c.container_id FROM evaluation e JOIN code_component c ON c.id = e.code_component_id WHERE c.container_id IS NOT NULL UNION ALL SELECT DISTINCT 'user', id, experiment_id::VARCHAR FROM trial) "
    "SELECT r.* FROM r WHERE trial_id IN (SELECT trial_id FROM asked)",
)(
    lambda s: re.bundle_rows(
        {t: getattr(s, t) for t in OWN_TABLES}
        | {
            "trial": s.trial.withColumn("trial_id", F.col("id")),
            "dependency": s.dependency.withColumn("id", F.concat_ws(" ", "dependent_id", "dependency_id")),
            "environment_attr": s.environment_attr.withColumn("id", F.concat_ws("=", "name", "value")),
            "member": s.member.select(F.col("collection_id").alias("trial_id"), F.col("member_id").alias("id")),
        },
        {
            "code_component": s.evaluation.select("trial_id", F.col("code_component_id").alias("id")),
            "code_block": s.activation.select("trial_id", F.col("code_block_id").alias("id")),
            "composition": s.evaluation.join(s.code_component.where("container_id is not null").select(F.col("id").alias("code_component_id"), "container_id"), "code_component_id").select("trial_id", F.concat_ws(" ", "code_component_id", "container_id").alias("id")),
            "user": s.trial.select(F.col("id").alias("trial_id"), F.col("experiment_id").alias("id")),
        },
        s.trial.where("status = 'backup'").select(F.col("id").alias("trial_id")),
    )
)

query(
    "trl_14_accesses_of_path",
    "trial module file_access",
    "SELECT * FROM (SELECT id AS trial_id, 0 AS part, id, 0 AS moment, script AS path, NULL AS hash FROM trial UNION ALL SELECT trial_id, 1, id, 0, name, code_hash FROM module "
    "UNION ALL SELECT trial_id, 2, id, 0, name, content_hash_before FROM file_access WHERE content_hash_before IS NOT NULL UNION ALL SELECT trial_id, 2, id, 1, name, content_hash_after FROM file_access WHERE content_hash_after IS NOT NULL) WHERE suffix(path, '7') OR suffix(path, '7.dat')",
)(lambda s: re.accesses_of_path(s.trial, s.module, s.file_access, "7").unionByName(re.accesses_of_path(s.trial, s.module, s.file_access, "7.dat")))
query(
    "scl_12_briefs",
    "file_access module environment_attr",
    "SELECT 'access' AS model, '(' || mode || ') ' || name || CASE WHEN content_hash_before IS NULL THEN ' (new)' ELSE '' END AS brief FROM file_access UNION ALL SELECT 'module', name || ' ' || version FROM module UNION ALL SELECT 'environment', name FROM environment_attr",
)(
    lambda s: s.file_access.select(F.lit("access").alias("model"), sc.brief_access(F.col("mode"), F.col("name"), F.col("content_hash_before")).alias("brief"))
    .unionByName(s.module.select(F.lit("module").alias("model"), F.concat_ws(" ", "name", "version").alias("brief")))
    .unionByName(s.environment_attr.select(F.lit("environment").alias("model"), F.col("name").alias("brief")))
)
query(
    "msc_07_derived_columns",
    "trial module code_block",
    "SELECT 'module' AS model, m.id, b.code_hash AS code, NULL AS str_start, NULL AS str_finish FROM module m LEFT JOIN code_block b ON b.id = m.id UNION ALL SELECT 'trial', id, NULL, strftime(start, '%Y-%m-%d %H:%M:%S'), strftime(finish, '%Y-%m-%d %H:%M:%S') FROM trial",
)(
    lambda s: s.module.select("id").join(s.code_block.select("id", "code_hash"), "id", "left").select(F.lit("module").alias("model"), "id", F.col("code_hash").alias("code"), F.lit(None).cast("string").alias("str_start"), F.lit(None).cast("string").alias("str_finish"))
    .unionByName(s.trial.select(F.lit("trial").alias("model"), "id", F.lit(None).cast("string").alias("code"), *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(f"str_{c}") for c in ("start", "finish"))))
)
query(
    "his_05_levels",
    "trial",
    ", newest AS (SELECT parent_id, max(id) AS id FROM trial WHERE parent_id IS NOT NULL GROUP BY 1), p AS (SELECT t.id, t.script, t.parent_id, coalesce(u.script = t.script AND n.id = t.id, false) AS goes_on FROM trial t LEFT JOIN trial u ON u.id = t.parent_id LEFT JOIN newest n ON n.parent_id = t.parent_id), "
    "begun AS (SELECT id, script, row_number() OVER (PARTITION BY script ORDER BY id) - 1 AS lane FROM p WHERE NOT goes_on), line AS (SELECT id, script, lane FROM begun UNION ALL SELECT p.id, p.script, l.lane FROM line l JOIN p ON p.parent_id = l.id AND p.goes_on), "
    "scripts AS (SELECT script, count(*) AS n, max(id) AS newest, CASE WHEN count(*) > 1 THEN count(*) FILTER (NOT goes_on) ELSE 0 END AS lanes FROM p GROUP BY 1), "
    "stacked AS (SELECT script, CASE WHEN n > 1 THEN coalesce(sum(lanes) OVER (ORDER BY newest DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + max(CASE WHEN n = 1 THEN 1 ELSE 0 END) OVER () ELSE 0 END AS off FROM scripts) "
    "SELECT l.id, l.script, (l.lane + s.off)::BIGINT AS level FROM line l JOIN stacked s USING (script)",
)(lambda s: re.history_levels(s.trial, s.trial.where("parent_id is not null").select("id", F.col("parent_id").alias("parent"))))
