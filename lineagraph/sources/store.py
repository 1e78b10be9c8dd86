"""The provenance tables as DataFrames, projected from order-management tables, and their upkeep."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored

#: Each provenance table as a query on the source tables. ``{div}`` is whole division, ``{key}`` the value k of props.
TABLES = {
    "trial": """
        SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) {div} 2 END AS parent_id, c_mktsegment AS script,
               CASE WHEN c_acctbal < 0 THEN 'unfinished' WHEN c_custkey % 10 = 0 THEN 'backup' ELSE 'finished' END AS status,
               o.start, o.finish, c_nationkey AS experiment_id, concat('run ', lower(c_mktsegment)) AS command,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey - c_custkey % 3 END AS inherited_id
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS start, max(o_orderdate) AS finish FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""",
    "evaluation": """
        SELECT o_custkey AS trial_id, l_orderkey * 100 + n AS id, n AS checkpoint, l_partkey AS code_component_id, l_orderkey AS activation_id,
               CAST(CAST(floor(l_quantity) AS BIGINT) AS STRING) AS repr, l_returnflag AS flag, l_linestatus AS line_status
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n FROM lineitem) l
        JOIN orders ON l_orderkey = o_orderkey""",
    "code_component": """
        SELECT p_partkey AS id, p_name AS name, p_type AS type, CASE WHEN p_size % 2 = 0 THEN 'w' ELSE 'r' END AS mode, p_size AS first_char_line,
               CAST(p_size + p_partkey % 5 AS INT) AS last_char_line, p_partkey % 20 AS first_char_column,
               CASE WHEN p_partkey > 0 THEN (p_partkey - 1) {div} 2 END AS container_id FROM part""",
    "code_block": "SELECT p_partkey AS id, sha1(p_name) AS code_hash, p_brand AS docstring FROM part",
    "dependency": """
        SELECT trial_id, id AS dependent_id, lag(id) OVER (PARTITION BY activation_id ORDER BY id) AS dependency_id, activation_id,
               CASE flag WHEN 'A' THEN 'argument' WHEN 'N' THEN 'assignment' ELSE 'use' END AS type, line_status = 'O' AS reference FROM evaluation""",
    "statement": """
        SELECT trial_id, id, id AS line, code_component_id % 4 AS col, CASE code_component_id % 13 WHEN 0 THEN 'if' WHEN 1 THEN 'elif' WHEN 2 THEN 'else' WHEN 3 THEN 'for' WHEN 4 THEN 'while'
               WHEN 5 THEN 'try' WHEN 6 THEN 'except' WHEN 7 THEN 'finally' WHEN 8 THEN 'function_def' WHEN 9 THEN 'return' ELSE 'call' END AS kind FROM evaluation""",
    "member": "SELECT user_id AS collection_id, event_type AS key, event_id AS member_id, ts AS checkpoint FROM events",
    "file_access": """
        SELECT user_id AS trial_id, event_id AS id, concat(CASE WHEN event_id % 4 = 0 THEN '/tmp/' ELSE '' END, 'file', event_id % 40, '.dat') AS name,
               CASE event_type WHEN 'click' THEN 'r' WHEN 'view' THEN 'rb' WHEN 'purchase' THEN 'w' WHEN 'signup' THEN 'a+' ELSE 'r+' END AS mode,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE sha1(CAST(event_id {div} 2 AS STRING)) END AS content_hash_before,
               sha1(CAST((event_id + event_id % 3) {div} 2 AS STRING)) AS content_hash_after, ts AS checkpoint, event_id % 100 AS activation_id FROM events""",
    "environment_attr": "SELECT DISTINCT user_id AS trial_id, event_type AS name, {key} AS value FROM events",
    "module": "SELECT s_nationkey AS trial_id, s_suppkey AS id, concat('module', s_suppkey % 9) AS name, concat(s_suppkey % 3, '.', s_suppkey % 4) AS version, sha1(s_name) AS code_hash FROM supplier",
    "tag": """
        SELECT p_partkey AS id, p_partkey % 150 AS trial_id, CASE WHEN p_partkey % 4 = 0 THEN 'USER' ELSE 'AUTO' END AS type,
               concat(1 + p_partkey % 3, '.', 1 + p_partkey % 5, '.', 1 + p_partkey % 11) AS name FROM part""",
    "content": "SELECT doc_id AS id, sha1(text) AS hash FROM documents",
    "cell": "SELECT conv_id AS notebook_id, turn AS position, role, text FROM conversations",
}
TABLES["activation"] = """
        SELECT a.trial_id, a.id, a.name, a.code_block_id, a.start_checkpoint, a.finish_checkpoint, a.line, a.place, c.id AS caller_id
        FROM ({rows}) a LEFT JOIN ({rows}) c ON a.trial_id = c.trial_id AND a.place > 0 AND c.place = (a.place - 1) {{div}} 2""".replace(
    "{rows}",
    """SELECT o_custkey AS trial_id, o_orderkey AS id, o_orderpriority AS name, o_orderkey % 50 AS code_block_id, o_orderkey * 10 AS start_checkpoint,
                     o_orderkey * 10 + CAST(floor(o_totalprice) AS BIGINT) % 90 AS finish_checkpoint, o_orderkey % 7 AS line,
                     row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders""",
).replace("{{div}}", "{div}")

_NEEDS = {"dependency": ("evaluation",), "statement": ("evaluation",)}


def spark_sql(name: str) -> str:
    return TABLES[name].format(div="div", key="get_json_object(props, '$.k')")


def duck_sql(*names: str) -> str:
    """A WITH clause with the named tables, for the same projection in DuckDB."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*_NEEDS.get(n, ()), n) if x not in wanted]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({TABLES[n].format(div='//', key=chr(39).join(['json_extract_string(props, ', '$.k', ')']))})" for n in wanted) + " "


class Store:
    """Provenance tables over a folder of source tables; each is a lazy DataFrame.

    Those in ``kept`` are projected once and read from Parquet in the shared folder afterwards.
    """

    SOURCES = ("customer", "orders", "lineitem", "part", "supplier", "events", "documents", "conversations")

    def __init__(self, spark: SparkSession, folder: str, kept: tuple[str, ...] = ()):
        self.spark, self.folder, self.kept = spark, folder, kept

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        text = spark_sql(name)
        frames = {n: self.source(n) for n in self.SOURCES if n in text}
        frames |= {n: getattr(self, n) for n in _NEEDS.get(name, ())}
        for n in frames:
            text = _word(text, n, "{" + n + "}")
        rows = self.spark.sql(text, **frames) if name != "dependency" else self.spark.sql(text, **frames).where("dependency_id IS NOT NULL")
        return stored(rows) if name in self.kept else rows

    trial = cached_property(lambda self: self.table("trial"))
    activation = cached_property(lambda self: self.table("activation"))
    evaluation = cached_property(lambda self: self.table("evaluation"))
    code_component = cached_property(lambda self: self.table("code_component"))
    code_block = cached_property(lambda self: self.table("code_block"))
    dependency = cached_property(lambda self: self.table("dependency"))
    statement = cached_property(lambda self: self.table("statement"))
    member = cached_property(lambda self: self.table("member"))
    file_access = cached_property(lambda self: self.table("file_access"))
    environment_attr = cached_property(lambda self: self.table("environment_attr"))
    module = cached_property(lambda self: self.table("module"))
    tag = cached_property(lambda self: self.table("tag"))
    content = cached_property(lambda self: self.table("content"))
    cell = cached_property(lambda self: self.table("cell"))


def _word(text: str, word: str, put: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+{word}\b", rf"\1 {put}", text)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def delete_trials(table: DataFrame, trials: DataFrame) -> DataFrame:
    return table.join(trials.select(F.col("id").alias("trial_id")), "trial_id", "left_anti")


def put_content(known: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Content-addressed rows (hash, value): values not known yet, each once."""
    hashed = values.select(F.sha1(F.col(column)).alias("hash"), F.col(column).alias("value")).dropDuplicates(["hash"])
    return known.unionByName(hashed.join(known.select("hash"), "hash", "left_anti"))


def find_subhash(content: DataFrame, prefix: str) -> DataFrame:
    """The least hash with the prefix."""
    return content.where(F.col("hash").startswith(prefix)).agg(F.min("hash").alias("hash"))


def bundle(tables: dict[str, DataFrame], trial_ids: DataFrame) -> dict[str, DataFrame]:
    """The rows of each table that belong to the trials."""
    return {n: t.join(trial_ids.select("trial_id"), "trial_id", "left_semi") for n, t in tables.items()}


def missing(source: DataFrame, target: DataFrame, key: str = "id") -> DataFrame:
    """What a pull or a push would copy."""
    return source.join(target.select(key), key, "left_anti")


def import_bundle(tables: dict[str, DataFrame], bundle_: dict[str, DataFrame], experiment_id: int, keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """The tables after upserting a bundle whose trials go to an experiment; tables not in the bundle stay."""
    moved = {n: t.withColumn("experiment_id", F.lit(experiment_id).cast(t.schema["experiment_id"].dataType)) if n == "trial" else t for n, t in bundle_.items()}
    return {n: upsert(t, moved[n].select(*t.columns), keys[n]) if n in moved else t for n, t in tables.items()}


def users_of_group(users: DataFrame, membership: DataFrame, group_id: int) -> DataFrame:
    """The users (id, ...) with a membership (user_id, group_id) in the group, each once."""
    return users.join(membership.where(F.col("group_id") == group_id).select(F.col("user_id").alias("id")), "id", "left_semi")


def annotations_of(annotations: DataFrame, body: str = "annotation", **of) -> DataFrame:
    """Annotations of an experiment, a trial or an id, without their bodies."""
    for column, value in of.items():
        annotations = annotations.where(F.col(column) == value)
    return annotations.drop(body)


def schema_of(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """(table, place, column, type, nullable) of the tables; reads no rows."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, t in tables.items() for i, f in enumerate(t.schema.fields)]
    return spark.createDataFrame(rows, "table string, place int, column string, type string, nullable boolean")
