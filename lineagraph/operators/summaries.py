"""Call-tree summaries, diffs, history and dataflow graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.functions.scalars import reads, writes
from lineagraph.operators.alignment import common_subsequences
from lineagraph.operators.closure import ancestors
from lineagraph.operators.trees import label_paths


def call_tree(activation: DataFrame) -> DataFrame:
    """(caller_id, id, child): the tree's edges with the child's place among its siblings."""
    place = F.row_number().over(Window.partitionBy("caller_id").orderBy("start_checkpoint", "id")) - 1
    return activation.where("caller_id is not null").select("caller_id", "id", place.alias("child"))


def sequence_edges(activation: DataFrame) -> DataFrame:
    """(source, target, type): call to the first child, sequence among siblings, return from the last."""
    tree = call_tree(activation)
    after = F.lead("id").over(Window.partitionBy("caller_id").orderBy("child"))
    seq = tree.withColumn("after", after)
    edge = lambda s, t, kind: (F.col(s).alias("source"), F.col(t).alias("target"), F.lit(kind).alias("type"))
    return tree.where("child = 0").select(*edge("caller_id", "id", "call")).unionByName(seq.where("after is not null").select(*edge("id", "after", "sequence"))).unionByName(seq.where("after is null").select(*edge("id", "caller_id", "return")))


def namespace_paths(activation: DataFrame) -> DataFrame:
    """(id, trial_id, path, duration): lines and names from the root down to each activation."""
    steps = activation.select(F.col("trial_id").alias("tree_id"), "id", F.col("caller_id").alias("parent_id"), F.concat_ws(":", F.col("line").cast("string"), "name").alias("label"))
    paths = label_paths(steps).select("id", "path")
    return paths.join(activation.select("id", "trial_id", (F.col("finish_checkpoint") - F.col("start_checkpoint")).alias("duration")), "id")


def namespace_match(activation: DataFrame) -> DataFrame:
    """Activations merged by their path: (trial_id, path, calls, duration)."""
    return namespace_paths(activation).groupBy("trial_id", "path").agg(F.count("*").alias("calls"), F.sum("duration").alias("duration"))


def edge_counts(activation: DataFrame) -> DataFrame:
    named = activation.select("id", "name", "trial_id")
    e = sequence_edges(activation)
    joined = e.join(named.withColumnsRenamed({"id": "source", "name": "source_name"}), "source").join(named.select(F.col("id").alias("target"), F.col("name").alias("target_name")), "target")
    return joined.groupBy("trial_id", "source_name", "target_name", "type").agg(F.count("*").alias("n"))


def duration_range(activation: DataFrame) -> DataFrame:
    d = F.col("finish_checkpoint") - F.col("start_checkpoint")
    return activation.groupBy("trial_id").agg(F.min(d).alias("least"), F.max(d).alias("most"))


def diff_attributes(table: DataFrame, key: str, first: int, second: int, columns: list[str]) -> DataFrame:
    """(attribute, before, after) where two rows differ."""

    def tall(value: int, name: str) -> DataFrame:
        entries = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias(name)) for c in columns)))
        return table.where(F.col(key) == value).select(entries.alias("x")).select("x.*")

    return tall(first, "before").join(tall(second, "after"), "attribute").where("not (before <=> after)")


def diff_sets(table: DataFrame, first: int, second: int, name: str, key: list[str]) -> DataFrame:
    """(kind, name): rows added, removed, or replaced (removed and added under one name)."""
    side = lambda t: table.where(F.col("trial_id") == t).select(name, *key).distinct()
    added, removed = side(second).exceptAll(side(first)), side(first).exceptAll(side(second))
    a, r = added.groupBy(name).agg(F.count("*").alias("a")), removed.groupBy(name).agg(F.count("*").alias("r"))
    both = a.join(r, name, "full").select(F.col(name).alias("name"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("r", F.lit(0)).alias("r"))
    pairs = F.least("a", "r")
    kinds = F.array(F.struct(F.lit("replaced").alias("kind"), pairs.alias("n")), F.struct(F.lit("added").alias("kind"), (F.col("a") - pairs).alias("n")), F.struct(F.lit("removed").alias("kind"), (F.col("r") - pairs).alias("n")))
    return both.select("name", F.explode(kinds).alias("x")).select("name", "x.kind", "x.n").where("n > 0")


def next_notebooks(cells: DataFrame) -> DataFrame:
    """(id, other_id): each notebook and the next one."""
    ids = cells.select(F.col("notebook_id").alias("id")).distinct()
    return ids.join(ids.select((F.col("id") - 1).alias("id"), F.col("id").alias("other_id")), "id")


def lcs_lengths(cells: DataFrame) -> DataFrame:
    """(notebook_id, common): length of the longest common subsequence of roles of each notebook and the next one."""
    pairs = next_notebooks(cells)
    found = common_subsequences(cells.select(F.col("notebook_id").alias("id"), F.col("position").alias("place"), F.col("role").alias("value")), pairs)
    return pairs.join(found.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select(F.col("id").alias("notebook_id"), F.coalesce("n", F.lit(0)).cast("long").alias("common"))


def history_edges(trial: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, ancestor, distance): each kept trial's nearest kept ancestor."""
    up = ancestors(trial, "id", "parent_id").where("depth > 0")
    near = up.join(kept.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").join(kept.select(F.col("id").alias("node")), "node", "left_semi")
    return near.groupBy(F.col("node").alias("id")).agg(F.min_by("ancestor", "depth").alias("ancestor"), F.min("depth").alias("distance"))


def trial_distances(trial: DataFrame) -> DataFrame:
    return ancestors(trial, "id", "parent_id").where("depth > 0").select(F.col("node").alias("id"), "ancestor", F.col("depth").alias("distance"))


def history_by_version(tag: DataFrame) -> DataFrame:
    """Trials of automatic tags grouped by major and minor number."""
    group = F.array_join(F.slice(F.split("name", "\\."), 1, 2), ".")
    return tag.where("type = 'AUTO'").groupBy(group.alias("version")).agg(F.countDistinct("trial_id").alias("trials"), F.count("*").alias("tags"))


def access_edges(access: DataFrame) -> DataFrame:
    """(source, target): a node that reads points to the access, a written access to the node."""
    node, file = F.concat(F.lit("e_"), F.col("activation_id").cast("string")), F.concat(F.lit("a_"), F.col("id").cast("string"))
    return access.where(reads(F.col("mode"))).select(node.alias("source"), file.alias("target")).unionByName(access.where(writes(F.col("mode"))).select(file.alias("source"), node.alias("target")))


def name_synonyms(access: DataFrame) -> DataFrame:
    """Accesses of one name in a trial merged into the first."""
    return access.select("trial_id", "id", F.min("id").over(Window.partitionBy("trial_id", "name")).alias("synonym"))


def ranks(evaluation: DataFrame, component: DataFrame) -> DataFrame:
    """Per activation and line the nodes that a drawing aligns."""
    placed = evaluation.join(component.select(F.col("id").alias("code_component_id"), F.col("first_char_line").alias("line")), "code_component_id")
    return placed.groupBy("activation_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("nodes"))


def one_per_component(evaluation: DataFrame) -> DataFrame:
    """Loopless view: the first evaluation of each component in a trial."""
    return evaluation.groupBy("trial_id", "code_component_id").agg(F.min("id").alias("id"))


def propagated(dependency: DataFrame, hidden: DataFrame) -> DataFrame:
    """(source, target) edges once hidden evaluations (column id) are taken out and bridged."""
    from lineagraph.operators.closure import graph_closure

    edges = dependency.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node"))
    via = edges.join(hidden.select(F.col("id").alias("node")), "node", "left_semi")
    shown = edges.join(hidden.select(F.col("id").alias("node")), "node", "left_anti")
    start = shown.select(F.struct("node", "next_node").alias("src"), F.col("next_node").alias("node"))
    reached = graph_closure(start, via).select(F.col("src.node").alias("source"), F.col("node").alias("target"))
    return reached.join(hidden.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target").where("source <> target").distinct()


def prolog_facts(table: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Facts as text: numbers bare, strings quoted, nulls nil."""
    kinds = dict(table.dtypes)
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("\\'")), F.lit("'")) if kinds[c] == "string" else F.col(c).cast("string")
    args = F.concat_ws(", ", *(F.coalesce(quoted(c), F.lit("nil")) for c in columns))
    return table.select(F.concat(F.lit(name + "("), args, F.lit(").")).alias("fact"))


def prov_derivations(dependency: DataFrame) -> DataFrame:
    """PROV-N derivation statements, one a dependency."""
    return dependency.select(F.concat(F.lit("wasDerivedFrom(e"), F.col("dependent_id").cast("string"), F.lit(", e"), F.col("dependency_id").cast("string"), F.lit(", [type='"), F.col("type"), F.lit("'])")).alias("statement"))


def checkpoint_order(*points: DataFrame) -> DataFrame:
    """Per trial the rank of each distinct checkpoint of the tables (trial_id, checkpoint)."""
    distinct = reduce(DataFrame.unionByName, (p.select("trial_id", F.col("checkpoint").cast("long").alias("checkpoint")) for p in points)).distinct()
    return distinct.withColumn("place", F.dense_rank().over(Window.partitionBy("trial_id").orderBy("checkpoint")))


def definition_tree(component: DataFrame, syntax: list[str]) -> DataFrame:
    """(id, parent_id): each component but those of syntax types under the nearest such one around it."""
    kept = component.where(~F.col("type").isin(syntax))
    around = ancestors(component, "id", "container_id").where("depth > 0").join(kept.select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    nearest = around.groupBy(F.col("node").alias("id")).agg(F.min_by("ancestor", "depth").alias("parent_id"))
    return kept.select("id").join(nearest, "id", "left")


def history_group_distances(trial: DataFrame, tag: DataFrame) -> DataFrame:
    """(version, above, distance): the least number of steps from a trial of one version group up to one of another."""
    group = F.array_join(F.slice(F.split("name", "\\."), 1, 2), ".")
    groups = tag.where("type = 'AUTO'").select("trial_id", group.alias("version")).distinct()
    far = trial_distances(trial).join(groups.withColumnRenamed("trial_id", "id"), "id").join(groups.select(F.col("trial_id").alias("ancestor"), F.col("version").alias("above")), "ancestor")
    return far.where("version <> above").groupBy("version", "above").agg(F.min("distance").alias("distance"))


def diff_activations(pairs: DataFrame, report: DataFrame) -> DataFrame:
    """(id, other_id, attribute, before, after): what differs in the reports (id, ...) of two activations each."""
    columns = [c for c in report.columns if c != "id"]
    tall = lambda i, v: report.select(F.col("id").alias(i), F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias(v)) for c in columns))).alias("x")).select(i, "x.*")
    both = pairs.join(tall("other_id", "before"), "other_id").join(tall("id", "after"), ["id", "attribute"])
    return both.where("not (before <=> after)").select("id", "other_id", "attribute", "before", "after")


def side_by_side_values(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """(trial_id, other_id, place, mark, before, after): two trials' values (trial_id, place, value) line by line.

    The mark is ``=`` for equal lines, ``|`` for different ones, ``<`` and ``>`` where only the other
    or only the trial has one.
    """
    after = pairs.join(values, "trial_id").select("trial_id", "other_id", "place", F.col("value").alias("after"), F.lit(True).alias("in_a"))
    before = pairs.join(values.select(F.col("trial_id").alias("other_id"), "place", F.col("value").alias("before"), F.lit(True).alias("in_b")), "other_id").select("trial_id", "other_id", "place", "before", "in_b")
    mark = F.when(F.col("in_a").isNull(), "<").when(F.col("in_b").isNull(), ">").when(F.col("before").eqNullSafe(F.col("after")), "=").otherwise("|")
    return before.join(after, ["trial_id", "other_id", "place"], "full").select("trial_id", "other_id", "place", mark.alias("mark"), "before", "after")
