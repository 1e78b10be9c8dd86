"""Whole reports of activations, names and docstrings of all models, bundles, created tags, named lineage and levels of a history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import settle
from lineagraph.operators.lineage import derivation
from lineagraph.operators.reachability import chains, linked

#: Longer values of a named lineage are replaced.
LONG_VALUE = 20


def _listed(rows: DataFrame, by: str, order: str, text: Column, name: str) -> DataFrame:
    """(by, name): the texts of each group in order, with semicolons."""
    held = F.array_sort(F.collect_list(F.struct(order, text.alias("text"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(held, lambda x: x["text"]), ";").alias(name))


def whole_report(activation: DataFrame, evaluation: DataFrame, component: DataFrame, block: DataFrame, access: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(id, name, line, start, finish, duration, a column for each of ``kinds``, return_value, hash, accesses).

    ``kinds`` names the component type of the evaluations that a column lists as ``name = value`` (globals,
    parameters, variables); the value of the last evaluation is returned; accesses come as ``mode name``.
    """
    named = evaluation.join(component.select(F.col("id").alias("code_component_id"), F.col("name").alias("of"), "type"), "code_component_id", "left")
    told = F.concat("of", F.lit(" = "), "repr")
    parts = [_listed(named.where(F.col("type") == kind), "activation_id", "id", told, column) for column, kind in kinds.items()]
    parts.append(evaluation.groupBy("activation_id").agg(F.max_by("repr", "id").alias("return_value")))
    parts.append(_listed(access, "activation_id", "id", F.concat_ws(" ", "mode", "name"), "accesses"))
    calls = activation.select("id", "name", "line", F.col("start_checkpoint").alias("start"), F.col("finish_checkpoint").alias("finish"), (F.col("finish_checkpoint") - F.col("start_checkpoint")).alias("duration"), "code_block_id")
    calls = calls.join(block.select(F.col("id").alias("code_block_id"), F.col("code_hash").alias("hash")), "code_block_id", "left").drop("code_block_id")
    whole = reduce(lambda a, b: a.join(b.withColumnRenamed("activation_id", "id"), "id", "left"), parts, calls)
    return whole.na.fill("", [*kinds, "hash", "accesses"])


def docstrings(block: DataFrame, activation: DataFrame, component: DataFrame) -> DataFrame:
    """(model, id, name, docstring): of code blocks, by their components' names, and of activations, by their own; evaluations have those of their calls."""
    own = block.join(component.select("id", "name"), "id").select("id", "name", "docstring")
    of_call = activation.select("id", "name", "code_block_id").join(block.select(F.col("id").alias("code_block_id"), "docstring"), "code_block_id").select("id", "name", "docstring")
    models = (("code_component", own), ("code_block", own), ("evaluation", of_call), ("activation", of_call))
    return reduce(DataFrame.unionByName, (t.select(F.lit(m).alias("model"), "id", "name", "docstring") for m, t in models))


def bundle_rows(tables: dict[str, DataFrame], links: dict[str, DataFrame], trials: DataFrame) -> DataFrame:
    """(table, trial_id, id): the rows of all tables that go with the trials (column trial_id).

    Tables have a trial_id, or are reached through ``links`` (trial_id, id): the rows that a trial uses.
    """
    rows = {n: t.select("trial_id", "id") for n, t in tables.items()} | {n: t.select("trial_id", "id").distinct() for n, t in links.items()}
    return reduce(DataFrame.unionByName, (t.join(trials.select("trial_id").distinct(), "trial_id", "left_semi").select(F.lit(n).alias("table"), "trial_id", F.col("id").cast("string").alias("id")) for n, t in rows.items()))


def created_tags(found: DataFrame, backup: Column) -> DataFrame:
    """(id, name): the automatic tag that each trial gets after the one (id, level, tag) found for it.

    After one of the same code and command the patch number goes up (level 1), after one of the same code the
    minor one (2), else the major one (3), which is x.0.0 for a backup; the first tag of all is 1.1.1 (0).
    """
    p = F.transform(F.split("tag", r"\."), lambda x: x.cast("int"))
    low = F.when(backup, 0).otherwise(1)
    parts = F.when(F.col("level") == 1, F.array(p[0], p[1], p[2] + 1)).when(F.col("level") == 2, F.array(p[0], p[1] + 1, F.lit(1))).when(F.col("level") == 3, F.array(p[0] + 1, low, low)).otherwise(p)
    return found.select("id", F.array_join(parts.cast("array<string>"), ".").alias("name"))


def named_dependencies(dependency: DataFrame, evaluation: DataFrame, component: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(trial_id, variable, number, name, value): what the last evaluation of each variable came by.

    Those on its way back that lead on by more than an argument are listed by distance and id, with long
    values replaced. Entries named like their value are left out, and so is one that repeats the
    entry before it. ``names`` (column variable) restricts the variables.
    """
    told = evaluation.join(component.select(F.col("id").alias("code_component_id"), "name"), "code_component_id").select("trial_id", "id", "name", "repr")
    last = told.groupBy("trial_id", F.col("name").alias("variable")).agg(F.max("id").alias("id"))
    seeds = last if names is None else last.join(names.select("variable").distinct(), "variable", "left_semi")
    leads = dependency.where("type <> 'argument'").select(F.col("dependent_id").alias("node")).distinct()
    value = F.when(F.char_length("repr") > LONG_VALUE, "complex data type").otherwise(F.col("repr"))
    entries = derivation(dependency, seeds).join(leads, "node", "left_semi").join(told.select(F.col("id").alias("node"), "name", value.alias("value")), "node").where("not (name <=> value)")
    order = Window.partitionBy("src").orderBy("depth", "node")
    before = F.lag(F.struct("name", "value")).over(order)
    kept = entries.withColumn("before", before).where(~F.struct("name", "value").eqNullSafe(F.col("before")))
    listed = kept.select("src", F.row_number().over(order).alias("number"), "name", "value")
    return listed.join(seeds.withColumnRenamed("id", "src"), "src").select("trial_id", "variable", "number", "name", "value")


def accesses_of_path(trial: DataFrame, module: DataFrame, access: DataFrame, suffix: str) -> DataFrame:
    """(trial_id, part, id, moment, path, hash): the script (part 0), modules (1) and contents before and after accesses (2) of paths with a suffix."""
    nothing = F.lit(None).cast("string")
    script = trial.select(F.col("id").alias("trial_id"), F.lit(0).alias("part"), F.col("id"), F.lit(0).alias("moment"), F.col("script").alias("path"), nothing.alias("hash"))
    modules = module.select("trial_id", F.lit(1).alias("part"), "id", F.lit(0).alias("moment"), F.col("name").alias("path"), F.col("code_hash").alias("hash"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("moment"), F.col("content_hash_before").alias("hash")), F.struct(F.lit(1).alias("moment"), F.col("content_hash_after").alias("hash"))))
    files = access.select("trial_id", F.lit(2).alias("part"), "id", F.col("name").alias("path"), both.alias("x")).select("trial_id", "part", "id", "x.moment", "path", "x.hash").where("hash is not null")
    return script.unionByName(modules).unionByName(files).where(F.col("path").endswith(suffix))


def history_levels(trial: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, script, level): the line on which a drawing of the history puts each trial (id, script).

    ``edges`` (id, parent) lead to the trial before. The newest of a trial's children goes on in its line if it is
    of the same script; every other trial begins a line of its script. Scripts with several trials lie above one
    another, that with the newest trial first, above a line for those with a single trial if there are such.
    """
    of = trial.select("id", "script").join(edges.select("id", "parent"), "id", "left")
    above = trial.select(F.col("id").alias("parent"), F.col("script").alias("parent_script"))
    newest = edges.groupBy("parent").agg(F.max("id").alias("newest"))
    placed = of.join(above, "parent", "left").join(newest, "parent", "left").withColumn("goes_on", F.coalesce((F.col("parent_script") == F.col("script")) & (F.col("newest") == F.col("id")), F.lit(False)))
    placed = settle(placed.select("id", "script", "parent", "goes_on"))
    lines = chains(placed.select(F.col("id").alias("node")), linked(placed.where("goes_on").select(F.col("id").alias("node"), F.col("parent").alias("next_node"))).where("link").drop("link"))
    begun = placed.where("not goes_on").select(F.col("id").alias("chain"), (F.row_number().over(Window.partitionBy("script").orderBy("id")) - 1).alias("lane"))
    scripts = placed.groupBy("script").agg(F.count("*").alias("n"), F.max("id").alias("newest"), F.sum(F.when(~F.col("goes_on"), 1).otherwise(0)).alias("lanes"))
    sized = scripts.withColumn("lanes", F.when(F.col("n") > 1, F.col("lanes")).otherwise(0))
    order = Window.orderBy(F.col("newest").desc())  # a row a script
    below = F.coalesce(F.sum("lanes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    singles = F.max(F.when(F.col("n") == 1, 1).otherwise(0)).over(Window.partitionBy())
    stacked = sized.select("script", F.when(F.col("n") > 1, below + singles).otherwise(0).alias("offset"))
    return placed.join(lines.withColumnRenamed("node", "id"), "id").join(begun, "chain").join(stacked, "script").select("id", "script", (F.col("lane") + F.col("offset")).cast("long").alias("level"))
