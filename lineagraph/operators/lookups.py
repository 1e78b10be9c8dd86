"""Lookups and small questions over provenance tables: each one projection, filter, join or window."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.operators.closure import ancestors


# --- rows and values ---


def point(table: DataFrame, **key) -> DataFrame:
    """The rows of one key; null is equal to null."""
    return reduce(lambda t, kv: t.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), key.items(), table)


def as_record(table: DataFrame, ignore: Iterable[str] = (), extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The extra columns first, then the table's own but for those ignored or replaced."""
    extra, ignore = dict(extra or {}), set(ignore)
    return table.select(*(c.alias(n) for n, c in extra.items()), *(c for c in table.columns if c not in ignore and c not in extra))


def is_local(path: Column, root: str) -> Column:
    """Relative, or below the root; false for null."""
    return F.coalesce(~path.startswith("/") | path.startswith(root), F.lit(False))


def between(spark: SparkSession, low: int, high: int) -> DataFrame:
    """(value): the whole numbers from low to high, both included."""
    return spark.range(low, high + 1).withColumnRenamed("id", "value")


def member(table: DataFrame, column: str, values: Sequence) -> DataFrame:
    """The rows whose column is one of the values."""
    return table.where(F.array_contains(F.array(*map(F.lit, values)), F.col(column)))


def once(table: DataFrame, solutions: DataFrame, on: str) -> DataFrame:
    """The rows with at least one solution, each once."""
    return table.join(solutions.select(on), on, "left_semi")


def moments(table: DataFrame, trial: DataFrame, checkpoint: str = "checkpoint") -> DataFrame:
    """(id, moment): the trial's start and as many seconds as the checkpoint says, in seconds since 1970."""
    starts = trial.select(F.col("id").alias("trial_id"), F.unix_timestamp("start").alias("began"))
    return table.join(starts, "trial_id").select("id", (F.col("began") + F.col(checkpoint)).cast("long").alias("moment"))


def moment_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def matches_moment(moment: Column, prefix: str) -> Column:
    """Whether the moment's text starts with a partial timestamp."""
    return moment_text(moment).startswith(prefix)


# --- trials, tags and files ---


def last_trial(trial: DataFrame, script: str, check: bool = False) -> DataFrame:
    """The trials that started when the script's last one did; with no such trial, when the last of all did, unless ``check``."""
    own, all_ = F.max(F.when(F.col("script") == script, F.col("start"))), F.max("start")
    latest = trial.agg((own if check else F.coalesce(own, all_)).alias("start"))
    return trial.join(F.broadcast(latest), "start", "left_semi")  # one row


def parent_for(trial: DataFrame, heads: DataFrame, script: str) -> DataFrame:
    """(id): the head (script, trial_id) of a script, else its last trial."""
    head = heads.where(F.col("script") == script).agg(F.max("trial_id").alias("head"))
    last = trial.where(F.col("script") == script).agg(F.max_by("id", F.struct("start", "id")).alias("last"))
    return head.crossJoin(last).select(F.coalesce("head", "last").alias("id"))  # a row each


def initial_activations(activation: DataFrame) -> DataFrame:
    """Per trial its main activation: the first that nothing called."""
    mains = activation.where("caller_id is null").groupBy("trial_id").agg(F.min(F.struct("id", "name")).alias("m"))
    return mains.select("trial_id", "m.id", "m.name")


def automatic_tags(trial: DataFrame, tag: DataFrame) -> DataFrame:
    """(id, level, tag): the greatest automatic tag of trials of the same script and command, else of the
    same script, else of all, as numbers; else 1.1.1 at level 0."""
    numbers = F.transform(F.split("name", "\\."), lambda x: x.cast("int"))
    tagged = tag.where("type = 'AUTO'").select("trial_id", numbers.alias("v")).join(trial.select(F.col("id").alias("trial_id"), "script", "command"), "trial_id")
    both = tagged.groupBy("script", "command").agg(F.max("v").alias("v1"))
    script = tagged.groupBy("script").agg(F.max("v").alias("v2"))
    found = trial.join(both, ["script", "command"], "left").join(script, "script", "left").crossJoin(F.broadcast(tagged.agg(F.max("v").alias("v3"))))  # one row
    level = F.when(F.col("v1").isNotNull(), 1).when(F.col("v2").isNotNull(), 2).when(F.col("v3").isNotNull(), 3).otherwise(0)
    best = F.coalesce("v1", "v2", "v3", F.array(F.lit(1), F.lit(1), F.lit(1)))
    return found.select("id", level.alias("level"), F.array_join(best.cast("array<string>"), ".").alias("tag"))


def files_at(access: DataFrame, moment: Column, prefix: str, nth: int) -> DataFrame:
    """(trial_id, name, hash): of each file its contents after the last access up to a moment, else the
    least ones with a hash prefix, else those after its n-th access."""
    place = F.row_number().over(Window.partitionBy("trial_id", "name").orderBy("checkpoint", "id"))
    by_time = F.max_by(F.when(F.col("checkpoint") <= moment, F.col("content_hash_after")), F.when(F.col("checkpoint") <= moment, F.struct("checkpoint", "id")))
    by_hash = F.min(F.when(F.col("content_hash_after").startswith(prefix), F.col("content_hash_after")))
    by_place = F.max(F.when(F.col("place") == nth, F.col("content_hash_after")))
    return access.withColumn("place", place).groupBy("trial_id", "name").agg(F.coalesce(by_time, by_hash, by_place).alias("hash"))


def first_access(access: DataFrame, name: str, prefix: str) -> DataFrame:
    """Per trial the first access to a file whose moment starts with a partial timestamp."""
    hits = access.where((F.col("name") == name) & matches_moment(F.col("checkpoint"), prefix))
    return hits.groupBy("trial_id").agg(F.min_by("id", F.struct("checkpoint", "id")).alias("id"))


def files_of_trials(access: DataFrame, trial: DataFrame, module: DataFrame) -> DataFrame:
    """(trial_id, name): files accessed (but the null device), the script and the modules, by their last part."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    files = access.where("name <> 'nul'").select("trial_id", last("name").alias("name"))
    return files.unionByName(trial.select(F.col("id").alias("trial_id"), F.col("script").alias("name"))).unionByName(module.select("trial_id", "name")).distinct()


def tag_values(attribute: DataFrame, name: str) -> DataFrame:
    """(trial_id, short, name, value) of one tag; short is the last five characters of the trial's id."""
    return attribute.where(F.col("name") == name).select("trial_id", F.expr("right(cast(trial_id as string), 5)").alias("short"), "name", "value")


def tag_plot(attribute: DataFrame, name: str, rows: int = 30) -> DataFrame:
    """The last rows of a tag, as numbers."""
    numbers = tag_values(attribute, name).select("trial_id", "short", F.col("value").cast("double").alias("value"))
    return numbers.orderBy(F.desc("trial_id"), "value").limit(rows)


def parent_differences(trial: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(trial_id, parent_id, code_component_id, before, after): components evaluated in a trial and in its parent, with their last values."""
    last = evaluation.groupBy("trial_id", "code_component_id").agg(F.max_by("repr", F.struct("checkpoint", "id")).alias("after"))
    before = last.select(F.col("trial_id").alias("parent_id"), "code_component_id", F.col("after").alias("before"))
    return last.join(trial.select(F.col("id").alias("trial_id"), "parent_id"), "trial_id").join(before, ["parent_id", "code_component_id"]).select("trial_id", "parent_id", "code_component_id", "before", "after")


# --- activations and components ---


def callers(activation: DataFrame) -> DataFrame:
    """(id, caller_id, caller, line): who called each activation, and where."""
    up = activation.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    return activation.join(up, "caller_id", "left").select("id", "caller_id", "caller", "line")


def folded_accesses(activation: DataFrame, access: DataFrame, max_depth: int) -> DataFrame:
    """(activation_id, accesses): accesses of activations down to a depth; those of deeper ones count for the ancestor at that depth."""
    up = ancestors(activation, "id", "caller_id")
    depth = up.groupBy("node").agg(F.max("depth").alias("own"))
    shown = up.join(depth, "node").where(F.col("depth") == F.greatest(F.lit(0), F.col("own") - max_depth)).select(F.col("node").alias("inner"), F.col("ancestor").alias("activation_id"))
    return access.select(F.col("activation_id").alias("inner")).join(shown, "inner").groupBy("activation_id").agg(F.count("*").alias("accesses"))


def block_parts(component: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(container_id, part, id): components of blocks whose type is one of the kinds (part -> type)."""
    return reduce(DataFrame.unionByName, (component.where((F.col("type") == t) & F.col("container_id").isNotNull()).select("container_id", F.lit(p).alias("part"), "id") for p, t in kinds.items()))


def compositions(component: DataFrame, without: Sequence[str]) -> DataFrame:
    """(whole_id, part_id): components in others, but for parts of some types and places of operators."""
    return component.where(~F.col("type").isin(list(without)) & ~F.col("type").endswith("op_pos") & F.col("container_id").isNotNull()).select(F.col("container_id").alias("whole_id"), F.col("id").alias("part_id"))


def parts_of_definitions(component: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The components whose container is a definition."""
    whole = component.where(F.col("type").isin(list(kinds))).select(F.col("id").alias("container_id"))
    return component.join(whole, "container_id", "left_semi").select("id", "name", "container_id")


def code_order(component: DataFrame) -> DataFrame:
    """(id, place): all components with a place in the code, numbered by line and column."""
    blocks = Window.partitionBy("first_char_line").orderBy("first_char_column", "id")
    sizes = component.where("first_char_line <> -1").groupBy("first_char_line").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("first_char_line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a line
    inside = component.where("first_char_line <> -1").withColumn("inside", F.row_number().over(blocks))
    return inside.join(sizes.select("first_char_line", before.alias("before")), "first_char_line").select("id", (F.col("before") + F.col("inside")).alias("place"))


def codes_in_lines(component: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Components that begin in a range of lines, or from a line on."""
    kept = component.where(F.col("first_char_line") >= first)
    return kept.select("id", "first_char_line") if last is None else kept.where(F.col("last_char_line") <= last).select("id", "first_char_line")


#: As many pairs of a try statement and its handler go to one task.
PAIRS_A_TASK = 4_000_000


def handlers(component: DataFrame, tries: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """(try_id, handler_id): handlers at the column of a try statement that begin after it and within its lines.

    Every such pair is asked for. Tries meet handlers line by line, so that no other pair is tried, and
    the tries of a line with many pairs are dealt to several tasks, each with the line's handlers.
    """
    at = ["first_char_column", "line"]
    lines = F.explode(F.expr("sequence(first_char_line + 1, last_char_line)"))
    outer = component.where(F.col("type").isin(list(tries)) & (F.col("last_char_line") > F.col("first_char_line"))).select(F.col("id").alias("try_id"), "first_char_column", lines.alias("line"))
    inner = component.where(F.col("type").isin(list(kinds))).select(F.col("id").alias("handler_id"), "first_char_column", F.col("first_char_line").alias("line"))
    met = outer.groupBy(*at).agg(F.count("*").alias("n")).join(inner.groupBy(*at).agg(F.count("*").alias("m")), at)
    met = stored(met.select(*at, F.ceil(F.col("n") * F.col("m") / PAIRS_A_TASK).cast("int").alias("parts"), (F.col("n") * F.col("m")).alias("pairs")))
    total = met.agg(F.sum("pairs").alias("pairs")).first().pairs or 0
    tasks = max(component.sparkSession.sparkContext.defaultParallelism, -(-total // PAIRS_A_TASK))
    dealt = outer.join(met, at).select("try_id", *at, F.pmod(F.xxhash64("try_id"), F.col("parts")).cast("int").alias("part"))
    shown = inner.join(met, at).select("handler_id", *at, F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    # a number of tasks that is named stays, where small inputs are put together otherwise
    dealt, shown = (x.repartition(tasks, *at, "part") for x in (dealt, shown))
    return dealt.hint("shuffle_hash").join(shown, [*at, "part"]).select("try_id", "handler_id")


def called_definitions(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """(call_id, definition_id): calls (id, name) whose text contains a definition's name (id, name).

    A call's parts of the lengths that names have are joined with the names, so no pairs are tried; a
    text gives as many rows as it has characters times lengths. Empty and null names are in no text.
    """
    lengths = definitions.where("name <> ''").agg(F.collect_set(F.length("name")).alias("lengths"))  # one row, one entry a length
    sized = calls.where("name <> ''").crossJoin(F.broadcast(lengths)).select(F.col("id").alias("call_id"), F.col("name").alias("text"), F.explode("lengths").alias("n")).where("n <= length(text)")
    parts = sized.select("call_id", F.explode(F.expr("transform(sequence(1, length(text) - n + 1), i -> substring(text, i, n))")).alias("name")).distinct()
    return parts.join(definitions.where("name <> ''").select(F.col("id").alias("definition_id"), "name"), "name").select("call_id", "definition_id")


# --- rules ---


def rule(of: Callable[..., DataFrame], **constants) -> Callable[..., DataFrame]:
    """A rule from a function of tables: its result can be called again with arguments that filter it."""

    def ask(*tables: DataFrame, **arguments) -> DataFrame:
        return point(of(*tables, **constants), **arguments)

    return ask


def restricted(ask: Callable[..., DataFrame], table: DataFrame, argument: str, options: Sequence) -> DataFrame:
    """The rule's solutions for each option of an argument; none for values that are no option."""
    if not options:
        return ask(table).where(F.lit(False))
    return reduce(DataFrame.unionByName, (ask(table, **{argument: o}) for o in options))


def lifted(lists: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """(id, values): a lookup applied to each element of the lists (id, keys), in order."""
    each = lists.select("id", F.posexplode("keys").alias("place", key)).join(table.select(key, F.col(value).alias("found")), key)
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "found"))), lambda x: x["found"]).alias("values"))


def with_name(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows (id, ...) with the names of their ids."""
    return rows.join(named.select("id", "name"), "id")


def successor_names(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """(before, after): the names of pairs of ids, once each."""
    first, second = (named.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("before", "after"))
    return pairs.join(first, "before").join(second, "after").select(F.col("before_name").alias("before"), F.col("after_name").alias("after")).distinct()


def access_stacks(activation: DataFrame, access: DataFrame) -> DataFrame:
    """(id, stack): the activation of each access and its callers, the nearest first."""
    up = ancestors(activation, "id", "caller_id")
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x["ancestor"].cast("string")), ",")
    stacks = up.groupBy(F.col("node").alias("activation_id")).agg(chain.alias("stack"))
    return access.select("id", "activation_id").join(stacks, "activation_id").select("id", "stack")


# --- dataflow ---


def node_shapes(activation: DataFrame, evaluation: DataFrame, max_depth: int) -> DataFrame:
    """(id, shape): an activation is a leaf without evaluations in it, or where the next depth is hidden; else a cluster."""
    depth = ancestors(activation, "id", "caller_id").groupBy(F.col("node").alias("id")).agg(F.max("depth").alias("depth"))
    inner = evaluation.select(F.col("activation_id").alias("id")).distinct().withColumn("inner", F.lit(True))
    leaf = F.col("inner").isNull() | (F.col("depth") + 1 > max_depth)
    return depth.join(inner, "id", "left").select("id", F.when(leaf, "leaf").otherwise("cluster").alias("shape"))


def graph_edges(dependency: DataFrame, versions: DataFrame) -> DataFrame:
    """(source_id, target_id, type, key): dependencies and members with their attributes."""
    used = dependency.select(F.col("dependent_id").alias("source_id"), F.col("dependency_id").alias("target_id"), "type", F.lit(None).cast("string").alias("key"))
    return used.unionByName(versions.select(F.col("collection_id").alias("source_id"), F.col("member_id").alias("target_id"), F.lit("member").alias("type"), "key"))


def shown_edges(edges: DataFrame, root: int) -> DataFrame:
    """The edges but for loops, those of arguments and those at the script's own node."""
    return edges.where((F.col("source_id") != F.col("target_id")) & (F.col("type") != "argument") & (F.col("source_id") != root) & (F.col("target_id") != root))


def synonyms(evaluation: DataFrame, *choices: DataFrame) -> DataFrame:
    """(id, synonym): the first of the choices (id, synonym) that has another node for it, else itself."""
    out, names = evaluation.select("id"), []
    for i, c in enumerate(choices):
        out = out.join(c.select("id", F.col("synonym").alias(f"s{i}")), "id", "left")
        names.append(F.when(F.col(f"s{i}") != F.col("id"), F.col(f"s{i}")))
    return out.select("id", F.coalesce(*names, "id").alias("synonym"))


def visible(nodes: DataFrame, *conditions: Column) -> DataFrame:
    """The nodes that meet all conditions; an unknown one does not hold."""
    return nodes.where(reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(True)))


def node_names(evaluation: DataFrame, component: DataFrame, activation: DataFrame) -> DataFrame:
    """(id, name): a component's name; that of the activation where an evaluation is the first of one."""
    first = evaluation.groupBy("activation_id").agg(F.min("id").alias("id")).join(activation.select(F.col("id").alias("activation_id"), F.col("name").alias("call")), "activation_id").select("id", "call")
    named = evaluation.select("id", "code_component_id").join(component.select(F.col("id").alias("code_component_id"), "name"), "code_component_id")
    return named.join(first, "id", "left").select("id", F.coalesce("call", "name").alias("name"))


# --- summaries and differences ---



def side_by_side(**columns: DataFrame) -> DataFrame:
    """(key, place, and a column each): the values of tables (key, value), sorted by value and put beside each other."""
    place = F.row_number().over(Window.partitionBy("key").orderBy("value"))
    parts = [t.withColumn("place", place).withColumnRenamed("value", n) for n, t in columns.items()]
    return reduce(lambda a, b: a.join(b, ["key", "place"], "full"), parts)


def history_nodes(trial: DataFrame, tag: DataFrame, status: str, script: str) -> DataFrame:
    """(id, script, tag): trials of a status (``*``: any) and a script pattern, with the greatest of their tags."""
    kept = trial.where((F.lit(status) == "*") | (F.col("status") == status)).where(F.col("script").like(script.replace("*", "%")))
    tags = tag.groupBy(F.col("trial_id").alias("id")).agg(F.max("name").alias("tag"))
    return kept.join(tags, "id", "left").select("id", "script", F.coalesce("tag", F.lit("")).alias("tag"))
