"""Lineage: versioned members as of a moment, and what a value derives from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.operators.closure import UNIONED, ancestors, graph_closure, settle  # noqa: F401 (tests count what it keeps)
from lineagraph.operators.reachability import reachability


def members_as_of(member: DataFrame, moment: Column) -> DataFrame:
    """(collection_id, key, member_id): the latest member of each key up to a moment."""
    return member.where(F.col("checkpoint") <= moment).groupBy("collection_id", "key").agg(F.max_by("member_id", F.struct("checkpoint", "member_id")).alias("member_id"))


def members_at(member: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per context (collection_id, checkpoint) the state of its collection: (collection_id, at, key, member_id).

    Contexts and versions of one key are put in one order and the last version before is carried on,
    so the work grows with versions and result, not with versions times contexts.
    """
    at = contexts.select("collection_id", F.col("checkpoint").alias("at")).distinct()
    asked = at.join(member.select("collection_id", "key").distinct(), "collection_id").select("collection_id", "key", "at", F.lit(True).alias("asks"), F.lit(None).cast(member.schema["member_id"].dataType).alias("member_id"))
    versions = member.select("collection_id", "key", F.col("checkpoint").alias("at"), F.lit(False).alias("asks"), "member_id")
    before = Window.partitionBy("collection_id", "key").orderBy("at", "asks", "member_id").rowsBetween(Window.unboundedPreceding, 0)
    carried = asked.unionByName(versions).withColumn("member_id", F.last("member_id", ignorenulls=True).over(before))
    return carried.where("asks and member_id is not null").select("collection_id", "at", "key", "member_id")


def derivation(dependency: DataFrame, seeds: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(src, node, depth): what each seed (column id) derives from along all dependencies."""
    edges = dependency.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node"))
    return graph_closure(seeds.select(F.col("id").alias("src"), F.col("id").alias("node")), edges, most_rounds=most_rounds, one_seed=True)


def was_derived_from(dependency: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, targets): per seed from how many of the targets (column id) it derives, itself left out."""
    return reachability(dependency).counts(seeds, targets)


def derived_pairs(dependency: DataFrame, seeds: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target_id): each seed with each target that it derives from, itself left out."""
    return reachability(dependency).pairs(seeds, targets)


def derived_from_all(dependency: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, derived): whether a value derives from each of the targets that it is asked for (id, target_id)."""
    return reachability(dependency).among(wanted).groupBy("id").agg(F.bool_and("derived").alias("derived"))


def only_derived(evaluation: DataFrame, dependency: DataFrame, seeds: DataFrame) -> DataFrame:
    """The evaluations that a seed (column id) derives from, the seeds included."""
    return evaluation.join(derivation(dependency, seeds).select(F.col("node").alias("id")).distinct(), "id", "left_semi")


def numbered_dependencies(dependency: DataFrame, seeds: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Backward dependencies of each seed, numbered by distance and id."""
    found = derivation(dependency, seeds).where("depth > 0").join(evaluation.select(F.col("id").alias("node"), "repr"), "node")
    return found.select("src", "node", "repr", F.row_number().over(Window.partitionBy("src").orderBy("depth", "node")).alias("number"))


def member_intervals(member: DataFrame) -> DataFrame:
    """Each version of a collection's key with the moment from which and until which it holds."""
    until = F.lead("checkpoint").over(Window.partitionBy("collection_id", "key").orderBy("checkpoint", "member_id"))
    return member.select("collection_id", "member_id", F.col("checkpoint").alias("since"), until.alias("until"))


def derivation_through_members(member: DataFrame, seeds: DataFrame, dependency: DataFrame | None = None) -> DataFrame:
    """(src, node, at): what each context (src, node, at) derives from, a collection by its members as of ``at``.

    The moment travels with the context, so a node is visited once per moment. Dependencies, if
    given, lead to their source at the same moment. Only contexts that something leads on from take
    part in the rounds; what all of them lead to is taken once, at the end.
    """
    keys = ["src", "node", "at"]
    versions = stored(member_intervals(member))
    edges = None if dependency is None else stored(dependency.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node")).distinct())
    leads = versions.select(F.col("collection_id").alias("node"))
    leads = stored((leads if edges is None else leads.unionByName(edges.select("node"))).distinct())
    onward = lambda rows, node: rows.join(leads.withColumnRenamed("node", node), node, "left_semi")

    def steps(walk: DataFrame, versions: DataFrame, edges: DataFrame | None) -> DataFrame:
        inside = walk.join(versions, F.col("node") == F.col("collection_id")).where("since <= at and (until is null or at < until)")
        found = inside.select("src", F.col("member_id").alias("node"), "at")
        return found if edges is None else found.unionByName(walk.join(edges, "node").select("src", F.col("next_node").alias("node"), "at"))

    start = stored(seeds.select(*keys).distinct())
    frontier = stored(onward(start, "node").select(*keys))
    seen, rounds = frontier, 0
    inner = stored(onward(versions, "member_id")), None if edges is None else stored(onward(edges, "next_node"))
    while frontier.limit(1).count():
        frontier = stored(steps(frontier, *inner).distinct().join(seen, keys, "left_anti"))
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % UNIONED == 0:
            seen = stored(seen)
    return start.unionByName(steps(seen, versions, edges)).distinct()


def navigate(
    evaluation: DataFrame,
    dependency: DataFrame,
    seeds: DataFrame,
    member: DataFrame | None = None,
    called: DataFrame | None = None,
    arguments: bool = True,
    stop_on: DataFrame | None = None,
) -> DataFrame:
    """(src, node, at, is_call): the contexts that each seed (src, node) reaches along dependencies and members.

    A dependency leads to its source at that evaluation's own moment, a member of a collection keeps the
    moment of the context, as which the collection is read. ``called`` (id, call_id) adds the calls that
    evaluations made, from which no step goes on. Argument dependencies are left out without ``arguments``.
    A source leaves the walk once it has reached all it has in ``stop_on`` (src, node); its other contexts
    are then those of the rounds so far. A seed is not reached by standing at it.
    """
    own = stored(evaluation.select("id", F.col("checkpoint").alias("own")))
    kept = dependency if arguments else dependency.where("type <> 'argument'")
    blank = F.lit(None).cast(own.schema["own"].dataType)
    # what leads on from a node: with the next one's own moment, or with that of the context as long as a version holds
    ways = kept.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("id")).distinct().join(own, "id")
    ways = ways.select("node", F.col("id").alias("next_node"), F.col("own").alias("next_at"), blank.alias("since"), blank.alias("until"))
    if member is not None:
        versions = member_intervals(member).where("since is not null").select(F.col("collection_id").alias("node"), F.col("member_id").alias("next_node"), blank.alias("next_at"), "since", "until")
        ways = ways.unionByName(versions)
    ways = stored(ways)
    keys = ["src", "node", "at"]
    start = seeds.select("src", F.col("node").alias("id")).distinct().join(own, "id")
    frontier = stored(start.select("src", F.col("id").alias("node"), F.col("own").alias("at")))
    seen, rounds = frontier, 0
    of_calls = None if called is None else stored(called.select(F.col("id").alias("node"), "call_id").join(own.withColumnRenamed("id", "call_id"), "call_id"))
    made_calls = lambda walk: walk.join(of_calls, "node").select("src", F.col("call_id").alias("node"), F.col("own").alias("at")).distinct()
    calls = None  # no step goes on from them, so where all walk to the end they are made once
    open_ = None if stop_on is None else stored(stop_on.select("src", "node").distinct())  # what is still to be reached
    asked = None if open_ is None else open_.select("src").distinct()
    while True:
        walk = frontier
        if open_ is not None:
            if rounds:
                reached = frontier.select("src", "node") if calls is None else frontier.select("src", "node").unionByName(calls.select("src", "node"))
                open_ = stored(open_.join(reached, ["src", "node"], "left_anti"))
            walk = stored(walk.join(asked.join(open_, "src", "left_anti"), "src", "left_anti"))
        if of_calls is not None and open_ is not None:
            made = stored(made_calls(walk))
            calls = made if calls is None else calls.unionByName(made)
        step = walk.join(ways, "node").where("since is null or since <= at and (until is null or at < until)")
        step = step.select("src", F.col("next_node").alias("node"), F.when(F.col("since").isNull(), F.col("next_at")).otherwise(F.col("at")).alias("at"))
        frontier = stored(step.distinct().join(seen, keys, "left_anti"))
        if not frontier.limit(1).count():
            break
        seen, rounds = seen.unionByName(frontier), rounds + 1
        if rounds % UNIONED == 0:
            seen = stored(seen)
    found = seen.withColumn("is_call", F.lit(False))
    if of_calls is None:
        return found
    return found.unionByName((made_calls(seen) if calls is None else calls.distinct()).withColumn("is_call", F.lit(True)))


def marked_edges(dependency: DataFrame, visited: DataFrame) -> DataFrame:
    """(source_id, target_id, type, visited): all dependencies, and whether a walk (column node) came by their source."""
    by = visited.select(F.col("node").alias("source_id")).distinct().withColumn("by", F.lit(True))
    edges = dependency.select(F.col("dependent_id").alias("source_id"), F.col("dependency_id").alias("target_id"), "type")
    return edges.join(by, "source_id", "left").select("source_id", "target_id", "type", F.col("by").isNotNull().alias("visited"))


def contributing_cells(evaluation: DataFrame, dependency: DataFrame, component: DataFrame, seeds: DataFrame, cell_type: str) -> DataFrame:
    """(trial_id, cell_id): the cells that contribute to the seeds (column id).

    A seed's lineage leads to cells, all evaluations of a cell in the trial count as well, and so on. A
    component's cell is the nearest component of the cell type around it or itself.
    """
    cell = ancestors(component, "id", "container_id").join(component.where(F.col("type") == cell_type).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    cell = cell.groupBy(F.col("node").alias("code_component_id")).agg(F.min_by("ancestor", "depth").alias("cell_id"))
    inside = stored(evaluation.select("trial_id", "id", "code_component_id").join(cell, "code_component_id").select("trial_id", "id", "cell_id"))

    def whole(rows: DataFrame, value: str, named: str = "") -> DataFrame:
        # a value in a cell stands for the cell, as each leads to the other
        of = rows.join(inside.withColumnRenamed("id", value), ["trial_id", value], "left")
        return of.withColumns({f"{named}in_cell": F.col("cell_id").isNotNull(), f"{named}node": F.coalesce(F.col("cell_id").cast("long"), F.col(value).cast("long"))}).drop(value, "cell_id")

    values = evaluation.select("trial_id", F.col("id").alias("dependent_id"))
    derived = dependency.select("trial_id", "dependent_id", "dependency_id").join(values, ["trial_id", "dependent_id"], "left_semi")
    edges = whole(whole(derived, "dependent_id"), "dependency_id", "next_").withColumn("next_trial_id", F.col("trial_id"))
    edges = edges.where("in_cell <> next_in_cell or node <> next_node").distinct()
    start = whole(evaluation.select("trial_id", "id").join(seeds.select("id"), "id", "left_semi"), "id").withColumn("src", F.col("trial_id"))
    reached = graph_closure(start, edges, ("trial_id", "in_cell", "node"))
    return reached.where("in_cell").select("trial_id", F.col("node").alias("cell_id"))
