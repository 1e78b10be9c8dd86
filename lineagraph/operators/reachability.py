"""Reachability labels: whether one value derives from another, answered by joins instead of walks.

Strongly connected components become one node each, and the graph that is left is cut into chains of
edges. Who reaches a node of a chain reaches all after it, so of a chain only the first place reached
matters. ``stairs`` hold, for two chains, from which places of the one which places of the other are
reached; only steps that no other step makes needless are kept. A closure has a row for each two nodes
of a chain, the index one for each node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import settle, stored
from lineagraph.operators.closure import IDS_TOGETHER, graph_closure


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles with the least node of their strongly connected component.

    Every cycle has an edge to a node that is not smaller. The component of such an edge is what its
    end reaches and what reaches its start, so nothing is walked where all edges lead to smaller nodes.
    """
    back = settle(edges.where("node < next_node").distinct())
    if not back.limit(1).count():
        return back.select("node", F.col("node").alias("component")).limit(0)
    edge = F.struct("node", "next_node")
    reached = graph_closure(back.select(edge.alias("src"), F.col("next_node").alias("node")), edges)
    reaching = graph_closure(back.select(edge.alias("src"), "node"), edges.select(F.col("next_node").alias("node"), F.col("node").alias("next_node")))
    around = settle(reached.select("src", "node").join(reaching.select("src", "node"), ["src", "node"]))
    return settle(around.join(around.groupBy("src").agg(F.min("node").alias("component")), "src").groupBy("node").agg(F.min("component").alias("component")))


def linked(edges: DataFrame) -> DataFrame:
    """Edges (node, next_node) with ``link``: whether a chain goes along them, which is one edge at most into and out of a node."""
    chosen = F.col("next_node") == F.max("next_node").over(Window.partitionBy("node"))
    first = F.min(F.when(F.col("chosen"), F.col("node"))).over(Window.partitionBy("next_node"))
    return edges.withColumn("chosen", chosen).withColumn("link", F.col("chosen") & (F.col("node") == first)).drop("chosen")


def chains(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, chain, place): nodes of an acyclic graph in chains along links (node, next_node); a chain's last node has place 0, those before it -1, -2 and so on.

    Nodes that lead to the one before them in order make a run, found by a window; only the last nodes of
    runs that lead on are followed further.
    """
    near = F.shiftright("node", IDS_TOGETHER) if nodes.schema["node"].dataType.typeName() in ("long", "integer") else F.xxhash64("node")
    order = Window.partitionBy("near").orderBy("node")
    at = nodes.join(links, "node", "left").withColumn("near", near)
    at = at.withColumn("begins", F.coalesce(F.lag("node").over(order) != F.col("next_node"), F.lit(True)))
    at = at.withColumn("run", F.max(F.when(F.col("begins"), F.col("node"))).over(order))
    at = stored(at.select("node", "next_node", "begins", "run", (1 - F.row_number().over(Window.partitionBy("near", "run").orderBy("node"))).cast("long").alias("place")))
    on = at.where("begins and next_node is not null").select(F.col("node").alias("end"), F.col("next_node").alias("node"))
    on = settle(on.join(at.select("node", "run", "place"), "node").select(F.col("end").alias("node"), F.col("run").alias("chain"), (F.col("place") - 1).alias("place")))
    if not on.limit(1).count():
        return at.select("node", F.col("run").alias("chain"), "place")
    while True:  # each knows the end of a run so many runs on; pointers double
        further = on.select(F.col("node").alias("chain"), F.col("chain").alias("to"), F.col("place").alias("more"))
        on = settle(on.join(further, "chain", "left").select("node", F.coalesce("to", "chain").alias("chain"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("to").isNotNull().alias("moved")))
        moved = on.where("moved").limit(1).count()
        on = on.drop("moved")
        if not moved:
            break
    led = on.select(F.col("node").alias("run"), "chain", F.col("place").alias("more"))
    return at.join(led, "run", "left").select("node", F.coalesce("chain", "run").alias("chain"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))


def _needed(stairs: DataFrame) -> DataFrame:
    """Steps (chain, upto, to, since) but those for which a later place of the chain reaches as much or more."""
    later = Window.partitionBy("chain", "to").orderBy(F.col("upto").desc(), "since").rowsBetween(Window.unboundedPreceding, -1)
    return stairs.withColumn("least", F.min("since").over(later)).where("least is null or since < least").drop("least")


def _with_reach(points: DataFrame, stairs: DataFrame) -> DataFrame:
    """Points (chain, place, ...) with (to, since) of every other chain that their place reaches: one row a chain."""
    after = F.lag("upto").over(Window.partitionBy("chain", "to").orderBy("upto"))
    steps = stairs.withColumn("after", after)
    return points.join(steps, "chain").where("place <= upto and (after is null or place > after)").drop("upto", "after")


@dataclass
class Reachability:
    """``places`` (node, component, chain, place) of all nodes with edges, and ``stairs`` (chain, upto, to, since)."""

    places: DataFrame
    stairs: DataFrame

    def located(self, ids: DataFrame, name: str = "id") -> DataFrame:
        """Ids with their chain and place; one without edges is alone on its chain."""
        at = self.places.select(F.col("node").alias(name), "chain", "place")
        return ids.join(at, name, "left").withColumns({"chain": F.coalesce("chain", F.col(name)), "place": F.coalesce("place", F.lit(0))})

    def labels(self, seeds: DataFrame) -> DataFrame:
        """(id, chain, since): the chains that each seed (column id) reaches, and from which place on."""
        at = self.located(seeds.select("id").distinct())
        own = at.select("id", "chain", F.col("place").alias("since"))
        if not self.stairs.limit(1).count():
            return own
        return own.unionByName(_with_reach(at, self.stairs).select("id", F.col("to").alias("chain"), "since"))

    def pairs(self, seeds: DataFrame, targets: DataFrame) -> DataFrame:
        """(id, target_id): each seed with each target, but itself, that it derives from."""
        wanted = self.located(targets.select(F.col("id").alias("target_id")).distinct(), "target_id")
        return self.labels(seeds).join(wanted, "chain").where("place >= since and id <> target_id").select("id", "target_id")

    def counts(self, seeds: DataFrame, targets: DataFrame) -> DataFrame:
        """(id, targets): from how many of the targets, itself left out, each seed derives; pairs are not formed."""
        wanted = targets.select("id").distinct()
        marks = self.located(wanted).select("chain", F.col("place").alias("at"), F.lit(None).cast("long").alias("id"), F.lit(1).alias("n"))
        asked = self.labels(seeds).select("chain", F.col("since").alias("at"), F.col("id").cast("long").alias("id"), F.lit(0).alias("n"))
        after = Window.partitionBy("chain").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
        found = marks.unionByName(asked).withColumn("n", F.sum("n").over(after)).where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
        return found.join(wanted.withColumn("own", F.lit(1)), "id", "left").select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("targets"))

    def among(self, pairs: DataFrame) -> DataFrame:
        """Pairs (id, target_id) with ``derived``: whether the first derives from the second."""
        asked = pairs.select("id", "target_id").distinct()
        at = self.located(asked.select("target_id").distinct(), "target_id")
        reach = self.labels(asked)
        met = asked.join(at, "target_id").join(reach, ["id", "chain"], "left")
        return pairs.join(met.select("id", "target_id", F.coalesce((F.col("place") >= F.col("since")) & (F.col("id") != F.col("target_id")), F.lit(False)).alias("derived")), ["id", "target_id"])


def _placed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chains of an acyclic graph, and its edges with ``link``."""
    edges = stored(linked(edges))
    return stored(chains(nodes, edges.where("link").drop("link"))), edges


def reachability(dependency: DataFrame) -> Reachability:
    """The index of a dependency table (dependent_id, dependency_id)."""
    edges = stored(dependency.select(F.col("dependent_id").alias("node"), F.col("dependency_id").alias("next_node")).where("node <> next_node").distinct())
    component = cycles(edges)
    between, every = edges, edges.select("node").unionByName(edges.select(F.col("next_node").alias("node"))).distinct()
    if component.limit(1).count():
        end = component.select(F.col("node").alias("next_node"), F.col("component").alias("next_component"))
        between = edges.join(component, "node", "left").join(end, "next_node", "left")
        between = between.select(F.coalesce("component", "node").alias("node"), F.coalesce("next_component", "next_node").alias("next_node")).where("node <> next_node").distinct()
        every = stored(every.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        placed, between = _placed(every.select(F.col("component").alias("node")).distinct(), between)
        places = settle(every.join(placed.withColumnRenamed("node", "component"), "component").select("node", "component", "chain", "place"))
    else:
        placed, between = _placed(every, between)
        places = placed.select("node", F.col("node").alias("component"), "chain", "place")
    to = placed.select(F.col("node").alias("next_node"), F.col("chain").alias("to"), F.col("place").alias("since"))
    direct = between.where("not link").join(placed, "node").join(to, "next_node").where("chain <> to").select("chain", F.col("place").alias("upto"), "to", "since").distinct()
    direct = settle(_needed(direct))
    stairs = new = direct
    while new.limit(1).count():  # a round a chain that a way passes
        step = _with_reach(new.select(F.col("chain").alias("first"), "upto", F.col("to").alias("chain"), F.col("since").alias("place")).withColumnRenamed("upto", "from_upto"), direct)
        step = step.where("first <> to").select(F.col("first").alias("chain"), F.col("from_upto").alias("upto"), "to", "since", F.lit(True).alias("new"))
        merged = settle(_needed(stairs.withColumn("new", F.lit(False)).unionByName(step)))
        stairs, new = merged.drop("new"), merged.where("new").drop("new")
    return Reachability(places, stairs)
