"""Transitive closures by semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import settle, stored  # noqa: F401 (tests count what both keep)


def graph_closure(seeds: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("node",), most_rounds: int | None = None, one_seed: bool = False) -> DataFrame:
    """Rows (src, *keys, depth) reachable from seeds (src, *keys); edges are (*keys, *next_keys).

    Each round joins the last frontier with the edges and keeps what was not seen; all seeds run
    together. Cycles end because visited rows are taken out. Where each node has one edge at most, and all
    lead to smaller nodes or all to larger ones, no row is reached twice, and paths are made first.
    ``one_seed`` says that each source is its own only seed, so that none has to be looked for twice.
    """
    if keys == ("node",) and (turned := _one_direction(edges)) is not None:
        turn = (lambda df, *names: df.withColumns({n: F.bitwise_not(n) for n in names})) if turned else (lambda df, *names: df)
        ways = stored(_ways(turn(edges.select("node", "next_node"), "node", "next_node")))
        if not ways.where("twice").limit(1).count():
            return turn(_along_only_ways(turn(seeds.select("src", "node"), "node"), ways, most_rounds, one_seed), "node")
    edges = stored(edges)
    nexts = [f"next_{k}" for k in keys]
    frontier = stored(seeds.select("src", *keys).distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0  # the settled frontiers of all rounds; none is written twice
    while most_rounds is None or depth < most_rounds:
        depth += 1
        step = frontier.select("src", *keys).join(edges, list(keys)).select("src", *(F.col(n).alias(k) for n, k in zip(nexts, keys))).distinct()
        step = step.join(seen.select("src", *keys), ["src", *keys], "left_anti").withColumn("depth", F.lit(depth))
        frontier = stored(step)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if depth % UNIONED == 0:
            seen = stored(seen)
    return seen


#: Steps that are laid down with a node, and ids (a power of two) that are put in order together.
STEPS, IDS_TOGETHER = 32, 16


def _one_direction(edges: DataFrame) -> bool | None:
    """False if all edges lead to smaller nodes, True if all lead to larger ones (whole numbers only), else None."""
    up = F.coalesce(F.col("next_node") > F.col("node"), F.lit(True))
    down = F.coalesce(F.col("next_node") < F.col("node"), F.lit(True))
    if edges.where("node is null or next_node is null or node = next_node").limit(1).count():
        return None
    found = edges.agg(F.bool_or(up).alias("up"), F.bool_or(down).alias("down")).first()
    if not found.up:
        return False
    whole = all(edges.schema[n].dataType.typeName() in ("long", "integer") for n in ("node", "next_node"))
    return True if whole and not found.down else None


def _ways(edges: DataFrame) -> DataFrame:
    """(node, path, end, twice): up to ``STEPS`` steps from each node on, the last of them, and whether the node has another edge.

    Nodes that lead to the one before them in order make a run, and the steps of a run come from a
    window. What a run leads to is joined later, so nodes in any order give the same result.
    """
    near = F.shiftright("node", IDS_TOGETHER) if edges.schema["node"].dataType.typeName() in ("long", "integer") else F.xxhash64("node")
    edges = edges.withColumn("near", near).repartition("near").distinct()
    order = Window.partitionBy("near").orderBy("node", "next_node")
    before = F.lag("node").over(order)
    rows = edges.withColumns({"begins": F.coalesce(before != F.col("next_node"), F.lit(True)), "twice": F.coalesce(before == F.col("node"), F.lit(False))})
    rows = rows.withColumn("run", F.max(F.when(F.col("begins"), F.col("node"))).over(order))
    laid = F.collect_list("next_node").over(Window.partitionBy("near", "run").orderBy("node").rowsBetween(1 - STEPS, 0))
    return rows.select("node", F.reverse(laid).alias("path"), "twice").withColumn("end", F.element_at("path", -1))


def _along_only_ways(seeds: DataFrame, ways: DataFrame, most_rounds: int | None, one_seed: bool) -> DataFrame:
    """The closure where each node has one way on: paths of the seeds, and of the ends that lead on; a round leads twice as far along these."""
    seeds = (seeds.select(F.col("src").alias("node")).distinct().select(F.col("node").alias("src"), "node") if one_seed else seeds.distinct()).withColumns({"depth": F.lit(0), "own": F.lit(True)})
    tops, jump, width = seeds, stored(_leading_on(ways)), 1
    if jump.limit(1).count():
        reach = seeds.join(ways, "node").select("src", F.col("end").alias("node"), F.size("path").alias("depth"))
        reach = stored(reach.join(jump.select("node"), "node", "left_semi"))
        while jump.limit(1).count() and (most_rounds is None or width <= most_rounds):
            on = reach.join(jump, "node").select("src", F.col("to").alias("node"), (F.col("depth") + F.col("steps")).alias("depth"))
            reach = stored(reach.unionByName(on if most_rounds is None else on.where(F.col("depth") <= most_rounds)))
            jump = stored(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more")), "to").select("node", F.col("next").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
            width *= 2
        tops = seeds.unionByName(reach.withColumn("own", F.lit(False)))
    path = F.coalesce("path", F.array().cast(ways.schema["path"].dataType))
    listed = tops.join(ways.select("node", "path"), "node", "left").select("src", "depth", "own", F.posexplode(F.when(F.col("own"), F.concat(F.array("node"), path)).otherwise(path)).alias("at", "node"))
    out = listed.select("src", "node", (F.col("depth") + F.col("at") + F.when(F.col("own"), 0).otherwise(1)).alias("depth"))
    out = out if most_rounds is None else out.where(F.col("depth") <= most_rounds)
    if not one_seed and seeds.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():  # seeds of one source may meet
        out = out.groupBy("src", "node").agg(F.min("depth").alias("depth"))
    return out


def _leading_on(ways: DataFrame) -> DataFrame:
    """(node, to, steps): of the ends of paths those that lead on, with the ends of theirs."""
    ends = ways.select(F.col("end").alias("node")).distinct()
    return ways.select("node", F.col("end").alias("to"), F.size("path").alias("steps")).join(ends, "node", "left_semi")


#: Long walks: after so many rounds the frontiers become one table, so that plans stay small.
UNIONED = 16

#: Deeper paths may be endless: from there on, pairs are kept once, and no new ones end the rounds.
DEEP = 64


def ancestors(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, depth) of a forest, each node its own ancestor at depth 0; paths double each round.

    Cycles end: an ancestor has its least depth, and a node on a cycle is its own ancestor at depth 0 only.
    """
    pairs = stored(tree.select(F.col(node).alias("node"), F.col(parent).alias("up")).distinct())
    out = pairs.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    jump = pairs.where("up is not null").select("node", F.col("up").alias("ancestor"), F.lit(1).alias("depth"))
    reach, width, known = jump, 1, None
    while True:  # reach holds all ancestors at depths 1 to width, jump those at exactly width
        if width > DEEP:
            reach = reach.where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
        reach, jump = stored(reach), stored(jump)
        if not jump.limit(1).count():
            break
        if width > DEEP:
            now = reach.count()
            if now == known:
                break
            known = now
        mid = jump.select("node", F.col("ancestor").alias("mid"))
        up = reach.select(F.col("node").alias("mid"), "ancestor", "depth")
        reach = reach.unionByName(mid.join(up, "mid").select("node", "ancestor", (F.col("depth") + width).alias("depth")))
        jump = mid.join(jump.select(F.col("node").alias("mid"), "ancestor"), "mid").select("node", "ancestor").distinct().withColumn("depth", F.lit(2 * width))
        width *= 2
    return out.unionByName(reach)
