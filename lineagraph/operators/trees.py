"""Ordered trees as rows: numbers in one walk order, equal subtrees, and nodes merged under merged parents.

Nothing here walks a tree in one task: a level of all trees is one join, and what a subtree adds up to
or what leads to a node is handed up or down by levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored

TREE = ["tree_id", "parent_id"]


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Roots, their children, and so on. Nodes on or below a cycle are on no level."""
    at = stored(nodes.where("parent_id is null"))
    levels = []
    while at.limit(1).count():
        levels.append(at)
        at = stored(nodes.join(at.select("tree_id", F.col("id").alias("parent_id")), TREE))
    return levels


def _shape(k: int) -> Column:
    return F.xxhash64(F.lit(k), "label", "n_children", f"x{k}")


def numbered(nodes: DataFrame, alike: bool = True) -> DataFrame:
    """Nodes (tree_id, id, parent_id, place, label) of ordered forests with their numbers.

    ``child``: place among siblings (and among roots) from 0, by (place, id); ``depth``; ``size``: nodes of the
    subtree; ``enter``: place in pre-order, so that a subtree is enter to enter + size - 1; ``lines`` and
    ``line``: how many lines a node writes with all below it, and where, if each writes ``opens`` lines
    before and ``closes`` lines after what is below it (columns of nodes; else one and none);
    ``n_children``; ``s1``, ``s2``: equal for subtrees of equal labels in equal order; ``l1``, ``l2`` and
    ``e1``, ``e2``: equal for nodes with the same labels, or the same subtrees, from the root down. Without
    ``alike`` the last six are left out.
    """
    siblings = Window.partitionBy(*TREE)
    written = [F.col("opens").cast("long"), F.col("closes").cast("long")] if "opens" in nodes.columns else [F.lit(n).cast("long").alias(c) for c, n in (("opens", 1), ("closes", 0))]
    nodes = stored(nodes.select("tree_id", "id", "parent_id", "label", *written, (F.row_number().over(siblings.orderBy("place", "id")) - 1).alias("child")))
    levels = _levels(nodes)
    if not levels:
        blank = {"size": "long", "lines": "long", "line": "long", "n_children": "long", "s1": "long", "s2": "long", "depth": "int", "enter": "long", "l1": "long", "l2": "long", "e1": "long", "e2": "long"}
        return nodes.withColumns({c: F.lit(0).cast(t) for c, t in blank.items() if alike or c[0] not in "sle" or c in ("size", "lines", "line", "enter")})
    twice = (1, 2) if alike else ()  # each hash is kept twice, with two seeds
    sized: list[DataFrame] = []
    for level in reversed(levels):
        if sized:
            whole = sized[-1].groupBy("tree_id", F.col("parent_id").alias("id")).agg(F.sum("size").alias("below"), F.sum("lines").alias("inside"), F.count("*").alias("n_children"), *(F.bit_xor(F.xxhash64("child", f"s{k}")).alias(f"x{k}") for k in twice))
            level = level.join(whole, ["tree_id", "id"], "left").na.fill(0, ["below", "inside", "n_children", *(f"x{k}" for k in twice)])
        else:
            level = level.withColumns({c: F.lit(0).cast("long") for c in ("below", "inside", "n_children", *(f"x{k}" for k in twice))})
        sized.append(stored(level.select("tree_id", "id", "parent_id", "label", "child", "opens", "closes", (F.col("below") + 1).alias("size"), (F.col("opens") + F.col("inside") + F.col("closes")).alias("lines"), "n_children", *(_shape(k).alias(f"s{k}") for k in twice))))
    earlier = lambda c: F.coalesce(F.sum(c).over(siblings.orderBy("child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out, above = None, None
    for depth, level in enumerate(reversed(sized)):
        level = level.withColumns({"before": earlier("size"), "written": earlier("lines"), "depth": F.lit(depth)})
        if above is None:
            led = level.withColumns({c: F.lit(0).cast("long") for c in ("from", "from_line")} | {f"{c}{k}": F.lit(0).cast("long") for c in "pq" for k in twice})
        else:
            led = level.join(above.select("tree_id", F.col("id").alias("parent_id"), (F.col("enter") + 1).alias("from"), (F.col("line") + F.col("opens")).alias("from_line"), *(F.col(f"{old}{k}").alias(f"{new}{k}") for old, new in (("l", "p"), ("e", "q")) for k in twice)), TREE)
        paths = {f"l{k}": F.xxhash64(F.lit(k), f"p{k}", "label") for k in twice} | {f"e{k}": F.xxhash64(F.lit(k), f"q{k}", "s1", "s2") for k in twice}
        above = stored(led.withColumns({"enter": F.col("from") + F.col("before"), "line": F.col("from_line") + F.col("written")} | paths).drop("from", "before", "from_line", "written", "p1", "p2", "q1", "q2"))
        out = above if out is None else out.unionByName(above)
    return out


def label_paths(nodes: DataFrame) -> DataFrame:
    """(tree_id, id, path): the labels from the root down, joined by slashes."""
    nodes = stored(nodes.select("tree_id", "id", "parent_id", "label"))
    at = stored(nodes.where("parent_id is null").select("tree_id", "id", F.col("label").alias("path")))
    out = at
    while at.limit(1).count():
        above = at.select("tree_id", F.col("id").alias("parent_id"), F.col("path").alias("above"))
        at = stored(nodes.join(above, TREE).select("tree_id", "id", F.concat_ws("/", "above", "label").alias("path")))
        out = out.unionByName(at)
    return out


#: How nodes are told apart under one merged parent: not at all, by equal subtrees, or by label.
MODES = {"no_match": ("tree_id", "id"), "exact_match": ("tree_id", "e1", "e2"), "namespace_match": ("tree_id", "l1", "l2")}


def merged(tree: DataFrame, mode: str) -> DataFrame:
    """Numbered nodes with ``node``, the first one (in pre-order) of those that are merged with it, and ``is_first``."""
    alike = Window.partitionBy(*MODES[mode])
    first = F.min(F.struct("enter", "id")).over(alike)["id"]
    return tree.withColumn("node", first).withColumn("is_first", F.col("node") == F.col("id"))


def merged_nodes(with_node: DataFrame, values: DataFrame) -> DataFrame:
    """(tree_id, node, parent, calls, duration, ids, tooltip) of merged nodes.

    ``values`` (id, duration, note) says how long each took and what to show of it; ids and notes come in
    pre-order.
    """
    up = with_node.select("tree_id", F.col("id").alias("parent_id"), F.col("node").alias("parent"))
    rows = with_node.join(up, TREE, "left").join(values, "id")
    listed = F.array_sort(F.collect_list(F.struct("enter", "id", "note")))
    whole = rows.groupBy("tree_id", "node").agg(F.min("parent").alias("parent"), F.count("*").alias("calls"), F.sum("duration").alias("duration"), listed.alias("held"))
    ids = F.array_join(F.transform("held", lambda x: x["id"].cast("string")), ",")
    return whole.select("tree_id", "node", "parent", "calls", "duration", ids.alias("ids"), F.array_join(F.transform("held", lambda x: x["note"]), "").alias("tooltip"))


def merged_edges(with_node: DataFrame) -> DataFrame:
    """(tree_id, source, target, type, count) between merged nodes.

    A sequence leads from each node to its next sibling and counts how often; a call leads to a merged
    node whose first node is a first child, a return from one that has a last child, once each; the
    root has an initial edge to itself.
    """
    next_ = F.lead("node").over(Window.partitionBy(*TREE).orderBy("child"))
    up = with_node.select("tree_id", F.col("id").alias("parent_id"), F.col("node").alias("parent"))
    rows = with_node.withColumn("next", next_).join(up, TREE, "left")
    edge = lambda kind, source, target: F.struct(F.lit(kind).alias("type"), F.col(source).alias("source"), F.col(target).alias("target"))
    below = F.col("parent_id").isNotNull()
    found = F.array(
        F.when(~below & F.col("is_first"), edge("initial", "node", "node")),
        F.when(below & F.col("is_first") & (F.col("child") == 0), edge("call", "parent", "node")),
        F.when(below & F.col("next").isNotNull(), edge("sequence", "node", "next")),
        F.when(below & F.col("next").isNull(), edge("return", "node", "parent")),
    )
    edges = rows.select("tree_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).groupBy("tree_id", "e.source", "e.target", "e.type").agg(F.count("*").alias("count"))
    return edges.withColumn("count", F.when(F.col("type") == "return", 1).otherwise(F.col("count")).cast("long"))
