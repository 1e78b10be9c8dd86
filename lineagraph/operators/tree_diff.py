"""Two ordered trees compared: edit distance, the mapping behind it, and both trees merged by it.

Taking a node out or putting one in costs 1, matching two nodes of unlike names 3, matching the roots
nothing. With these costs matching the roots, two trees of one name that stand alone, and equal first
or last trees of two forests never costs more than any other way. So equal subtrees are matched by their
digests from the roots down, in one join a level, and only forests that differ at both ends come to the quadratic part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import settle, stored

UNLIKE = 3
PAIR = ["tree_id", "other_id"]


class _Forest:
    """A forest in post-order under a root of its own, from pre-order labels and sizes."""

    def __init__(self, labels: Sequence, sizes: Sequence[int]):
        labels, sizes = [None, *labels], [len(sizes) + 1, *(int(s) for s in sizes)]
        self.pre, self.left, stack = [], [], []  # pre-order place, and the first leaf below, by post-order place

        def leave(until: int) -> None:
            while stack and stack[-1][1] <= until:
                i, _, first = stack.pop()
                self.pre.append(i)
                self.left.append(first)

        for i, size in enumerate(sizes):
            leave(i)
            stack.append((i, i + size, len(self.pre)))
        leave(len(sizes))
        self.labels = [labels[i] for i in self.pre]
        self.n = len(sizes)
        self.key_roots = sorted({first: i for i, first in enumerate(self.left)}.values())


#: Forests of which one has up to so many nodes are compared cell by cell: rows of a few cells take longer to call than to fill.
FEW_NODES = 128


def _few_rows(a: _Forest, b: _Forest, names: list[int], other: list[int]):
    """As ``_array_rows``, cell by cell."""
    apart = [[0] * b.n for _ in range(a.n)]
    left_a, left_b = a.left, b.left

    def forests(i: int, j: int, fill: bool) -> list[list[int]]:
        first, first_b = left_a[i], left_b[j]
        cost = [list(range(j - first_b + 2))]
        for x in range(first, i + 1):
            up, beside, trees, name, tree = cost[-1], cost[left_a[x] - first], apart[x], names[x], left_a[x] == first
            last = up[0] + 1
            row = [last]
            for k, y in enumerate(range(first_b, j + 1)):
                before = left_b[y] - first_b
                if tree and not before:
                    best = up[k] if name == other[y] else up[k] + UNLIKE
                else:
                    best = beside[before] + trees[y]
                if up[k + 1] < best:
                    best = up[k + 1] + 1
                if last < best:
                    best = last + 1
                if fill and tree and not before:
                    trees[y] = best
                row.append(best)
                last = best
            cost.append(row)
        return cost

    forests.apart = apart
    return forests


def _array_rows(a: _Forest, b: _Forest, names: np.ndarray, other: np.ndarray):
    """A function of two nodes for the costs between the forests that begin with their first leaves; ``apart`` holds
    those between the subtrees of two nodes, once filled."""
    left_b = np.array(b.left)
    apart = np.zeros((a.n, b.n), np.int32)

    def forests(i: int, j: int, fill: bool) -> np.ndarray:
        """Costs between the forests that begin with the first leaves of i and j, up to each node."""
        first, first_b = a.left[i], b.left[j]
        width = j - first_b + 2
        step = np.arange(width, dtype=np.int32)
        cost = np.zeros((i - first + 2, width), np.int32)
        cost[0] = step
        before = left_b[first_b : j + 1] - first_b
        whole = before == 0  # the forest up to this node is its tree
        for x in range(first, i + 1):
            row = x - first + 1
            tree = a.left[x] == first
            match = cost[a.left[x] - first, before] + apart[x, first_b : j + 1]
            if tree:
                match = np.where(whole, cost[row - 1, :-1] + np.where(other[first_b : j + 1] == names[x], 0, UNLIKE), match)
            best = np.empty(width, np.int32)
            best[0] = cost[row - 1, 0] + 1
            np.minimum(cost[row - 1, 1:] + 1, match, out=best[1:])
            cost[row] = np.minimum.accumulate(best - step) + step
            if fill and tree:
                apart[x, first_b : j + 1][whole] = cost[row, 1:][whole]
        return cost

    forests.apart = apart
    return forests


def edit_mapping(labels: Sequence, sizes: Sequence[int], other_labels: Sequence, other_sizes: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost between two forests, given in pre-order, and matched places (Zhang and Shasha's algorithm).

    Takes memory and time of the product of both sizes, time also of the products of their depths. Of
    ways that cost the same, matching comes before taking out, and that before putting in, from the end.
    """
    a, b = _Forest(labels, sizes), _Forest(other_labels, other_sizes)
    number = {label: i for i, label in enumerate(dict.fromkeys([*a.labels, *b.labels]))}
    names, other = [number[x] for x in a.labels], [number[x] for x in b.labels]
    forests = _few_rows(a, b, names, other) if min(a.n, b.n) <= FEW_NODES else _array_rows(a, b, np.array(names), np.array(other))
    for i in a.key_roots:
        for j in b.key_roots:
            whole = forests(i, j, True)
    pairs, todo = [], [(a.n - 1, b.n - 1)]
    while todo:
        i, j = todo.pop()
        cost, first, first_b = forests(i, j, False), a.left[i], b.left[j]
        x, y = i, j
        while x >= first and y >= first_b:
            here = cost[x - first + 1][y - first_b + 1]
            if a.left[x] == first and b.left[y] == first_b:
                if names[x] == other[y] and here == cost[x - first][y - first_b]:
                    pairs.append((x, y))
                    x, y = x - 1, y - 1
                    continue
            elif here == cost[a.left[x] - first][b.left[y] - first_b] + forests.apart[x][y]:
                todo.append((x, y))
                x, y = a.left[x] - 1, b.left[y] - 1
                continue
            if here == cost[x - first][y - first_b + 1] + 1:
                x -= 1
            else:
                y -= 1
    return int(whole[-1][-1]), sorted((a.pre[x] - 1, b.pre[y] - 1) for x, y in pairs if a.pre[x])


def _equal_ends(frontier: DataFrame, kids: DataFrame, at: str, name: str) -> DataFrame:
    """(tree_id, other_id, name): how many first (``at`` = child) or last (= back) trees below two matched nodes are equal."""
    mine = kids.select("tree_id", F.col("parent_id").alias("a"), at, "s1", "s2")
    theirs = kids.select(F.col("tree_id").alias("other_id"), F.col("parent_id").alias("b"), at, F.col("s1").alias("o1"), F.col("s2").alias("o2"))
    unlike = frontier.join(mine, ["tree_id", "a"]).join(theirs, ["other_id", "b", at]).where("s1 <> o1 or s2 <> o2")
    return unlike.groupBy(*PAIR).agg(F.min(at).alias(name))


def tree_mapping(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tree_id, other_id, id, other): how the nodes of two trees are matched; null for one without a partner.

    ``tree`` has the numbered nodes of trees with one root each, ``pairs`` (tree_id, other_id). Trees of a pair
    that is missing in ``tree`` have no rows. A pair's forests that differ are compared in one task.
    """
    tree = stored(tree.select("tree_id", "id", "parent_id", "label", "child", "size", "enter", "n_children", "s1", "s2"))
    up = tree.select("tree_id", F.col("id").alias("parent_id"), F.col("n_children").alias("n_siblings"))
    kids = stored(tree.join(up, ["tree_id", "parent_id"]).withColumn("back", F.col("n_siblings") - 1 - F.col("child")))
    node = lambda tree_id, i, *more: tree.select(F.col("tree_id").alias(tree_id), F.col("id").alias(i), *(F.col(c).alias(f"{i}_{c}") for c in more))
    roots = tree.where("parent_id is null")
    frontier = settle(pairs.select(*PAIR).distinct().join(roots.select("tree_id", F.col("id").alias("a")), "tree_id").join(roots.select(F.col("tree_id").alias("other_id"), F.col("id").alias("b")), "other_id"))
    every = frontier.select(*PAIR)
    matched, runs, rest = None, None, None
    while frontier.limit(1).count():
        wide = frontier.join(node("tree_id", "a", "enter", "size", "n_children"), ["tree_id", "a"]).join(node("other_id", "b", "enter", "size", "n_children"), ["other_id", "b"])
        least = F.least("a_n_children", "b_n_children")
        wide = wide.join(_equal_ends(frontier, kids, "child", "lead"), PAIR, "left").join(_equal_ends(frontier, kids, "back", "tail"), PAIR, "left")
        wide = wide.withColumn("lead", F.coalesce("lead", least)).withColumn("tail", F.least(F.coalesce("tail", least), least - F.col("lead")))
        sizes = wide.join(kids.select("tree_id", F.col("parent_id").alias("a"), "child", "back", "size"), ["tree_id", "a"]).groupBy(*PAIR)
        sizes = sizes.agg(*(F.sum(F.when(F.col(at) < F.col(end), F.col("size")).otherwise(0)).alias(f"n_{end}") for at, end in (("child", "lead"), ("back", "tail"))))
        wide = settle(wide.join(sizes, PAIR, "left").na.fill(0, ["n_lead", "n_tail"]))
        run = lambda a, b, n: F.struct(F.expr(a).alias("a_from"), F.expr(b).alias("b_from"), F.col(n).alias("n"))
        equal = F.explode(F.array(run("a_enter + 1", "b_enter + 1", "n_lead"), run("a_enter + a_size - n_tail", "b_enter + b_size - n_tail", "n_tail")))
        left = wide.where("lead + tail < greatest(a_n_children, b_n_children)")
        only = lambda tree_id, i: kids.select(F.col("tree_id").alias(tree_id), F.col("parent_id").alias(i), F.col("child").alias("lead"), F.col("id").alias(f"{i}_id"), F.col("label").alias(f"{i}_label"))
        alone = left.where("a_n_children - lead - tail = 1 and b_n_children - lead - tail = 1").join(only("tree_id", "a"), ["tree_id", "a", "lead"]).join(only("other_id", "b"), ["other_id", "b", "lead"]).where("a_label <=> b_label")
        alone = settle(alone.select(*PAIR, F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        forests = left.where("lead + tail < least(a_n_children, b_n_children)").join(alone.select(*PAIR), PAIR, "left_anti")
        forests = forests.selectExpr(*PAIR, "a_enter + 1 + n_lead as a_from", "a_enter + a_size - n_tail as a_to", "b_enter + 1 + n_lead as b_from", "b_enter + b_size - n_tail as b_to")
        found = (frontier.select(*PAIR, F.col("a").alias("id"), F.col("b").alias("other")), wide.select(*PAIR, equal.alias("r")).select(*PAIR, "r.*").where("n > 0"), forests)
        matched, runs, rest = found if matched is None else (matched.unionByName(found[0]), runs.unionByName(found[1]), rest.unionByName(found[2]))
        frontier = alone
    if matched is None:
        return every.withColumns({"id": F.lit(None).cast("long"), "other": F.lit(None).cast("long")}).limit(0)
    theirs = tree.select(F.col("tree_id").alias("other_id"), F.col("enter").alias("b_at"), F.col("id").alias("other"))
    by_run = runs.join(tree.select("tree_id", "enter", "id"), "tree_id").where("enter >= a_from and enter < a_from + n").withColumn("b_at", F.col("b_from") + F.col("enter") - F.col("a_from")).join(theirs, ["other_id", "b_at"])
    side = lambda key, low, high, last: rest.join(tree.select(F.col("tree_id").alias(key), "id", "enter", "size", "label"), key).where(f"enter >= {low} and enter < {high}").select(*PAIR, F.lit(last).alias("is_other"), "id", "enter", "size", "label")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for tree_id, other_id, nodes in zip(*(batch.column(c).to_pylist() if c in PAIR else batch.column(c) for c in (*PAIR, "nodes"))):
                last, ids, sizes, labels = (nodes.values.field(c).to_pylist() for c in ("is_other", "id", "size", "label"))
                n = last.index(True)
                _, found = edit_mapping(labels[:n], sizes[:n], labels[n:], sizes[n:])
                out += [(tree_id, other_id, ids[i], ids[n + j]) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=[*PAIR, "id", "other"])

    sides = side("tree_id", "a_from", "a_to", False).unionByName(side("other_id", "b_from", "b_to", True))
    listed = sides.groupBy(*PAIR).agg(F.sort_array(F.collect_list(F.struct("is_other", "enter", "id", "size", "label"))).alias("nodes"))
    by_cost = listed.mapInArrow(compare, "tree_id long, other_id long, id long, other long")
    together = stored(matched.unionByName(by_run.select(*PAIR, "id", "other")).unionByName(by_cost))
    gone = every.join(tree.select("tree_id", "id"), "tree_id").join(together.select(*PAIR, "id"), [*PAIR, "id"], "left_anti").select(*PAIR, "id", F.lit(None).cast("long").alias("other"))
    new = every.join(tree.select(F.col("tree_id").alias("other_id"), F.col("id").alias("other")), "other_id").join(together.select(*PAIR, "other"), [*PAIR, "other"], "left_anti").select(*PAIR, F.lit(None).cast("long").alias("id"), "other")
    return together.unionByName(gone).unionByName(new)


def tree_distances(mapping: DataFrame) -> DataFrame:
    """(tree_id, other_id, cost): nodes without a partner; no two unlike ones but roots are ever matched, as that costs more."""
    return mapping.groupBy(*PAIR).agg(F.count(F.when(F.col("id").isNull() | F.col("other").isNull(), 1)).alias("cost"))


def merged_tree(tree: DataFrame, mapping: DataFrame) -> DataFrame:
    """Both trees of each pair in one: (tree_id, other_id, id, other, parent_id, parent_other, name, place).

    A node is (id, other), one of them null if it is in one tree only, and its parent likewise. Matched nodes with
    unlike names are called ``a|b``. Where the parents of a matched node are not one, it hangs on the
    one that is matched, and below neither on its own tree's. ``place`` orders siblings: as in the
    first tree, what only the second one has before what follows it there.
    """
    mapping = stored(mapping)
    facts = lambda key, i, p: tree.select(F.col("tree_id").alias(key), F.col("id").alias(i), F.col("parent_id").alias(f"{p}_up"), F.col("label").alias(f"{p}_label"), F.col("enter").alias(f"{p}_enter"))
    rows = mapping.join(facts("tree_id", "id", "a"), ["tree_id", "id"], "left").join(facts("other_id", "other", "b"), ["other_id", "other"], "left")
    above = lambda i, p, partner: mapping.where(f"{i} is not null").select(*PAIR, F.col(i).alias(f"{p}_up"), F.col(partner).alias(f"{p}_up_with"))
    rows = rows.join(above("id", "a", "other"), [*PAIR, "a_up"], "left").join(above("other", "b", "id"), [*PAIR, "b_up"], "left")
    by_second = F.col("id").isNull() | (F.col("a_up_with").isNull() & F.col("b_up_with").isNotNull() & F.col("other").isNotNull())
    name = F.when(F.col("id").isNull(), F.col("b_label")).when(F.col("other").isNull() | F.col("a_label").eqNullSafe(F.col("b_label")), F.col("a_label")).otherwise(F.concat_ws("|", "a_label", "b_label"))
    hung = rows.select(*PAIR, "id", "other", F.when(by_second, F.col("b_up_with")).otherwise(F.col("a_up")).alias("parent_id"), F.when(by_second, F.col("b_up")).otherwise(F.col("a_up_with")).alias("parent_other"), name.alias("name"), "a_enter", "b_enter")
    siblings = Window.partitionBy(*PAIR, "parent_id", "parent_other")
    follows = F.min("a_enter").over(siblings.orderBy("b_enter").rowsBetween(1, Window.unboundedFollowing))
    anchor = F.when(F.col("id").isNull(), F.coalesce(follows, F.lit((1 << 62)))).otherwise(F.col("a_enter"))
    order = siblings.orderBy("anchor", F.col("id").isNotNull(), "b_enter")
    return hung.withColumn("anchor", anchor).withColumn("place", F.row_number().over(order) - 1).drop("anchor", "a_enter", "b_enter")


def merged_tree_edges(mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (tree_id, source, target, type, count) of both trees between merged nodes.

    (tree_id, other_id, source_id, source_other, target_id, target_other, type, count, other_count): how
    often the first and the second tree have it.
    """
    end = lambda i, p: mapping.where(f"{i} is not null").select(*PAIR, F.col(i).alias(p), F.col("id").alias(f"{p}_id"), F.col("other").alias(f"{p}_other"))

    def side(key: str, i: str, first: bool) -> DataFrame:
        mine = mapping.select(*PAIR).distinct().join(edges.withColumnRenamed("tree_id", key), key)
        named = mine.join(end(i, "source"), [*PAIR, "source"]).join(end(i, "target"), [*PAIR, "target"])
        zero = F.lit(0).cast("long")
        return named.select(*PAIR, "source_id", "source_other", "target_id", "target_other", "type", (F.col("count") if first else zero).alias("count"), (zero if first else F.col("count")).alias("other_count"))

    both = side("tree_id", "id", True).unionByName(side("other_id", "other", False))
    return both.groupBy(*PAIR, "source_id", "source_other", "target_id", "target_other", "type").agg(F.sum("count").alias("count"), F.sum("other_count").alias("other_count"))
