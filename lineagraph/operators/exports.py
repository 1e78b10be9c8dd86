"""Dataflow graphs written as documents: DOT with nested subgraphs, and PROV-N.

A document is rows (trial_id, line_no, text). Where a node's lines go follows from the sizes of the
subtrees before it, so many tasks write one document and nothing is put together in one place. Nodes
are called ``c_`` (activations), ``e_`` (evaluations) and ``a_`` (accesses) and their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.operators.trees import numbered

# Attributes of the kinds of nodes in DOT.
CALL_STYLE = 'fillcolor="#3A85B9" fontcolor="white" shape="box" style="filled"'
VALUE_STYLE = 'fillcolor="#85CBD0" fontcolor="black" shape="box" style="rounded,filled"'
ACCESS_STYLE = 'fillcolor="white" fontcolor="black" shape="box" style="rounded,filled"'
PREFIXES = ("prefix script <https://dew-uff.github.io/versioned-prov/ns/script#>", "prefix version <https://dew-uff.github.io/versioned-prov/ns#>")
LABEL_SIZE = 55


def shown_label(text: Column, size: int = LABEL_SIZE) -> Column:
    """At most ``size`` characters, the middle left out; quotes escaped; empty for null."""
    half = (size - 5) // 2
    cut = F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, half), F.lit(" ... "), F.right(text, F.lit(half)))).otherwise(text)
    return F.coalesce(F.replace(cut, F.lit('"'), F.lit('\\"')), F.lit(""))


def _said(*parts: Column | str) -> Column:
    """Columns and plain text, given in turn as (text, column, text, ...), put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def graph_nodes(parts: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(trial_id, node, parent, place, kind, id, is_cluster, name, value, line, checkpoint) of a clustered graph.

    ``parts`` (trial_id, kind, id, cluster_id) are the shown activations, evaluations and accesses, ``facts``
    (kind, id, name, value, line, checkpoint) what is written of them; without facts their columns are left out.
    In a cluster evaluations come before activations and these before accesses, each by id.
    """
    letter = F.when(F.col("kind") == "activation", "c_").when(F.col("kind") == "evaluation", "e_").otherwise("a_")
    rank = F.when(F.col("kind") == "evaluation", 0).when(F.col("kind") == "activation", 1).otherwise(2)
    filled = parts.where("cluster_id is not null").select(F.lit("activation").alias("kind"), F.col("cluster_id").alias("id"), F.lit(True).alias("filled")).distinct()
    is_cluster = (F.col("kind") == "activation") & (F.col("cluster_id").isNull() | F.col("filled").isNotNull())
    known = parts.join(filled, ["kind", "id"], "left")
    written = () if facts is None else ("name", "value", "line", "checkpoint")
    known = known if facts is None else known.join(facts, ["kind", "id"], "left")
    place = F.shiftleft(rank.cast("long"), 52) + F.col("id")
    return known.select("trial_id", _said(letter, F.col("id")).alias("node"), _said("c_", F.col("cluster_id")).alias("parent"), place.alias("place"), "kind", "id", is_cluster.alias("is_cluster"), *written)


def _tree(nodes: DataFrame) -> DataFrame:
    """The nodes (trial_id, node, parent, place, opening, closing, ...) with the numbers of their trees."""
    sized = stored(nodes)
    rows = sized.select(F.col("trial_id").alias("tree_id"), F.col("node").alias("id"), F.col("parent").alias("parent_id"), "place", F.lit("").alias("label"), F.size("opening").alias("opens"), F.size("closing").alias("closes"))
    numbers = numbered(rows, alike=False).select(F.col("tree_id").alias("trial_id"), F.col("id").alias("node"), "depth", "size", "enter", F.col("line").alias("at"), "lines")
    return stored(sized.join(numbers, ["trial_id", "node"]))


def _written(tree: DataFrame) -> DataFrame:
    """(trial_id, line_no, text) of the nodes' own lines."""
    lines = F.concat(
        F.transform("opening", lambda x, i: F.struct((F.col("at") + i).alias("line_no"), x.alias("text"))),
        F.transform("closing", lambda x, i: F.struct((F.col("at") + F.col("lines") - F.size("closing") + i).alias("line_no"), x.alias("text"))),
    )
    return tree.select("trial_id", F.explode(lines).alias("l")).select("trial_id", "l.*")


def dot_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The DOT text of each trial's graph: clusters as nested subgraphs, nodes of one line of code in one rank, then the edges.

    ``edges`` (trial_id, source, target, style) are written if both ends are shown, by source and target.
    """
    ranked = nodes.where("kind = 'evaluation'").groupBy("trial_id", "parent", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "node"))), lambda x: x["node"]), " ").alias("held"))
    ranks = ranked.groupBy("trial_id", F.col("parent").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "held"))), lambda x: F.concat(F.lit("{rank=same "), x["held"], F.lit("}"))).alias("ranks"))
    value = shown_label(F.col("value"))
    of_value = F.when(value == "", "").otherwise(F.concat(F.lit(" =\\n"), value))
    drawn = lambda name, style: _said(F.col("node"), ' [label="', F.coalesce(F.col("line").cast("string"), F.lit("0")), " ", name, of_value, f'" {style}];')
    name = shown_label(F.col("name"))
    leaf = F.when(F.col("kind") == "evaluation", drawn(name, VALUE_STYLE)).when(F.col("kind") == "access", _said(F.col("node"), ' [label="', name, f'" {ACCESS_STYLE}];')).otherwise(drawn(name, CALL_STYLE))
    inner = F.array(_said("subgraph cluster_", F.col("id"), " {"), F.lit('    color="#3A85B9";'), F.lit("    fontsize=30;"), _said('    label = "', name, '";'), F.concat(F.lit("    "), drawn(F.lit("return"), CALL_STYLE)))
    main = F.array(_said("digraph cluster_", F.col("id"), " {"), F.lit("    rankdir=RL;"), F.lit("    node[fontsize=20]"))
    is_main = F.col("is_cluster") & F.col("parent").isNull()
    rows = nodes.join(ranks, ["trial_id", "node"], "left")
    inside = F.transform(F.coalesce("ranks", F.array().cast("array<string>")), lambda x: F.concat(F.lit("    "), x))
    opening = F.when(is_main, main).when(F.col("is_cluster"), inner).otherwise(F.array(leaf))
    closing = F.when(is_main, inside).when(F.col("is_cluster"), F.concat(inside, F.array(F.lit("}")))).otherwise(F.array().cast("array<string>"))
    tree = _tree(rows.withColumns({"opening": opening, "closing": closing}).drop("ranks"))
    deep = lambda x: F.concat(F.repeat(F.lit("    "), F.col("depth")), x)
    body = _written(tree.withColumns({"opening": F.transform("opening", deep), "closing": F.transform("closing", deep)}))
    ends = tree.where("parent is null").select("trial_id", F.col("lines").alias("until"))
    shown = lambda c: tree.select("trial_id", F.col("node").alias(c))
    kept = edges.join(shown("source"), ["trial_id", "source"], "left_semi").join(shown("target"), ["trial_id", "target"], "left_semi")
    order = Window.partitionBy("trial_id").orderBy("source", "target", "style")
    said = kept.select("trial_id", F.row_number().over(order).alias("n"), _said("    ", F.col("source"), " -> ", F.col("target"), " ", F.col("style"), ";").alias("text"))
    tail = said.join(ends, "trial_id").select("trial_id", (F.col("until") + F.col("n") - 1).alias("line_no"), "text")
    counts = ends.join(kept.groupBy("trial_id").agg(F.count("*").alias("n")), "trial_id", "left")
    last = counts.select("trial_id", (F.col("until") + F.coalesce("n", F.lit(0))).alias("line_no"), F.lit("}").alias("text"))
    return body.unionByName(tail).unionByName(last)


def prov_document(nodes: DataFrame, dependencies: DataFrame, members: DataFrame) -> DataFrame:
    """The PROV-N text of each trial's graph: entities and calls in the graph's order, then what was derived, and members.

    ``dependencies`` (trial_id, source, target, type, checkpoint, reference) of shown nodes are grouped by source and
    type: a group is an activity, but that of a call is the call. ``members`` (trial_id, collection, key,
    member, checkpoint) come last. Generations and uses are called by their nodes.
    """
    name = F.when(F.col("is_cluster"), "return").otherwise(shown_label(F.col("name")))
    entity = _said("entity(", F.col("node"), ', [value="', shown_label(F.col("value")), '", type="script:eval", script:line="', F.coalesce(F.col("line").cast("string"), F.lit("0")), '", label="', name, '"])')
    of_access = _said("entity(", F.col("node"), ', [type="script:access", label="', shown_label(F.col("name")), '"])')
    activity = _said("activity(call_", F.col("id"), ', [type="script:call", label="', shown_label(F.col("name")), '"])')
    generated = _said("wasGeneratedBy(g_", F.col("node"), "; ", F.col("node"), ", call_", F.col("id"), ', -,[version:checkpoint="', F.coalesce(F.col("checkpoint").cast("string"), F.lit("")), '"])')
    is_main = F.col("is_cluster") & F.col("parent").isNull()
    opening = F.when(is_main, F.array(*map(F.lit, PREFIXES))).when(F.col("kind") == "activation", F.array(entity, activity, generated)).when(F.col("kind") == "access", F.array(of_access)).otherwise(F.array(entity))
    tree = _tree(nodes.withColumns({"opening": opening, "closing": F.array().cast("array<string>")}))
    ends = tree.where("parent is null").select("trial_id", F.col("lines").alias("until"))
    shown = lambda c: tree.where("parent is not null").select("trial_id", F.col("node").alias(c))
    kept = stored(dependencies.join(shown("source"), ["trial_id", "source"], "left_semi").join(shown("target"), ["trial_id", "target"], "left_semi"))
    by_call = F.col("source").startswith("c_")
    act = F.when(by_call, F.concat(F.lit("call_"), F.substring("source", 3, 99))).otherwise(F.concat_ws("_", "type", "source"))
    gen = F.when(by_call, F.concat(F.lit("g_"), F.col("source"))).otherwise(F.concat(F.lit("g_"), act))
    use = F.concat(F.lit("u_"), F.concat_ws("_", "type", "source", "target"))
    at = _said('version:checkpoint="', F.coalesce(F.col("checkpoint").cast("string"), F.lit("")), '"')
    line = lambda *key, text: F.struct(*(F.lit(k).alias(f"k{i}") if isinstance(k, int) else k.alias(f"k{i}") for i, k in enumerate(key)), text.alias("text"))
    head = kept.where(~by_call).groupBy("trial_id", "source", "type").agg(F.max("checkpoint").alias("checkpoint"))
    none = F.lit("")
    heads = head.select("trial_id", F.explode(F.array(
        line(0, F.col("source"), F.col("type"), none, 0, text=_said("activity(", act, ', [type="script:operation"])')),
        line(0, F.col("source"), F.col("type"), none, 1, text=_said("wasGeneratedBy(", gen, "; ", F.col("source"), ", ", act, ", -,[", at, "])")),
    )).alias("l"))
    reference = F.when(F.col("reference"), ', type="version:Reference"').otherwise("")
    uses = kept.select("trial_id", F.explode(F.array(
        line(0, F.col("source"), F.col("type"), F.col("target"), 2, text=_said("used(", use, "; ", act, ", ", F.col("target"), ", -,[", at, "])")),
        line(0, F.col("source"), F.col("type"), F.col("target"), 3, text=_said("wasDerivedFrom(", F.col("source"), ", ", F.col("target"), ", ", act, ", ", gen, ", ", use, ", [", at, reference, "])")),
    )).alias("l"))
    held = members.join(shown("collection"), ["trial_id", "collection"], "left_semi").join(shown("member"), ["trial_id", "member"], "left_semi")
    put = _said("hadMember(", F.col("collection"), ", ", F.col("member"), ', [type="version:Put", version:key="', F.col("key"), '", version:checkpoint="', F.col("checkpoint"), '"])')
    puts = held.select("trial_id", line(1, F.col("collection"), F.col("key"), F.col("member"), 4, text=put).alias("l"))
    rest = heads.unionByName(uses).unionByName(puts).select("trial_id", "l.*")
    order = Window.partitionBy("trial_id").orderBy("k0", "k1", "k2", "k3", "k4", "text")
    numbered_rest = rest.select("trial_id", F.row_number().over(order).alias("n"), "text").join(ends, "trial_id")
    return _written(tree).unionByName(numbered_rest.select("trial_id", (F.col("until") + F.col("n") - 1).alias("line_no"), "text"))


def cluster_parts(nodes: DataFrame) -> DataFrame:
    """(trial_id, node, kind, id, enter, size): every node with the range of the graph's order that its part takes."""
    numbers = numbered(nodes.select(F.col("trial_id").alias("tree_id"), F.col("node").alias("id"), F.col("parent").alias("parent_id"), "place", F.lit("").alias("label")), alike=False)
    kind = F.when(F.col("id").startswith("c_"), "activation").when(F.col("id").startswith("e_"), "evaluation").otherwise("access")
    return numbers.select(F.col("tree_id").alias("trial_id"), F.col("id").alias("node"), kind.alias("kind"), F.substring("id", 3, 99).cast("long").alias("id"), "enter", "size")


def part_of(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(trial_id, top, node): for activations that are asked for (column id) the nodes of their part, themselves included."""
    parts = stored(cluster_parts(nodes))
    tops = parts.where("kind = 'activation'").join(asked.select("id"), "id", "left_semi").select("trial_id", F.col("node").alias("top"), F.col("enter").alias("since"), (F.col("enter") + F.col("size")).alias("until"))
    return tops.join(parts.select("trial_id", "node", "enter"), "trial_id").where("enter >= since and enter < until").select("trial_id", "top", "node")
