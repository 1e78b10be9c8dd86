"""A trie of conversation prefixes, summed up along heavy paths.

A node is a distinct sequence of first turns, known by its depth and two 64-bit sums (exclusive or) of
its turns' digests, each hashed with its place; its members are the conversations that begin with it.
The heavy child of a node is the one of most members (of equal ones that with the smallest member). Heavy
edges make paths, each down to a leaf; an edge to any other child at least halves the members, so no
walk from the root changes paths more often than the logarithm of the conversations. Sums over subtrees are
suffix sums along paths, from the deepest level of paths up: a round adds up all paths of a level at
once and hands the sum of each to the node that it hangs on.

Turns come in the order of ``turn`` (null first), equal ones by the digest of role and text; null role
or text is empty, repeated rows are turns of their own. Rows without ``conv_id`` belong to no
conversation and make no node. Long texts are only read for their digest and size. Of an empty table
there is no root either: the result is empty. Other columns are not read.

Nodes that many rows meet in (a common first turn, the root) are joined by broadcast: those with more
than a thousandth of all rows, of which there can't be more than a thousand. The turns of a single conversation
are put in order in one task, which spills to disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.checkpoints import stored
from lineagraph.llm.common import crc_mod, documents, prepare

KEY = ["depth", "k1", "k2"]
#: A conversation begins with up to MOST_LENT turns of the first one of its group of ids.
GROUP, MOST_LENT = 5, 8
#: Ids in one piece of the text that is hashed: pieces are those of one range of ids.
ID_BITS = 12
#: No more nodes than this can have more than a part of 1 / HOT of all rows.
HOT = 1000


def _digest() -> Column:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(grp, conv_id, place, digest, n_bytes): each turn with its place from 1, dealt by groups of ids."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", _digest().alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    rows = rows.withColumn("grp", F.col("conv_id") - F.col("conv_id") % GROUP).repartition("grp")
    place = F.row_number().over(Window.partitionBy("grp", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return rows.select("grp", "conv_id", place.alias("place"), "digest", "n_bytes")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(grp, conv_id, depth, digest, n_bytes): conversations that begin with turns of their group's first one.

    The first h turns are those of the conversation whose id the group has (fewer if it has fewer, none
    if it is absent), then come the own ones after the first h; h is crc32(id) modulo 9. Each
    conversation also has a row of depth 0 without a digest, so that one without turns is kept.
    """
    turn = F.struct(F.col("place").alias("depth"), "digest", "n_bytes")
    lent = F.collect_list(F.when((F.col("conv_id") == F.col("grp")) & (F.col("place") <= MOST_LENT), turn)).over(Window.partitionBy("grp"))
    with_lent = turns.select("*", crc_mod("conv_id", MOST_LENT + 1).cast("int").alias("h"), lent.alias("lent"))
    taken = F.filter("lent", lambda t: t["depth"] <= F.col("h"))
    root = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).alias("n_bytes"))
    own = F.struct((F.col("place") - F.col("h") + F.size(taken)).alias("depth"), "digest", "n_bytes")
    none = F.array().cast("array<struct<depth:int,digest:string,n_bytes:int>>")
    first = F.when(F.col("place") == 1, F.concat(F.array(root), taken)).otherwise(none)
    parts = F.concat(first, F.when(F.col("place") > F.col("h"), F.array(own)).otherwise(none))
    return with_lent.select("grp", "conv_id", F.explode(parts).alias("t")).select("grp", "conv_id", "t.*")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_bytes, is_last): each conversation's nodes from the root down, and their parents' keys."""
    down = Window.partitionBy("grp", "conv_id").orderBy("depth")
    hashed = turns.select("*", *(F.when(F.col("depth") > 0, F.xxhash64(F.lit(k), "depth", "digest")).otherwise(F.lit(0).cast("long")).alias(f"x{k}") for k in (1, 2)))
    summed = hashed.select("*", *(F.bit_xor(f"x{k}").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias(f"k{k}") for k in (1, 2)), F.lead("depth").over(down).isNull().alias("is_last"))
    return summed.select("conv_id", "depth", "k1", "k2", *(F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"p{k}") for k in (1, 2)), "n_bytes", "is_last")


def _meet(rows: DataFrame, nodes: DataFrame, key: list[str], limit: int) -> DataFrame:
    """Inner join on ``key``, which is unique in nodes; those of more than ``limit`` members are broadcast."""
    hot, cold = nodes.where(F.col("n_convs") > limit).drop("n_convs"), nodes.where(F.col("n_convs") <= limit).drop("n_convs")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(cold, key))


def ends_digests(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): of the comma-joined ids, ascending, of the conversations that end at a node.

    Ids are joined in pieces by their range, and the pieces of a node hashed one after the other.
    """
    pieces = rows.where("is_last").groupBy(*KEY, F.shiftright("conv_id", ID_BITS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def put(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in found], pa.int32()), *(pa.array([k[i] for k, _ in found], pa.int64()) for i in (1, 2)), pa.array([d for _, d in found], pa.string())], names=[*KEY, "ends_sha256"])

        for batch in batches:
            found = []
            for *at, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != key:
                    if key is not None:
                        found.append((key, state.hexdigest()))
                    key, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield put(found)
        if key is not None:
            yield put([(key, state.hexdigest())])

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "ids")
    return dealt.mapInArrow(run, "depth int, k1 long, k2 long, ends_sha256 string")


def trie_nodes(rows: DataFrame, limit: int) -> DataFrame:
    """One row a node: its members, children and parent's smallest member, and whether it is its parent's heavy child."""
    nodes = stored(rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")))
    heavy = F.max_by(F.struct("k1", "k2"), F.struct("n_convs", -F.col("conv_id")))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), heavy.alias("heavy"))
    nodes = stored(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("siblings_heavy"), "n_convs")
    below = _meet(nodes.where("depth > 0").drop("heavy"), above, ["depth", "p1", "p2"], limit)
    is_heavy = (F.col("siblings_heavy.k1") == F.col("k1")) & (F.col("siblings_heavy.k2") == F.col("k2"))
    root = nodes.where("depth = 0").drop("heavy").withColumns({"parent_conv_id": F.lit(None).cast("long"), "is_heavy": F.lit(True)})
    return stored(below.withColumn("is_heavy", is_heavy).drop("siblings_heavy").unionByName(root))


def heavy_paths(rows: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """The nodes with ``path``, the smallest member of the leaf it ends in, its ``level`` below the root's, and ``is_head``.

    A leaf's path is the end of its way from the root after the last edge that is not heavy.
    """
    leaves = nodes.where("n_children = 0").select("conv_id")
    way = rows.join(leaves, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), *KEY)
    way = _meet(way, nodes.select(*KEY, "is_heavy", "n_convs"), KEY, limit)
    down = Window.partitionBy("path").orderBy("depth")
    light = F.when(F.col("is_heavy"), 0).otherwise(1)
    counted = way.select("path", *KEY, F.sum(light).over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("level"), F.sum(light).over(Window.partitionBy("path")).alias("last"))
    own = counted.where("level = last").select("path", "level", *KEY)
    return nodes.join(own, KEY).withColumn("is_head", ~F.col("is_heavy") | (F.col("depth") == 0))


def subtree_sums(paths: DataFrame, values: dict[str, Column]) -> DataFrame:
    """The nodes with each value summed over their subtrees."""
    paths = stored(paths.withColumns(values))
    up = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out, hung = None, None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, -1, -1):
        here = paths.where(F.col("level") == level)
        if hung is not None:
            here = here.join(hung, KEY, "left").withColumns({v: F.col(v) + F.coalesce(f"hung_{v}", F.lit(0)) for v in values}).drop(*(f"hung_{v}" for v in values))
        here = stored(here.withColumns({v: F.sum(v).over(up) for v in values}))
        heads = here.where("is_head and depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), *values)
        hung = heads.groupBy(*KEY).agg(*(F.sum(v).alias(f"hung_{v}") for v in values))
        out = here if out is None else out.unionByName(here)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Nodes of the trie over turns (grp, conv_id, depth, digest, n_bytes), each conversation with a row of depth 0.

    ``grp`` is any key that a conversation's rows share. One row a node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes that members share, over the
    subtree) and ends_sha256.
    """
    rows = stored(prefixes(turns))
    limit = rows.count() // HOT
    nodes = trie_nodes(rows, limit)
    own = {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes").cast("long")}
    summed = subtree_sums(heavy_paths(rows, nodes, limit), own)
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return summed.join(ends_digests(rows), KEY, "left").select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return prefix_trie(rebuilt_turns(ordered_turns(documents(spark, sf_dir, "conversations"))))


#: crc32 bit by bit: each byte comes in with seven zeros behind it. A prefix is the list of its turns.
OP12_SQL = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS own FROM turns GROUP BY conv_id),
dealt AS (
    SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT) % 9 AS h
    FROM whole),
rebuilt AS (SELECT d.conv_id, list_concat(coalesce(p.own[:d.h], []), d.own[d.h + 1:]) AS path FROM dealt d LEFT JOIN whole p ON p.conv_id = d.conv_id - d.conv_id % 5),
members AS (SELECT conv_id, path[:depth] AS path, depth, depth = len(path) AS is_last FROM (SELECT conv_id, path, unnest(generate_series(0, len(path))) AS depth FROM rebuilt)),
nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_last), '')) AS ends_sha256,
           CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(path[depth].text) ELSE 0 END AS own
    FROM members GROUP BY path, depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
below AS (SELECT path[:above] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own) AS saved FROM (SELECT path, n_children, own, unnest(generate_series(0, depth)) AS above FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.path = c.path LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.path[:c.depth - 1]
"""
