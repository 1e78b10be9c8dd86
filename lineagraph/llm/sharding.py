"""Balanced label propagation over linked documents.

Every document starts in the shard of its hash. In each round the linked documents of a group look
where their neighbours are: a group moves to the shard that already holds most of it, under a quota for each two shards, so that no shard gets more than its room and what leaves it. What
does not fit into a quota does not hold up what does. Documents without links move last, to make all
shards equal to a row (law ``rows``). Groups larger than a quarter of a shard move in parts, which
fill the group's shards one after the other.

All shuffles carry a few numbers a document, never a text. Null and empty texts are equal texts and
weigh eight bytes. Repeated rows are documents of their own. An empty table gives an empty result.
More shards than documents leave shards empty. Only the id and the text are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.llm.common import blocks, documents, materialize

SHARDS = 24
ROUNDS = 10
ROWS_PER_BLOCK = 8192


def _pick(index: Column, values: list[int]) -> Column:
    """values[index], for a list as long as the shards are many."""
    return F.get(F.array(*(F.lit(v).cast("long") for v in values)), index)


def _flows(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows wanted from one shard to another may go, so that none gets more than its room and what leaves it."""
    flows, shards = {k: float(n) for k, n in wanted.items()}, range(len(room))
    for _ in range(200):
        gets, gives = [sum(f for (_, b), f in flows.items() if b == s) for s in shards], [sum(f for (a, _), f in flows.items() if a == s) for s in shards]
        share = [min(1.0, (room[s] + gives[s]) / gets[s]) if gets[s] else 1.0 for s in shards]
        if min(share) > 0.9999:
            break
        flows = {k: f * share[k[1]] for k, f in flows.items()}
    return {k: int(f) for k, f in flows.items()}


def propagate(linked: DataFrame, shards: int, room: int, part_rows: int, rounds: int = ROUNDS) -> DataFrame:
    """Rows (row, sub, grp, part, shard) with better shards: fewer groups cut, about ``room`` linked rows in a shard at most."""
    parcels = materialize(linked.groupBy("grp", "part", "shard").agg(F.count("*").alias("n")).withColumn("parcel", F.monotonically_increasing_id()))
    own = linked.join(parcels.select("grp", "part", F.col("shard").alias("old"), "parcel"), (linked.grp == parcels.grp) & (linked.part == parcels.part) & (linked.shard == F.col("old"))).select("row", "sub", "parcel")
    state = parcels.withColumn("to", F.col("shard"))
    nb = blocks(parcels.count(), ROWS_PER_BLOCK)
    for turn in range(rounds):
        held = {r.to: r.n for r in state.groupBy("to").agg(F.sum("n").alias("n")).collect()}  # a number a shard
        free = [max(0, room - held.get(s, 0)) for s in range(shards)]
        here = state.groupBy("grp", "to").agg(F.sum("n").alias("here"))
        # shards that hold most of the group first; ties go by a new hash each round, so that what one quota refuses tries another way
        choice = Window.partitionBy("grp").orderBy(F.desc("here"), F.xxhash64("grp", "to", F.lit(turn)))
        ends = F.sum(F.col("here") + _pick(F.col("to"), free)).over(choice.rowsBetween(Window.unboundedPreceding, 0))
        last = F.lead("to").over(choice).isNull()
        ranked = here.withColumn("hi", ends).withColumn("lo", F.col("hi") - F.col("here") - _pick(F.col("to"), free)).withColumn("last", last)
        # the parts of a group fill its shards one after the other
        begin = F.col("part").cast("long") * part_rows
        goals = ranked.select(F.col("grp").alias("of"), F.col("to").alias("goal"), F.col("here").alias("there"), "lo", "hi", "last")
        aimed = state.join(goals, (F.col("grp") == F.col("of")) & (F.col("lo") <= begin) & ((begin < F.col("hi")) | F.col("last"))).join(here, ["grp", "to"])
        # never away from where more neighbours are
        wanted = materialize(aimed.where((F.col("goal") != F.col("to")) & (F.col("there") >= F.col("here"))).select("parcel", "to", "goal", "n", "there"))
        asked = {(r.to, r.goal): r.n for r in wanted.groupBy("to", "goal").agg(F.sum("n").alias("n")).collect()}  # a number for two shards
        flows = _flows(asked, free)
        lane = F.col("to") * shards + F.col("goal")
        quota = _pick(lane, [flows.get((x, y), 0) for x in range(shards) for y in range(shards)])
        # the largest gains first, until the quota of the two shards is used; sums of blocks give the offsets
        fits = wanted.where(F.col("n") <= quota).withColumn("lane", lane).withColumn("gain", F.floor(F.log2("there"))).withColumn("block", F.pmod(F.xxhash64("parcel"), F.lit(nb)))
        cell = ("lane", "gain", "block")
        sums = fits.groupBy(*cell).agg(F.sum("n").alias("in_cell"))
        before = F.sum("in_cell").over(Window.partitionBy("lane").orderBy(F.desc("gain"), "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_cell")
        used = F.sum("n").over(Window.partitionBy(*cell).orderBy("parcel").rowsBetween(Window.unboundedPreceding, 0))
        moves = fits.withColumn("used", used).join(sums.select(*cell, before.alias("before")), list(cell)).where(F.col("before") + F.col("used") <= quota)
        moves = materialize(moves.select("parcel", "goal"))
        if not moves.limit(1).count():
            break
        state = materialize(state.join(moves, "parcel", "left").withColumn("to", F.coalesce("goal", "to")).drop("goal"))
    return own.join(state.select("parcel", "to"), "parcel").select("row", "sub", F.col("to").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts together where shards have room, counts at most one apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.md5(F.encode(whole, "UTF-8")).alias("grp"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    total = base.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    part_rows = max(1, total // shards // 4)
    groups = base.groupBy("grp").agg(F.count("*").alias("group_n")).where("group_n > 1").withColumn("parts", F.ceil(F.col("group_n") / part_rows))
    linked = base.join(groups, "grp").select("row", "grp", "shard", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int").alias("part"), F.pmod(F.xxhash64("row", F.lit(2)), F.ceil(F.col("group_n") / ROWS_PER_BLOCK)).alias("sub"))
    linked = materialize(linked)
    moved = propagate(linked, shards, total // shards, part_rows, rounds)
    placed = base.drop("shard").join(moved, "row", "left")
    known = placed.withColumn("free", F.col("shard").isNull()).withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    known = materialize(known.withColumn("block", F.pmod(F.xxhash64("grp", F.coalesce("sub", F.lit(0).cast("long"))), F.lit(blocks(total, ROWS_PER_BLOCK)))))

    # ranks in a shard: linked rows first, then the free ones; by blocks, whose sizes give the offsets
    sizes = known.groupBy("shard", "free", "block").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("free", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "free", "block", offset.alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "free", "block").orderBy("grp", "row")) - 1
    ranked = known.withColumn("inside", inside).join(offsets, ["shard", "free", "block"]).withColumn("rank", F.col("offset") + F.col("inside"))

    have = dict(known.groupBy("shard").count().collect())  # a number a shard
    over, short, n_over, n_short = [], [], 0, 0
    for s in range(shards):
        over.append(n_over)
        short.append(n_short)
        n_over += max(0, have.get(s, 0) - targets[s])
        n_short += max(0, targets[s] - have.get(s, 0))
    target = _pick(F.col("shard"), targets)
    turn = F.col("rank") - target + _pick(F.col("shard"), over)  # among all rows over their shard's target
    goal = F.lit(0)
    for s in range(shards):
        if targets[s] > have.get(s, 0):
            goal = F.when(turn >= short[s], F.lit(s)).otherwise(goal)  # later shards start at higher turns
    stays = F.col("rank") < target
    shard = F.when(stays, F.col("shard")).otherwise(goal).cast("int")
    slot = F.when(stays, F.col("rank")).otherwise(_pick(goal, [min(have.get(s, 0), targets[s]) for s in range(shards)]) + turn - _pick(goal, short))
    return ranked.select("doc_id", "size", "text_crc32", shard.alias("shard"), slot.cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
