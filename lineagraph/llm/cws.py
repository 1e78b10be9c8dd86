"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is its words weighted by how often they occur. For each sample k and word, the two numbers
r and c are gamma(2, 1) variables and b is uniform, all drawn from the word's hash; with
t = floor(ln w / r + b) the word's key is c / exp(r * (t - b) + r), and the least key of a text is
its sample. Two texts have the same least key with a probability equal to the generalised Jaccard
similarity of their weights: sum of minima over sum of maxima. r * b and r * (1 - b) are drawn
first, as two exponential variables u and v; where t = 0, so for weight one always, the key is then c * exp(-v).

A null text is empty. An empty text has no sample: its fingerprint is that of null samples, equal
to other empty texts' and unlike any other. Rows follow each other by (doc_id, hash of the text); a
row without id comes first, repeated rows are rows like others, and the last row is followed by the first. A
single row follows itself. An empty table gives an empty result, a very long text is a row like others.
Only id and text are used, and nothing depends on where the input's rows lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.llm.common import blocks, documents

SAMPLES = 64
SAMPLES_AT_ONCE = 16
#: Above every key.
NONE = 1e300
ROWS_PER_BLOCK = 2048
#: Cut points of ids that the driver holds at most; ranges between them are cut evenly.
MOST_CUTS = 512
SPACE = "[\\x20\\x09-\\x0D]+"

_UNIT = 1.0 / (1 << 21)


def _uniform(bits: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(_UNIT)


def sample_key(h: Column, log_weight: Column, k: Column) -> Column:
    """The key of a word (hash ``h``) of a text for sample k."""
    x = F.xxhash64(h, k)
    c = -F.ln(_uniform(x, 0) * _uniform(x, 21))
    v = _uniform(x, 42)  # exp(-r * (1 - b))
    u = -F.ln(_uniform(F.xxhash64(x), 0))  # r * b
    r = u - F.ln(v)
    t = F.floor((log_weight + u) / r)
    # one number for one (word, t), whatever the weight: with t = 0, the only case of weight one, the exponent is ln v
    return F.when((log_weight == 0) | (t == 0), c * v).otherwise(c * F.exp(u - r * (t + F.lit(1.0))))


def next_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, h) with a ``block`` that follows the order of (doc_id, h), plus ghosts.

    A ghost is the first row of a block, given to the block before it as its last row (and the first
    block's to the last one), so that in each block each row but the ghost has its next row.
    """
    count, unnamed = docs.agg(F.count("*"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    cuts = max(1, min(MOST_CUTS, blocks(count, ROWS_PER_BLOCK)))
    within = blocks(blocks(count, cuts), ROWS_PER_BLOCK)
    at = ", ".join(repr(i / cuts) for i in range(cuts + 1))
    bounds = docs.selectExpr(f"percentile_approx(doc_id, array({at}), 10000) AS b").first().b or [0] * (cuts + 1)
    # each range between two cut points, and in it an even cut; rows without id go by their hash
    pairs = sorted(set(zip(bounds, bounds[1:])))
    lows = F.array(*(F.lit(lo).cast("long") for lo, _ in pairs))
    width = F.array(*(F.lit((max(0, hi - lo) + 1) / within) for lo, hi in pairs))
    q = F.greatest(F.lit(0), F.size(F.filter(lows, lambda b: b <= F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))))) - 1)
    marked = docs.withColumn("q", q.cast("int"))
    inside = F.floor((F.col("doc_id") - F.get(lows, F.col("q"))) / F.get(width, F.col("q")))
    named = F.col("q") * within + F.greatest(F.lit(0), F.least(F.lit(within - 1), inside))
    by_hash = F.shiftright("h", 40) + (1 << 23)  # from 0 to 2 ** 24
    nameless = F.floor(by_hash * blocks(unnamed, ROWS_PER_BLOCK) / float(1 << 24)) - blocks(unnamed, ROWS_PER_BLOCK)
    blocked = marked.withColumn("block", F.when(F.col("doc_id").isNull(), nameless).otherwise(named).cast("long")).drop("q")
    firsts = blocked.groupBy("block").agg(F.min(F.struct("doc_id", "h")).alias("f"))
    before = F.lag("block").over(Window.orderBy("block"))
    last = firsts.agg(F.max("block")).first()[0]
    ghosts = firsts.select("block", F.col("f.h").alias("h"), F.col("f.doc_id").alias("first_id"), F.coalesce(before, F.lit(last)).alias("ghost"))
    ghosts = F.broadcast(ghosts) if len(pairs) * within + blocks(unnamed, ROWS_PER_BLOCK) <= 1 << 16 else ghosts  # some numbers a block
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    both = F.array(F.struct(F.col("block"), F.lit(False).alias("is_ghost"), F.lit(0).alias("turn")), F.struct(F.when(is_first, F.col("ghost")).alias("block"), F.lit(True).alias("is_ghost"), F.lit(1).alias("turn")))
    placed = blocked.join(ghosts, ["block", "h"], "left").withColumn("at", F.explode(F.filter(both, lambda x: x["block"].isNotNull())))
    # the filter takes nothing out; a join above would add it to one side only, and the sides would not share their exchange
    return placed.where("at.block is not null").select("h", "doc_id", "text", "at.block", "at.is_ghost", "at.turn")


# No checkpoint goes into the rows that are dealt by block: a plan over one is not recognised as the same, and the texts would be shuffled twice.


def with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows (block, row, is_ghost, turn, doc_id, text, edited), dealt by block."""
    rows = next_rows(docs)
    rows = rows.repartition(F.col("block")) if partitions is None else rows.repartition(partitions, "block")
    order = Window.partitionBy("block").orderBy("turn", "doc_id", "h")
    # rows of one id and text may change places, but are the same in all that is made of them
    seen = rows.withColumn("row", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).drop("h").withColumn("n_chars", F.char_length("text").cast("long"))
    take = F.expr("cast(n_chars div 4 as int)")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - take).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), take))
    return seen.withColumn("edited", edited).drop("next_text")


def weighted_samples(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Rows (block, row, turn, text, edited) -> (block, row, turn, fp, edited_fp), arrays of least keys."""
    pair = F.explode(F.array(F.struct(F.lit(1).alias("o"), F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(0).alias("o"), F.lit(1).alias("e"), F.col("edited").alias("t"))))
    sides = texts.select("block", "row", "turn", pair.alias("s")).select("block", "row", "turn", "s.o", "s.e", "s.t")
    words = sides.select("block", "row", "turn", "o", "e", F.explode_outer(F.split("t", SPACE)).alias("w")).where("w <> ''")
    terms = words.select("block", "row", "turn", "o", "e", F.xxhash64("w").alias("h")).groupBy("block", "row", "turn", "h").agg(F.sum("o").alias("wo"), F.sum("e").alias("we"))
    # a word that weighs the same on both sides is sampled once; ``po`` and ``pe`` keep a key off the side that lacks it
    side = lambda w, po, pe: F.struct(F.ln(w.cast("double")).alias("lw"), F.lit(po).alias("po"), F.lit(pe).alias("pe"))
    wo, we = F.col("wo"), F.col("we")
    sides = F.when(wo == we, F.array(side(wo, 0.0, 0.0))).when(we == 0, F.array(side(wo, 0.0, NONE))).when(wo == 0, F.array(side(we, NONE, 0.0))).otherwise(F.array(side(wo, 0.0, NONE), side(we, NONE, 0.0)))
    weighed = terms.select("block", "row", "turn", "h", F.explode_outer(sides).alias("s")).select("block", "row", "turn", "h", "s.lw", "s.po", "s.pe")
    # so many samples at a time that the generated code stays small enough to be compiled
    part = weighed.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples // SAMPLES_AT_ONCE - 1))).alias("part"))
    keys = [sample_key(F.col("h"), F.col("lw"), F.col("part") * F.lit(SAMPLES_AT_ONCE) + F.lit(j)) for j in range(SAMPLES_AT_ONCE)]
    least = part.groupBy("block", "row", "turn", "part").agg(*(F.min(key + F.col(p)).alias(f"{p}{j}") for p in ("po", "pe") for j, key in enumerate(keys)))
    each = least.select("block", "row", "turn", F.struct("part", *(F.array(*(f"{p}{j}" for j in range(SAMPLES_AT_ONCE))).alias(p) for p in ("po", "pe"))).alias("x"))
    both = each.groupBy("block", "row", "turn").agg(F.array_sort(F.collect_list("x")).alias("x"))
    fp = lambda p: F.when(F.get(F.get("x", F.lit(0))[p], F.lit(0)) < NONE, F.flatten(F.transform("x", lambda y: y[p])))
    return both.select("block", "row", "turn", fp("po").alias("fp"), fp("pe").alias("edited_fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty texts are alike, an empty and another are not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def as_text(fp: Column) -> Column:
    """16 bits of each sample, in hexadecimal."""
    part = lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit(0xFFFF))), 4, "0"))
    return F.coalesce(F.array_join(F.transform(fp, part), ""), F.lit("empty"))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its last quarter replaced by the next one's start, and their likeness."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = with_next(rows)
    prints = weighted_samples(texts.select("block", "row", "turn", "text", F.when(F.col("is_ghost"), F.lit("")).otherwise(F.col("edited")).alias("edited")), samples)
    facts = texts.select("block", "row", "turn", "is_ghost", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    known = facts.join(prints, ["block", "row", "turn"], "left")
    order = Window.partitionBy("block").orderBy("row")
    out = known.withColumn("next_fp", F.lead("fp").over(order)).where("not is_ghost")
    return out.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
