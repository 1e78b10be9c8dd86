"""Line dedup by content-defined chunks, in DataFrame operations only.

Lines are hashed, a polynomial rolling hash runs over the line hashes, and a chunk starts where
that rolling hash is a local minimum. Boundaries depend on nearby lines alone, so an inserted line
shifts no distant chunk, and no chunk of a text of several lines has fewer than two. Chunks whose
hash occurs more than once are compared byte by byte; of each that is equal, the first by
(doc_id, place) stays and the others' lines are removed.

A null text stays null, an empty one empty; texts of one line have no multi-line chunk and stay.
Repeated rows are texts like others: the later copy loses its chunks. Ties of the rolling hash go to
the left line. Rows without id come first in the order, rows of one id by a hash of their texts. Rows of
one id and text are told apart only at the end, so nothing depends on where the input's rows lie. An empty
table gives an empty result. The columns of the input are kept, in a struct on the way, so clashing
names do no harm; a very long text is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.llm.common import documents, materialize

# Fixed values of the rolling hash: 48 bits of a line's hash, the multiplier and the modulus.
HASH_DIGITS, MULTIPLIER, MODULUS = 12, 31, 281474976710597


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, HASH_DIGITS), 16, 10).cast("long"))


def _rolled(hashes: Column) -> Column:
    """The rolling hash at each line, over it and the two lines before."""
    at = lambda i: F.coalesce(F.get(hashes, i), F.lit(0))
    return F.transform(hashes, lambda x, i: (x + MULTIPLIER * at(i - 1) + MULTIPLIER * MULTIPLIER * at(i - 2)) % MODULUS)


def _chunk_starts(rolling: Column) -> Column:
    least = lambda i: (i >= 2) & (i < F.size(rolling) - 1) & (F.get(rolling, i) < F.get(rolling, i - 1)) & (F.get(rolling, i) <= F.get(rolling, i + 1))
    return F.filter(F.sequence(F.lit(0), F.size(rolling) - 1), lambda i: (i == 0) | least(i))


def chunked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_chunks``: the text's chunks in order (null for a null text)."""
    lined = docs.withColumn("_lines", _lines(F.col(text)))
    hashed = lined.withColumn("_hashes", _hashes(F.col("_lines")))
    rolled = hashed.withColumn("_rolling", _rolled(F.col("_hashes")))
    begun = rolled.withColumn("_starts", _chunk_starts(F.col("_rolling")))
    chunk = lambda s, i: F.array_join(F.slice("_lines", s + 1, F.coalesce(F.get("_starts", i + 1), F.size("_lines")) - s), "\n")
    return begun.withColumn("_chunks", F.transform("_starts", chunk)).drop("_lines", "_hashes", "_rolling", "_starts")


#: Hashes of a row's id and of its text.
ROW = ["_row", "_hash"]


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(_row, _hash, _removed): places of the chunks that repeat an earlier one, for rows that have any; and (_row, _hash) of texts that one id has more than once."""
    multi = F.locate("\n", F.col("c")) > 0
    # the outer form: Spark filters before a plain explode by the exploded expression, with all that it is made of put in again
    by_chunk = chunked(docs.select(*ROW, text), text).select(*ROW, F.posexplode_outer("_chunks").alias("p", "c"))
    keyed = materialize(by_chunk.where(multi).select(*ROW, "p", F.xxhash64("c").alias("h")))
    twice = keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    places = keyed.join(twice, "h").groupBy(*ROW).agg(F.collect_set("p").alias("_places"))
    # the bytes of those chunks only
    held = docs.select(*ROW, F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(places, ROW)
    texts = chunked(held, "_text").select(*ROW, "_id", F.explode("_places").alias("p"), "_chunks").select(*ROW, "_id", "p", F.get("_chunks", F.col("p")).alias("c"))
    texts = materialize(texts.withColumn("h", F.xxhash64("c")))
    firsts = texts.groupBy("h", "c").agg(F.min(F.struct("_id", *ROW, "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("fh"), F.col("c").alias("fc"), "first")
    later = texts.join(firsts, (F.col("h") == F.col("fh")) & (F.col("c") == F.col("fc"))).where(~F.struct("_id", *ROW, "p").eqNullSafe(F.col("first")))
    # a text of several lines has its first chunk here
    copied = keyed.where("p = 0").groupBy(*ROW).agg(F.count("*").alias("n")).where("n > 1").select(*ROW)
    return later.groupBy(*ROW).agg(F.collect_set("p").alias("_removed")), copied


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with repeated chunks cut from the text, and ``n_lines`` and ``n_removed_lines``."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    # the other columns travel in a struct, so that no working column has their name
    others = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept) if c != text))
    rows = docs.select(others.alias("others"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.select("*", F.xxhash64("doc_id").alias("_row"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("_hash"))
    removed, copied = repeated_chunks(rows)
    marked = rows.withColumn("_again", F.lit(False))
    if copied.limit(1).count():
        # the first copy keeps what is first there, the others keep no chunk
        copies = rows.join(copied, ROW).withColumn("_again", F.row_number().over(Window.partitionBy(*ROW).orderBy(F.lit(0))) > 1)
        marked = marked.join(copied, ROW, "left_anti").unionByName(copies)
    cut = chunked(marked.join(removed, ROW, "left"))
    every = F.filter(F.sequence(F.lit(0), F.size("_chunks") - 1), lambda i: F.locate("\n", F.get("_chunks", i)) > 0)
    cut = cut.withColumn("_removed", F.when(F.col("_again"), every).otherwise(F.col("_removed")))
    left = F.filter("_chunks", lambda c, i: ~F.array_contains("_removed", i))
    lines = lambda t: F.coalesce(F.size(_lines(t)), F.lit(0))
    gone = F.aggregate(F.filter("_chunks", lambda c, i: F.array_contains("_removed", i)), F.lit(0), lambda n, c: n + F.size(_lines(c)))
    some = F.col("_removed").isNotNull()
    known = F.when(F.col("text").isNull(), 0).otherwise(lines(F.col("text"))).cast("long")
    done = cut.select("others", F.when(some, F.array_join(left, "\n")).otherwise(F.col("text")).alias("text"), known.alias("known"), F.when(some, gone).otherwise(0).cast("long").alias("gone"))
    out = [(F.col("text") if c == text else F.col("others")[f"c{i}"]).alias(c) for i, c in enumerate(kept)]
    return done.select(*out, F.col("known").alias("n_lines"), F.col("gone").alias("n_removed_lines"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir).select("doc_id", "text"))


OP9_SQL = f"""
WITH line AS (
  SELECT doc_id, i - 1 AS i, n, lines[i] AS line, ('0x' || substr(md5(lines[i]), 1, {HASH_DIGITS}))::BIGINT AS h
  FROM (SELECT doc_id, lines, len(lines) AS n, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
), rolled AS (
  SELECT *, (h + {MULTIPLIER} * lag(h, 1, 0) OVER w + {MULTIPLIER * MULTIPLIER} * lag(h, 2, 0) OVER w) % {MODULUS} AS r FROM line WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), begun AS (
  SELECT *, i = 0 OR (i >= 2 AND i < n - 1 AND r < lag(r) OVER w AND r <= lead(r) OVER w) AS starts FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM begun
), chunk AS (
  SELECT doc_id, p, string_agg(line, chr(10) ORDER BY i) AS c, count(*) AS k FROM placed GROUP BY doc_id, p
), judged AS (
  SELECT *, k > 1 AND row_number() OVER (PARTITION BY c ORDER BY doc_id, p) > 1 AS gone FROM chunk
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(c, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') END AS text,
       coalesce(sum(k), 0)::BIGINT AS n_lines, coalesce(sum(k) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id, d.text
"""
