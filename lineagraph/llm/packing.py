"""Packing documents into fixed windows at target token proportions.

Each source is a queue. Deficit round-robin serves all queues in rounds, one a window: in each round
a queue earns its quantum of tokens. It saves what it earned, as its deficit, until that is enough for
pieces of ``LEAST_PIECE`` tokens, and gives those. Written in closed form, a queue with weight w and N
tokens has given all whole pieces in min(w * v, N) tokens when the round ends at virtual time v, so
every partition knows where its tokens go without waiting for another, and deficits carry over windows
and partitions alike. Queues that run dry leave their share to the others, so all tokens are packed.
The target proportions are the weights, or, without weights, the sources' shares of all tokens: the
only mixture that lasts to the end where every token has to be packed. A window is off the target by
the pieces that its queues save up or have saved, at most one a queue at each of its ends. The line of
all rounds is cut every ``window`` tokens, so only the last window can be short, and a rare source's
documents come in pieces of at least ``LEAST_PIECE`` tokens, but where a document, a queue or a window
ends.

A null or empty text has only the end token. A null source is the queue with the empty name.
Repeated rows, rows with one id and rows without id are packed each. Documents of a queue come in the
order of a hash, so there are no ties. A long text is cut freely. An empty table gives an empty result.
Only the id, the text and the source are used; other columns do no harm.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagraph.llm.bpe import byte_letters, latin_pre_tokens, pre_tokens, white_space_words
from lineagraph.llm.common import Cache, blocks, documents, materialize, prepare, text_passes, tidy

WINDOW_TOKENS = 2048
END_ID = 1
ROWS_PER_BLOCK = 4096
ROUNDS_PER_BLOCK = 4096
#: Tokens that a queue saves up, as its deficit, before it gives a piece (but for its last one).
LEAST_PIECE = 64


class WordwiseTokenizer:
    """The library's BPE model behind caches of words and pre-tokens, neither of which reaches over white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        self.letters = dict(enumerate(byte_letters()))
        self.words = Cache(self.encode_word)
        self.parts = Cache(self._part)

    def _part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        found = self.model.tokenize(part if plain else part.encode().decode("latin-1").translate(self.letters))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def encode_word(self, word: str) -> bytes:
        if self.special.search(word):
            return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, pre_tokens(word)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.special.search(text) and (parts := latin_pre_tokens(text)) is not None:
            return b"".join(map(self.parts.__getitem__, parts))
        return b"".join(map(self.words.__getitem__, white_space_words(text)))


_loaded: dict[str, WordwiseTokenizer] = {}


def tokenizer(path: str) -> WordwiseTokenizer:
    if path not in _loaded:
        _loaded[path] = WordwiseTokenizer(path)
    return _loaded[path]


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, queue, n, ids): ids with the end token, packed in 16 bits where they fit, else in 32."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = tokenizer(path)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in text_passes(batch):
                out, sizes = [], []
                for text in part.column("text").to_pylist():
                    ids = coder.encode(text)
                    wide = np.frombuffer(ids + end, dtype="<u4")
                    sizes.append(len(wide))
                    out.append((b"\x02" + wide.astype("<u2").tobytes()) if int(wide.max()) < 65536 else b"\x04" + wide.tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("queue"), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "queue", "n", "ids"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"), "text")
    return source.mapInArrow(tidy(run), "doc_id long, queue string, n long, ids binary")


def unpack(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u2" if ids[0] == 2 else "<u4", offset=1)


def _piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """The line through the knots (rising in both), extended flat at both ends."""
    out = F.lit(knots[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:]))):
        if x1 > x0:
            out = F.when(x <= x1, F.lit(y0) + (x - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def queue_offsets(rows: DataFrame, count: int, totals: DataFrame) -> DataFrame:
    """Rows (row, queue, n) with ``a``, the tokens before the row in its queue, by blocks of rows, and the queue's total."""
    nb = blocks(count, ROWS_PER_BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(nb)))
    sums = rows.groupBy("queue", "block").agg(F.sum("n").alias("block_n"))
    before = F.sum("block_n").over(Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("queue", "block", F.coalesce(before, F.lit(0)).alias("block_a")).join(totals, "queue")
    within = F.sum("n").over(Window.partitionBy("queue", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    inside = rows.withColumn("within", F.coalesce(within, F.lit(0)))
    return inside.join(starts.hint("merge"), ["queue", "block"]).select("row", "queue", "n", (F.col("block_a") + F.col("within")).alias("a"), "total")


def placements(rows: DataFrame, window: int = WINDOW_TOKENS, weights: Mapping[str, float] | None = None, least: int = LEAST_PIECE) -> DataFrame:
    """Rows (row, queue, n) -> pieces (row, start, length, sequence_id, offset).

    ``weights`` gives token proportions by queue; a queue without one has its share of all tokens.
    """
    found = rows.agg(F.count("*"), F.sum("n")).first()
    count, total = found[0], found[1] or 0
    totals = rows.groupBy("queue").agg(F.sum("n").alias("total"))
    named = {r.queue: r.total for r in totals.where(F.col("queue").isin(list(weights))).collect()} if weights else {}
    scale = sum(weights[q] for q in named) if named else 1.0
    others = total - sum(named.values())
    # the virtual time is 1 when the unnamed queues run dry; named ones have given weight * total * v tokens
    rate = {q: weights[q] / scale * (total - others) for q in named}
    ends = sorted({*([1.0] if others else []), *(named[q] / rate[q] for q in named if rate[q] > 0)}) or [1.0]
    knots = [(0.0, 0.0)] + [(v, others * min(1.0, v) + sum(min(rate[q] * v, named[q]) for q in named)) for v in ends]
    rounds = blocks(total, window)

    per_v = F.col("total").cast("double")
    for q, r in rate.items():
        per_v = F.when(F.col("queue") == q, F.lit(float(r))).otherwise(per_v)

    def given(k: Column) -> Column:
        """Tokens that the queue has given when round k begins."""
        earned = per_v * _piecewise(k.cast("double") * F.lit(float(window)), [(t, v) for v, t in knots])
        return F.when((k >= rounds) | (earned >= F.col("total")), F.col("total")).otherwise(F.floor(earned / least) * least)

    def round_of(x: Column) -> Column:
        """The round in which the queue has earned x tokens, but for rounding."""
        v = F.least(x, F.col("total")).cast("double") / F.greatest(per_v, F.lit(1e-9))
        return F.least(F.lit(rounds - 1), F.floor(_piecewise(v, knots) / F.lit(float(window))))

    def spread(frame: DataFrame, until: Column, name: str) -> DataFrame:
        """Rows for 0 to ``until``, some a task."""
        spans = frame.select("queue", "total", until.alias("until")).select("*", F.explode(F.sequence(F.lit(0), F.expr(f"until div {ROUNDS_PER_BLOCK}"))).alias("span"))
        last = F.least((F.col("span") + 1) * ROUNDS_PER_BLOCK - 1, F.col("until"))
        return spans.repartition("queue", "span").select("queue", "total", F.explode(F.sequence(F.col("span") * ROUNDS_PER_BLOCK, last)).alias(name))

    # a frequent queue gives in every round, a rare one in those in which a piece is saved up: no row for the others
    frequent = F.col("total") >= rounds * least
    often = spread(totals.where(frequent), F.lit(rounds - 1).cast("long"), "k")
    saved = round_of((F.col("unit") + 1) * least)
    about = F.sequence(F.greatest(F.lit(0), saved - 1), F.least(F.lit(rounds - 1), saved + 1))
    seldom = spread(totals.where(~frequent), F.expr(f"(total - 1) div {least}"), "unit").select("queue", "total", F.explode(about).alias("k")).distinct()
    grid = often.unionByName(seldom).select("queue", "total", "k", given(F.col("k")).alias("lo"), given(F.col("k") + 1).alias("hi")).where("hi > lo")
    grid = grid.withColumn("span", F.expr(f"k div {ROUNDS_PER_BLOCK}"))
    spans = grid.groupBy("span").agg(F.sum(F.col("hi") - F.col("lo")).alias("given"))
    earlier = F.sum("given").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1))  # a row for 4096 windows
    spans = spans.select("span", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum(F.col("hi") - F.col("lo")).over(Window.partitionBy("span").orderBy("k", "queue").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.withColumn("inside", F.coalesce(inside, F.lit(0))).join(spans.hint("merge"), "span").select("queue", "total", "k", "lo", "hi", (F.col("before") + F.col("inside")).alias("at"))

    # rows meet the frequent queues' servings by round and the rare queues' by piece
    unit = lambda x: F.floor(x / least)
    served = F.when(frequent, F.array("k")).otherwise(F.sequence(unit(F.col("lo")), unit(F.col("hi") - 1)))
    grid = grid.select("queue", "lo", "hi", "at", F.explode(served).alias("key"))
    placed = queue_offsets(rows, count, totals)
    first, last = F.greatest(F.lit(0), round_of(F.col("a")) - 1), F.least(F.lit(rounds - 1), round_of(F.col("a") + F.col("n") + least) + 1)
    wanted = F.when(frequent, F.sequence(first, F.greatest(first, last))).otherwise(F.sequence(unit(F.col("a")), unit(F.col("a") + F.col("n") - 1)))
    asked = placed.select("row", "queue", "a", "n", frequent.alias("frequent"), F.explode(wanted).alias("key"))
    cut = asked.join(grid.hint("merge"), ["queue", "key"])
    low = F.when(F.col("frequent"), F.col("lo")).otherwise(F.greatest(F.col("lo"), F.col("key") * least))
    high = F.when(F.col("frequent"), F.col("hi")).otherwise(F.least(F.col("hi"), (F.col("key") + 1) * least))
    begin, end = F.greatest(F.col("a"), low), F.least(F.col("a") + F.col("n"), high)
    pieces = cut.select("row", (begin - F.col("a")).alias("start"), (end - begin).alias("length"), (F.col("at") + begin - F.col("lo")).alias("g")).where("length > 0")
    each = pieces.select("*", F.explode(F.sequence(F.expr(f"g div {window}"), F.expr(f"(g + length - 1) div {window}"))).alias("sequence_id"))
    begin, end = F.greatest(F.col("g"), F.col("sequence_id") * window), F.least(F.col("g") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return each.select("row", (F.col("start") + begin - F.col("g")).alias("start"), (end - begin).alias("length"), "sequence_id", (begin - F.col("sequence_id") * window).alias("offset"))


def pack(docs: DataFrame, path: str, window: int = WINDOW_TOKENS, weights: Mapping[str, float] | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids): each id of each document lies in one piece."""
    encoded = materialize(tokenize(docs, path, end_id).withColumn("row", F.monotonically_increasing_id()))
    pieces = placements(encoded.select("row", "queue", "n"), window, weights)
    by_row = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    fields = ("start", "length", "sequence_id", "offset")

    def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_passes(batch, "ids"):
                own = part.column("pieces")
                cuts = own.offsets.to_numpy() - own.offsets[0].as_py()
                each = own.flatten()
                row = pa.array(np.repeat(np.arange(part.num_rows), np.diff(cuts)))
                start, length = (each.field(f).to_numpy(zero_copy_only=False) * 4 for f in ("start", "length"))
                out: list[bytes] = []
                for ids, low, high in zip(part.column("ids").to_pylist(), cuts.tolist(), cuts[1:].tolist()):
                    data = unpack(ids).astype("<u4").tobytes()
                    out += [data[a : a + n] for a, n in zip(start[low:high].tolist(), length[low:high].tolist())]
                taken = [part.column(c).take(row) for c in ("doc_id", "queue", "n")]
                yield pa.RecordBatch.from_arrays([*taken, *(each.field(f) for f in fields), pa.array(out, pa.binary())], names=["doc_id", "queue", "doc_tokens", *fields, "ids"])

    joined = encoded.join(by_row.hint("merge"), "row").select("doc_id", "queue", "n", "ids", "pieces")
    return joined.mapInArrow(tidy(slices), "doc_id long, queue string, doc_tokens long, start long, length long, sequence_id long, offset long, ids binary")


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs.select("doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(documents(spark, sf_dir))
