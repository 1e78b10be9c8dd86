"""Helpers shared by the corpus operators: reading, worker paths, word spans and hashes.

The hashing helpers work on whole Arrow batches with NumPy, so that per-word Python never runs.
"""

from __future__ import annotations

import ctypes
import functools
import math
import os
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.checkpoints import settle

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that one NumPy pass takes at once (a longer document is one pass of its own).
PASS_BYTES = 1 << 20
#: Rows that go to a Python worker at once: whole texts are long, so fewer than Spark's own setting.
ARROW_ROWS = "1000"
#: Words, of at most so many characters, that a generation of a worker's cache holds; there are two: some 80 MB.
CACHE_WORDS, CACHED_LENGTH = 200_000, 64


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and give them fewer rows at once than Spark's own setting."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *filter(None, paths)])
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return settle(df)


def release() -> None:
    """Give memory that this worker no longer uses back to the system; Spark keeps workers for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not a GNU C library


def tidy(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A worker function over batches that leaves no unused memory behind."""

    @functools.wraps(run)
    def whole(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


class Cache(dict):
    """Values by word, made on demand. When full, it becomes the older generation and a new one begins."""

    def __init__(self, make: Callable):
        self.make = make
        self.older: dict = {}

    def __missing__(self, word: Sequence) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self.make(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


def fresh(names: Iterable[str], name: str) -> str:
    """``name``, made longer while it clashes with one of the names (as Spark compares them, without case)."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``rows`` rows."""
    return max(1, math.ceil(rows / per_block))


def text_crc32(col: str = "text"):
    return F.crc32(F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8"))


def crc_mod(col: str, n: int):
    """crc32 of an integer column as decimal text, modulo n (null ids count as empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")) % n


def text_passes(batch: pa.RecordBatch, column: str = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most`` bytes of text or a single row."""
    if not batch.num_rows:
        return
    sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column put end to end, and the n+1 offsets (null is empty)."""
    data = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset : data.offset + len(data) + 1]
    raw = data.buffers()[2]
    flat = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every run of non-space bytes inside a document, and its document's row."""
    n = len(flat)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[flat]
    begins, finishes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] |= inside[1:-1][edge]
    finishes[edge - 1] |= inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240817).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the multiplier, or of its inverse modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _MULTIPLIER if kind == "up" else np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
        have = np.full(max(n, PASS_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PASS_BYTES + 1:
            _powers[kind] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, A-Z as a-z if asked; equal spans have equal hashes everywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(flat)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[LOWER[flat] if lower else flat] * _power("up", n), out=running[1:])
    return mix64((running[ends] - running[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` word hashes (runs over document edges included; mask them)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
    return mix64(out)
