"""Byte-level BPE encoding and decoding by a segment tree of pair ranks.

The leaves of the tree are the byte positions of a piece; the leaf where a live symbol begins holds
the rank of its pair with the next symbol, and each inner node the least rank below it, the leftmost
of equal ones. The root so names the next merge, and a merge changes three leaves: of the two symbols
that become one, and of the symbol before. A piece of n bytes takes n log n steps, however long. The
trees of short pieces are rows of one array, and a step merges in all of them at once; a longer piece
has a tree of its own.

Nulls and empty texts give no ids and no bytes. Repeated rows give equal rows, an empty table an empty
result; a very long text without a place to cut is one piece. All input columns but the text are kept
(a column named like an output is replaced).
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.llm.bpe import NEWER_LETTERS, NEWER_NUMBERS, _put
from lineagraph.llm.common import CACHE_WORDS, CACHED_LENGTH, documents, prepare, text_passes, tidy

#: Pieces of up to so many bytes are merged together with others of their size.
SIZES = (8, 16, 32, 64)
#: The least character that any of the newer ones below can be.
_LATE = re.compile("[\u0530-\U0010ffff]")
#: Letters and numbers that the library's Unicode tables don't know yet count as symbols.
_NEWER = regex.compile(f"[{NEWER_LETTERS.replace(' ', '')}{NEWER_NUMBERS.replace(' ', '')}]")


class PairRanks:
    """The rank of the token that two tokens make together, for arrays of pairs: a hash table with open addresses."""

    def __init__(self, ranks: dict[bytes, int], never: int):
        pairs = [(a * never + b, rank) for token, rank in ranks.items() for cut in range(1, len(token)) if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None]
        keys, values = (np.array(x, np.int64) for x in zip(*pairs))
        self.never, self.bits = never, max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, never, np.int32)
        at = self._slot(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``never`` where two tokens make none."""
        keys = left.astype(np.int64) * self.never + right
        at = self._slot(keys)
        out, held = self.values[at], self.keys[at]
        todo = np.flatnonzero((held != keys) & (held >= 0))
        out[held < 0] = self.never
        while len(todo):  # another pair has the slot
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[todo]]
            out[todo] = np.where(held == keys[todo], self.values[at[todo]], self.never)
            todo = todo[(held != keys[todo]) & (held >= 0)]
        return out


class SegmentTreeBPE:
    """Encoder and decoder of a file of ranks (base64 token and rank a line) and a pattern of pieces."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.never = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.never
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_pairs = [self.ranks.get(bytes((a, b)), self.never) for a in range(256) for b in range(256)]
        self.pattern = regex.compile(pattern)
        ascii_pattern = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        # outside brackets a class needs its own; the pattern then is one for Python's quicker engine
        self.ascii_pattern = re.compile(re.sub(r"(?<!\[)(?<!\\s)(A-Za-z|0-9)(?=\+)", r"[\1]", ascii_pattern), re.ASCII)
        self.pair_ranks = PairRanks(self.ranks, self.never)
        self.byte_tokens = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # ids by piece; when full, it becomes the older generation
        self.older: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        if text.isascii():
            return self.ascii_pattern.findall(text)
        if not _LATE.search(text) or not _NEWER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub("#", text))]

    def merge(self, piece: str) -> bytes:
        """Ids of one piece, packed as little-endian unsigned 32-bit integers."""
        data, ranks, never = piece.encode(), self.ranks, self.never
        if (whole := ranks.get(data)) is not None:
            return whole.to_bytes(4, "little")
        n = len(data)
        size = 1 << (n - 1).bit_length()
        idle = never * size  # no pair begins here; else a leaf holds rank * size + position, so that the least is the leftmost
        pairs, get = self.byte_pairs, ranks.get
        leaves = [pairs[a << 8 | b] for a, b in zip(data, data[1:])]
        tree = [idle] * size + [rank * size + i for i, rank in enumerate(leaves)] + [idle] * (size - n + 1)
        for p in range(size - 1, 0, -1):
            a, b = tree[2 * p], tree[2 * p + 1]
            tree[p] = a if a < b else b
        after, before = list(range(1, n + 2)), list(range(-1, n))  # where the next and the last symbol begin
        while (low := tree[1]) < idle:
            i = low & (size - 1)
            j = after[i]
            k = after[j]
            after[i], before[k], h = k, i, before[i]
            tree[size + j] = idle
            tree[size + i] = get(data[i : after[k]], never) * size + i if k < n else idle
            if h >= 0:
                tree[size + h] = get(data[h:k], never) * size + h
            for p in (j, i, h) if h >= 0 else (j, i):
                p = (size + p) >> 1
                while p:
                    a, b = tree[2 * p], tree[2 * p + 1]
                    if b < a:
                        a = b
                    if tree[p] == a:
                        break  # nothing above changes by this leaf
                    tree[p] = a
                    p >>= 1
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return struct.pack(f"<{len(out)}I", *out)

    def merge_together(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The same of many pieces of 2 to ``size`` bytes, ``size`` a power of two; a row holds the tree of a piece."""
        count, idle, shift = len(pieces), self.never * size, size.bit_length() - 1
        n = np.fromiter(map(len, pieces), np.int64, count)
        column = np.arange(size)
        inside = column < n[:, None]
        symbols = np.full((count, size + 1), -1, np.int32)  # the live symbol that begins at a position, else -1
        symbols[:, :size][inside] = self.byte_tokens[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, size + 2, dtype=np.int32), (count, size + 1)).copy()
        before = np.broadcast_to(np.arange(-1, size, dtype=np.int32), (count, size + 1)).copy()
        tree = np.full((count, 2 * size), idle, np.int32)
        paired = column[:-1] + 1 < n[:, None]
        ranks = self.pair_ranks.of(symbols[:, : size - 1][paired], symbols[:, 1:size][paired])
        tree[:, size : 2 * size - 1][paired] = ranks * size + np.nonzero(paired)[1]
        for p in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * p], tree[:, 2 * p + 1], out=tree[:, p])
        nodes, flat, at_after, at_before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
        rows = np.arange(count)
        while True:
            low = tree[rows, 1]
            going = low < idle
            rows, low = rows[going], low[going]
            if not len(rows):
                break
            i, rank, at = low & (size - 1), low >> shift, rows * (size + 1)
            j = at_after[at + i]
            k, h = at_after[at + j], at_before[at + i]
            flat[at + i], flat[at + j] = rank, -1
            at_after[at + i], at_before[at + k] = k, i
            right, left = flat[at + k], flat[at + np.maximum(h, 0)]
            last, first = k >= n[rows], h < 0
            base = rows * (2 * size)
            p = base + size
            nodes[p + j] = idle
            nodes[p + i] = np.where(last, idle, self.pair_ranks.of(rank, np.where(last, 0, right)) * size + i)
            before_it = np.where(first, i, h)  # without a symbol before, the same leaf again
            nodes[p + before_it] = np.where(first, nodes[p + i], self.pair_ranks.of(np.where(first, 0, left), rank) * size + before_it)
            for up in range(1, shift + 1):
                for leaf in (j, i, before_it):
                    node = (leaf + size) >> up
                    below = base + 2 * node
                    nodes[base + node] = np.minimum(nodes[below], nodes[below + 1])
        live = symbols[:, :size] >= 0
        packed, ends = symbols[:, :size][live].astype("<u4").tobytes(), np.cumsum(live.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, packed."""
        out, bins = [b""] * len(pieces), {size: [] for size in SIZES}
        for i, piece in enumerate(pieces):
            data = piece.encode()
            if (whole := self.ranks.get(data)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif size := next((s for s in SIZES if len(data) <= s), None):
                bins[size].append((i, data))
            else:
                out[i] = self.merge(piece)
        for size, held in bins.items():
            if held:
                for (i, _), ids in zip(held, self.merge_together([data for _, data in held], size)):
                    out[i] = ids
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; pieces that no text had yet are merged together."""
        split = [self.split(t) if t else [] for t in texts]
        asked = set(itertools.chain.from_iterable(split))
        fresh = asked.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.older, self.known = self.known, {}
            fresh = asked
        again = [p for p in fresh if p in self.older]
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        fresh = list(fresh.difference(again))
        self.known.update(zip(fresh, self.merge_all(fresh)))
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]
        for piece in fresh:
            if len(piece) > CACHED_LENGTH:
                del self.known[piece]
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_texts([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], SegmentTreeBPE] = {}


def load(path: str, pattern: str) -> SegmentTreeBPE:
    """The encoder of a file and a pattern, kept for the life of a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = SegmentTreeBPE(path, pattern)
    return _loaded[path, pattern]


def byte_bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Replace the text by ``n_tokens`` and ``ids`` (an array of ranks)."""
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            for part in text_passes(batch, text):
                packed = encoder.encode_texts(part.column(text).to_pylist())
                ends = np.cumsum([0, *(len(i) // 4 for i in packed)], dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"), pa.int32()))
                yield _put(part, text, n_tokens=pa.array(np.diff(ends), pa.int64()), ids=ids)

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint", "ids array<int>"])
    return source.mapInArrow(tidy(run), schema)


def byte_bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the tokens' bytes put end to end (binary, as ids may not be whole UTF-8)."""
    prepare(encoded.sparkSession)
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(path, pattern)
        for batch in batches:
            column = batch.column(ids)
            decoded = pa.array((decoder.decode(column[i].values.to_numpy(zero_copy_only=False).tolist() if column[i].is_valid else ()) for i in range(batch.num_rows)), pa.binary())
            yield _put(batch, "decoded", decoded=decoded)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded binary"])
    return encoded.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(tidy(run), schema)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return byte_bpe_decode(encoded, path, pattern).select("doc_id", "n_tokens", F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
