"""Language-model scores from Elias-Fano n-gram tries of order three.

The model interpolates with a prior: p(w | h) = (c(hw) + K * p(w | h')) / (c(h) + K), where h' is h
without its first word, K is ``PRIOR`` and p(w) is the add-0.1 share of the word. Documents are dealt
to chunks by id and text. A chunk sends, once each and with their training counts, the words, the
pairs and the triples it needs to shards: words by word, the others by context, but the pairs of words
so common that they would fill a shard by pair. It writes only to shards to which it has something to
say, so messages are no more than n-grams. A shard sums the counts of all chunks. Its n-grams become a
trie: level one holds the contexts, a monotone sequence of pointers leads to each context's successors
on level two, beside them lie the quantised smoothed probabilities and the contexts' back-off weights.
All three are Elias-Fano coded in one block of bytes, mapped into memory, that ``write`` stores as a
file and ``open`` maps. Shards answer each chunk from the coded levels: they find the context, take its
range from the pointers and search the successor in that range. The chunk adds the lower orders and
sums by document.

So no task holds the model: a shard has one slice, a chunk its own texts and answers. Scores do not
depend on how many chunks and shards there are, but for collisions: contexts keep 40 bits of their hash
beside the shard, successors 32 bits in their context.

Null and empty texts are the end token alone. Rows that share an id are scored each; rows without id are
held out, as the empty text's checksum is zero. Without training tokens all scores fall back to the
unseen share. A very long text is one chunk's. An empty table gives an empty result. Only id and text
are used; other columns do no harm.
"""

from __future__ import annotations

import mmap
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.llm.common import blocks, documents, mix64, prepare, release, span_hashes, text_passes, tidy, utf8_of, word_spans

CHUNK_BYTES = 8 << 20
#: The pairs after a word of more training tokens are dealt to shards each on its own.
COMMON_TOKENS = CHUNK_BYTES // 8
#: The prior's weight, in tokens.
PRIOR = 8.0
_BEGIN, _END = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Contexts keep the upper 40 bits of their hash as a name; the lower ones choose the shard.
_NAME, _SHARD_BITS = np.uint64(24), np.uint64(0xFFFFFF)
_SUCCESSOR = np.uint64(32)
#: Quantised probabilities: 16 bits of -log10, up to DEPTH; the last code is absence.
DEPTH, ABSENT = 12.0, 65535

_POPULATION = np.array([i.bit_count() for i in range(256)], np.uint8)
_SELECT = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of the i-th set bits of 64-bit words, given how many are set before each word."""
    word = np.searchsorted(before, i, side="right") - 1
    left = i - before[word]
    octets = np.ascontiguousarray(words[word]).view(np.uint8).reshape(-1, 8)
    running = np.cumsum(_POPULATION[octets], axis=1, dtype=np.int64)
    octet = (running <= left[:, None]).sum(1)
    each = np.arange(len(i))
    left = left - np.where(octet > 0, running[each, octet - 1], 0)
    return word * 64 + octet * 8 + _SELECT[octets[each, octet], left]


class EliasFano:
    """A rising sequence of whole numbers, searched as it is coded: low bits packed, high parts in unary.

    Beside the code lie counts of the set and unset bits before each of its words of 64.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int, bits: int):
        self.low, self.high, self.n, self.bits = low, high, n, bits
        self.lows = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        ones = _POPULATION[high.view(np.uint8).reshape(-1, 8)].sum(1, dtype=np.int64)
        self.ones = np.cumsum(ones) - ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - self.ones

    @classmethod
    def coded(cls, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        spread = np.zeros((n, bits), np.uint8)
        for b in range(bits):
            spread[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        size = (top >> bits) + n + 1
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        low = np.packbits(spread.reshape(-1), bitorder="little")
        return np.concatenate([low, np.zeros(8 + -(len(low) + 8) % 8, np.uint8)]), np.packbits(unary, bitorder="little").view("<u8"), n, bits

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        return cls(*cls.coded(values))

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.lows[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = _select(self.high, self.ones, i) - i
        return high.astype(np.uint64) << np.uint64(self.bits) | self.low_bits(i)

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Per value the first place in [low, high) that holds no smaller one, else high."""
        part = (values >> np.uint64(self.bits)).astype(np.int64)
        parts = len(self.high) * 64 - self.n  # unset bits
        known = np.minimum(part, parts - 1)
        start = np.where(known > 0, _select(~self.high, self.zeros, np.maximum(known - 1, 0)) - known + 1, 0)
        end = np.minimum(_select(~self.high, self.zeros, known) - known, self.n)
        start, end = np.clip(np.where(part > known, self.n, start), low, high), np.clip(np.where(part > known, self.n, end), low, high)
        wanted = values & np.uint64((1 << self.bits) - 1)
        while (open_ := np.flatnonzero(start < end)).size:  # those of one high part are few
            mid = (start[open_] + end[open_]) >> 1
            less = self.low_bits(mid) < wanted[open_]
            start[open_[less]] = mid[less] + 1
            end[open_[~less]] = mid[~less]
        return start


def quantised(share: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(share) / DEPTH * (ABSENT - 1)), 0, ABSENT - 1).astype("<u2")


def dequantised(codes: np.ndarray) -> np.ndarray:
    """0 for absence."""
    return np.where(codes == ABSENT, 0.0, 10.0 ** (-codes.astype(np.float64) / (ABSENT - 1) * DEPTH))


class NgramTrie:
    """Contexts, pointers, successors, quantised probabilities and back-off weights of one shard, in one block of bytes."""

    def __init__(self, block: np.ndarray):
        head, at, levels = np.array(block[:96]).view("<i8").reshape(3, 4), 96, []
        for n, bits, low, high in head.tolist():
            levels.append(EliasFano(block[at : at + low], block[at + low : at + low + high].view("<u8"), n, bits))
            at += low + high
        self.block, (self.contexts, self.pointers, self.successors) = block, levels
        n = self.successors.n
        self.codes, self.backs = block[at : at + 2 * n].view("<u2"), block[at + 2 * n : at + 2 * n + 2 * self.contexts.n].view("<u2")

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, count: np.ndarray, totals: dict[int, int] | None = None, prior: float = PRIOR) -> NgramTrie:
        """From distinct pairs of context and successor, sorted, with counts of one or more. ``totals`` are
        of contexts whose n-grams are not all here."""
        names, begin = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(names), dtype=np.uint64), np.diff(np.append(begin, len(context))))
        total = np.add.reduceat(count, begin).astype(np.float64) if len(begin) else np.zeros(0)
        for name, n in (totals or {}).items():
            i = int(np.searchsorted(names, np.uint64(name)))
            if i < len(names) and int(names[i]) == name:
                total[i] = n
        codes, backs = quantised(count / (total[rank.astype(np.int64)] + prior)), quantised(prior / (total + prior))
        coded = [EliasFano.coded(v) for v in (names, np.append(begin, len(context)).astype(np.uint64), rank << _SUCCESSOR | successor)]
        head = np.array([v for low, high, n, bits in coded for v in (n, bits, len(low), 8 * len(high))], "<i8")
        parts = [head.view(np.uint8), *(x.view(np.uint8) for low, high, _, _ in coded for x in (low, high)), codes.view(np.uint8), backs.view(np.uint8)]
        block = np.frombuffer(mmap.mmap(-1, sum(map(len, parts))), np.uint8)
        np.concatenate(parts, out=block)
        return cls(block)

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability's code of each pair (ABSENT where the trie has none), and the back-off weight's code of its context."""
        share, back = np.full(len(context), ABSENT, "<u2"), np.zeros(len(context), "<u2")
        if not self.contexts.n:
            return share, back
        new = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        asked = context[new]
        none = np.zeros(len(asked), np.int64)
        rank = self.contexts.successor(asked, none, none + self.contexts.n)
        at = np.minimum(rank, self.contexts.n - 1)
        known = (rank < self.contexts.n) & (self.contexts.get(at) == asked)
        low, high = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        size = np.diff(np.append(new, len(context)))
        back[:] = np.repeat(np.where(known, self.backs[at], 0), size)
        todo = np.flatnonzero(np.repeat(known, size))
        at, low, high = (np.repeat(x, size)[todo] for x in (at, low, high))
        value = at.astype(np.uint64) << _SUCCESSOR | successor[todo]
        place = self.successors.successor(value, low, high)
        inside = np.minimum(place, self.successors.n - 1)
        hit = (place < high) & (self.successors.get(inside) == value)
        share[todo[hit]] = self.codes[inside[hit]]
        return share, back

    def write(self, path: str) -> None:
        Path(path).write_bytes(self.block.tobytes())

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """Map the levels of a file into memory; pages are read as they are needed."""
        return cls(np.memmap(path, np.uint8, "r"))


# --- packed messages between chunks and shards ---


def _small(counts: np.ndarray) -> bytes:
    """Counts in one byte each where they fit; the others after them."""
    large = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def _read_small(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(data, "<u8", len(large), n).astype(np.int64)
    return out, n + 8 * len(large)


def _names(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _read_names(data: memoryview, n: int, at: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8, 5 * n, at).reshape(n, 5)
    return out.view("<u8").reshape(-1), at + 5 * n


def _pack_words(word: np.ndarray, count: np.ndarray) -> bytes:
    return len(word).to_bytes(4, "little") + word.astype("<u8").tobytes() + _small(count)


def _unpack_words(message: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(message[:4], "little")
    return np.frombuffer(message, "<u8", n, 4), _read_small(memoryview(message)[4 + 8 * n :], n)[0]


def _context_starts(context: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)


def _pack_ngrams(context: np.ndarray, successor: np.ndarray, count: np.ndarray) -> bytes:
    begin = _context_starts(context)
    size = np.diff(np.append(begin, len(context)))
    return len(begin).to_bytes(4, "little") + len(context).to_bytes(4, "little") + _names(context[begin]) + _small(size) + successor.astype("<u4").tobytes() + _small(count)


def _unpack_ngrams(message: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = memoryview(message)
    contexts, n = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:8], "little")
    names, at = _read_names(data, contexts, 8)
    size, used = _read_small(data[at:], contexts)
    successor = np.frombuffer(data, "<u4", n, at + used).astype(np.uint64)
    return np.repeat(names, size), successor, _read_small(data[at + used + 4 * n :], n)[0]


def token_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, an end after each text, and their rows, in order."""
    flat, offsets = utf8_of(text)
    starts, ends, row = word_spans(flat, offsets)
    n = len(offsets) - 1
    rows = np.concatenate([row, np.arange(n)])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([span_hashes(flat, starts, ends), np.full(n, _END)])[order], rows[order]


def _held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i in ids], bool)


class Ngrams:
    """The distinct n-grams of a chunk, in the order of the messages to shards."""

    def __init__(self, context: np.ndarray, token: np.ndarray, train: np.ndarray, shards: int, common: np.ndarray):
        contexts, context_of = np.unique(context, return_inverse=True)
        keys, self.of = np.unique(context_of.astype(np.uint64) << _SUCCESSOR | token >> _SUCCESSOR, return_inverse=True)
        full = contexts[(keys >> _SUCCESSOR).astype(np.int64)]
        successor = keys & np.uint64(0xFFFFFFFF)
        shard = (full & _SHARD_BITS) % np.uint64(shards)
        if len(common):
            shard = np.where(np.isin(full, common), mix64(full + successor) % np.uint64(shards), shard)
        self.order = np.argsort(shard.astype(np.int64), kind="stable")
        self.context, self.successor = (full >> _NAME)[self.order], successor[self.order]
        self.count = np.bincount(self.of, train, len(keys)).astype(np.int64)[self.order]
        shard = shard[self.order]
        self.shards = np.unique(shard)
        self.cut = np.append(np.searchsorted(shard, self.shards), len(shard))

    def parts(self):
        return zip(self.shards.tolist(), map(slice, self.cut.tolist(), self.cut[1:].tolist()))

    def read(self, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per token the share and the back-off weight."""
        share, back = np.zeros(len(self.order)), np.ones(len(self.order))
        for s, cut in self.parts():
            codes = np.frombuffer(answers[s], "<u2")
            n = cut.stop - cut.start
            begin = _context_starts(self.context[cut])
            share[self.order[cut]] = dequantised(codes[:n])
            back[self.order[cut]] = dequantised(np.repeat(codes[n:], np.diff(np.append(begin, n))))
        return share[self.of], back[self.of]


class ChunkTokens:
    """The tokens of a chunk's documents and their distinct words, pairs and triples."""

    def __init__(self, ids: list, text: pa.Array, shards: int, common: np.ndarray):
        self.token, self.row = token_hashes(text)
        self.n = len(ids)
        self.held_out = _held_out(ids)
        train = ~self.held_out[self.row]
        first = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if len(self.row) else np.zeros(0, bool)
        last = np.where(first, _BEGIN, np.roll(self.token, 1))
        before = np.where(first, _BEGIN, np.roll(last, 1))
        self.word, self.word_of = np.unique(self.token, return_inverse=True)
        self.word_count = np.bincount(self.word_of, train, len(self.word)).astype(np.int64)
        shard = (self.word % np.uint64(shards)).astype(np.int64)
        self.word_order = np.argsort(shard, kind="stable")
        self.word_shards = np.unique(shard)
        self.word_cut = np.append(np.searchsorted(shard[self.word_order], self.word_shards), len(shard))
        self.levels = {
            2: Ngrams(mix64(last), self.token, train, shards, common),
            3: Ngrams(mix64(last * np.uint64(0x9E3779B97F4A7C15) + mix64(before)), self.token, train, shards, common[:0]),
        }

    def word_parts(self):
        return zip(self.word_shards.tolist(), (self.word_order[a:b] for a, b in zip(self.word_cut, self.word_cut[1:])))

    def messages(self):
        """(kind, shard, message) to the shards that hold one of the n-grams."""
        for s, some in self.word_parts():
            yield 1, s, _pack_words(self.word[some], self.word_count[some])
        for kind, level in self.levels.items():
            for s, cut in level.parts():
                yield kind, s, _pack_ngrams(level.context[cut], level.successor[cut], level.count[cut])

    def scores(self, answers: dict[int, dict[int, bytes]], tokens: int, distinct: int) -> dict[str, np.ndarray]:
        counts = np.zeros(len(self.word), np.int64)
        for s, some in self.word_parts():
            counts[some] = np.frombuffer(answers[1][s], "<i8")
        low = ((counts + 0.1) / (tokens + 0.1 * (distinct + 1)))[self.word_of]
        p = low
        for kind, level in self.levels.items():
            share, back = level.read(answers[kind])
            p = share + back * p
        total = lambda x: np.bincount(self.row, x, self.n)
        return {
            "n_tokens": total(None).astype(np.int64),
            "n_known": total(counts[self.word_of] > 0).astype(np.int64),
            "train_tokens": np.full(self.n, tokens, np.int64),
            "base_score": total(np.log10(low)),
            "score": total(np.log10(p)),
        }


def _answer_words(messages: list[bytes]) -> list[bytes]:
    read = [_unpack_words(m) for m in messages]
    words, back = np.unique(np.concatenate([w for w, _ in read]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([c for _, c in read]), len(words)).astype("<i8")
    cut = np.cumsum([0, *(len(w) for w, _ in read)])
    return [counts[back[a:b]].tobytes() for a, b in zip(cut, cut[1:])]


def _answer_ngrams(messages: list[bytes], totals: dict[int, int]) -> list[bytes]:
    read = [_unpack_ngrams(m) for m in messages]
    context, successor, count = (np.concatenate([r[i] for r in read]) for i in range(3))
    seen = count > 0
    c, s, n = context[seen], successor[seen], count[seen]
    order = np.lexsort((s, c))
    c, s, n = c[order], s[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (s[1:] != s[:-1])])) if len(c) else np.zeros(0, np.int64)
    trie = NgramTrie.of(c[begin], s[begin], np.add.reduceat(n, begin) if len(begin) else n, totals)
    del context, successor, count, seen, c, s, n, order, begin
    out = []
    for a, b, _ in read:
        codes, backs = trie.find(a, b)
        out.append(codes.tobytes() + backs[_context_starts(a)].tobytes())
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the training tokens of each word that has any, by its hash."""

    def run(batches):
        for batch in batches:
            for part in text_passes(batch, most=CHUNK_BYTES):
                token, row = token_hashes(part.column("text"))
                words, n = np.unique(token[~_held_out(part.column("doc_id").to_pylist())[row]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Train on the documents whose crc32 of the id modulo 10 is not 0 and score all of them."""
    prepare(docs.sparkSession)
    known = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = shards = blocks(size, chunk_bytes)
    # the text spreads rows without id and rows of one id
    dealt = known.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    # the words of more tokens than a shard should hold are fewer than the shards; before the first word of a text stands what is counted after its last
    often = F.collect_list(F.when(F.col("n") > COMMON_TOKENS, F.struct("word", "n")))
    tokens, distinct, listed = word_counts(known).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), often).first()
    most = {int(r.word) & (2**64 - 1): r.n for r in listed} if shards > 1 else {}
    if int(_END) in most:
        most[int(_BEGIN)] = most.pop(int(_END))
    common = mix64(np.array(list(most), np.uint64)) if most else np.zeros(0, np.uint64)
    totals = dict(zip((common >> _NAME).tolist(), most.values()))

    def order(table: pa.Table) -> pa.Table:
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()

    def chunk_tokens(t: pa.Table) -> ChunkTokens:
        column = t.column("text").combine_chunks()
        return ChunkTokens(t.column("doc_id").to_pylist(), column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, shards, common)

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        rows = [(kind, shard, chunk, message) for kind, shard, message in chunk_tokens(order(table)).messages()]
        release()
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["kind", "shard", "chunk", "message"])

    def answer(table: pa.Table) -> pa.Table:
        kind, messages = table.column("kind")[0].as_py(), table.column("message").to_pylist()
        answers = _answer_words(messages) if kind == 1 else _answer_ngrams(messages, totals if kind == 2 else {})
        release()
        return pa.table([table.column("kind"), table.column("shard"), table.column("chunk"), pa.array(answers, pa.binary())], names=["kind", "shard", "chunk", "message"])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        got: dict[int, dict[int, bytes]] = {1: {}, 2: {}, 3: {}}
        for k, s, m in zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "message"))):
            got[k][s] = m
        t = order(table)
        own = chunk_tokens(t)
        found = own.scores(got, tokens, distinct)
        out = pa.table([t.column("doc_id"), pa.array(own.held_out), *(pa.array(v) for v in found.values())], names=["doc_id", "held_out", *found])
        del own, got
        release()
        return out

    schema = "kind int, shard int, chunk int, message binary"
    asked = dealt.groupBy("chunk").applyInArrow(ask, schema)
    answered = asked.groupBy("kind", "shard").applyInArrow(answer, schema)
    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(finish, OUT)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
