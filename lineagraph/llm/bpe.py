"""BPE encoding and decoding by forced boundaries.

A byte pair that stands inside no vocabulary token can never be merged over, so a cut there is
certain. Each pre-token is cut at all such pairs, the fragments are encoded on their own (most
recur, so a small cache serves them) and their ids are put end to end.

Nulls and empty texts give no ids and an empty decoded text; a lone word of any length is one
pre-token and goes through a heap, so its time stays near-linear. Repeated rows give equal rows,
an empty table an empty result, and all input columns but the text are kept (a column named like
an output is replaced).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineagraph.llm.common import Cache, documents, prepare, text_passes, tidy

# What ends a word's last symbol, and the pre-tokenizer's pattern of the vocabulary file.
WORD_END = "</w>"
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII, and for lower-case Latin letters below U+0250.
ASCII_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")
LATIN_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^ \t-\r\x85\xa0a-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
#: Separators that str.split takes as white space though Unicode doesn't.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
WHITE_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


# Letters and numbers newer than the Unicode version of the tokenizers library, which takes them as symbols.
NEWER_LETTERS = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a \U00011db0-\U00011ddb \U00011df1 "
    "\U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff3 \U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 "
    "\U00018d80-\U00018df2 \U00018e00-\U00019191 \U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 "
    "\U0001df2b-\U0001df81 \U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 "
    "\U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e \U0002cea2-\U0002cead "
    "\U000323b0-\U00033479 \U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = "\U00011de0-\U00011de9 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ff4-\U00016ff6"
_NEWER = NEWER_LETTERS.replace(" ", "") + NEWER_NUMBERS.replace(" ", "")
_HAS_NEWER = regex.compile(f"[{_NEWER}]")


# Lower-case forms that the library knows and Python's str.lower doesn't yet.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: No final form of sigma: the library lower-cases each character on its own.
NEWER_LOWER |= {0x3A3: 0x3C3}


def latin_pre_tokens(text: str) -> list[str] | None:
    """The same of a text of Latin letters, white space and all; None for other texts."""
    lowered = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()
    if lowered.isascii():
        return ASCII_PRE_TOKEN.findall(lowered)
    return LATIN_PRE_TOKEN.findall(lowered) if max(lowered) < "\u0250" else None


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text without special tokens, normalised and lower-cased."""
    if (parts := latin_pre_tokens(text)) is not None:
        return parts
    text = unicodedata.normalize("NFC", text)
    text = text.translate(NEWER_LOWER).lower()
    if not _HAS_NEWER.search(text):
        return PRE_TOKEN.findall(text)
    # newer characters count as symbols: put a plain symbol in their place and take the spans
    return [text[m.start() : m.end()] for m in PRE_TOKEN.finditer(_HAS_NEWER.sub("#", text))]


def white_space_words(text: str) -> list[str]:
    """The runs between Unicode white space; no token of these vocabularies reaches over it."""
    return [w for w in WHITE_SPACE.split(text) if w] if ODD_SPACE.search(text) else text.split()


class ForcedBoundaryBPE:
    """Encoder and decoder of a vocabulary file with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in (self.ids | self.special).items():
            self.tokens[i] = token
        self.letters = byte_letters()
        self.inside = self._pairs_inside_tokens()
        self.packed = {s: i.to_bytes(4, "little") for s, i in self.ids.items()}
        self.fragments = Cache(self.merge)
        self.parts = Cache(self._pre_token)
        self.words = Cache(self.encode_word)

    def symbols(self, token: str) -> list[str]:
        end = token.endswith(WORD_END) and len(token) > len(WORD_END)
        out = list(token[: -len(WORD_END)] if end else token)
        if end:
            out[-1] += WORD_END
        return out

    def _pairs_inside_tokens(self) -> set[tuple[str, str]]:
        pairs: set[tuple[str, str]] = set()
        for token in self.ids:
            symbols = self.symbols(token)
            pairs.update(zip(symbols, symbols[1:]))
        return pairs

    def cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between the pairs that no token holds."""
        out, start = [], 0
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in self.inside:
                out.append(tuple(symbols[start:i]))
                start = i
        out.append(tuple(symbols[start:]))
        return out

    def merge(self, fragment: tuple[str, ...]) -> bytes:
        """Ids of one fragment: the merge of lowest rank, leftmost first, until none applies."""
        if len(fragment) > 48:
            return self._merge_long(fragment)
        ranks, never = self.ranks, len(self.ranks)
        symbols = list(fragment)
        order = [ranks.get(pair, never) for pair in zip(symbols, symbols[1:])]
        while order and (low := min(order)) < never:
            i = order.index(low)
            symbols[i] += symbols.pop(i + 1)
            del order[i]
            if i:
                order[i - 1] = ranks.get((symbols[i - 1], symbols[i]), never)
            if i < len(order):
                order[i] = ranks.get((symbols[i], symbols[i + 1]), never)
        return b"".join(map(self.packed.__getitem__, symbols))

    def _merge_long(self, fragment: tuple[str, ...]) -> bytes:
        """The same by a heap over linked symbols."""
        symbols, n = list(fragment), len(fragment)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j], k = a + b, "", after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
        return b"".join(self.packed[s] for s in symbols if s)

    def _pre_token(self, part: str) -> bytes:
        symbols = [self.letters[b] for b in part.encode()]
        symbols[-1] += WORD_END
        return b"".join(map(self.fragments.__getitem__, self.cut(symbols)))

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens and white space."""
        return b"".join(map(self.parts.__getitem__, pre_tokens(text)))

    def encode_word(self, word: str) -> bytes:
        parts = self.special_split.split(word) if self.special_split else [word]
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in parts if p)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not (self.special_split and self.special_split.search(text)) and (parts := latin_pre_tokens(text)) is not None:
            return b"".join(map(self.parts.__getitem__, parts))
        return b"".join(map(self.words.__getitem__, white_space_words(text)))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_loaded: dict[str, ForcedBoundaryBPE] = {}


def load(path: str) -> ForcedBoundaryBPE:
    """The encoder of a file, kept for the life of a worker."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def _put(batch: pa.RecordBatch, drop: str, **columns: pa.Array) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n != drop and n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *columns.values()], names=[*kept, *columns])


def bpe_encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replace the text by ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit)."""
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            for part in text_passes(batch, text):
                ids = [encoder.encode(t) for t in part.column(text).to_pylist()]
                yield _put(part, text, n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()), ids=pa.array(ids, pa.binary()))

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint", "ids binary"])
    return source.mapInArrow(tidy(run), schema)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the tokens' strings of the packed ids, joined by spaces."""
    prepare(encoded.sparkSession)
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = load(path)
        for batch in batches:
            for part in text_passes(batch, ids):
                yield _put(part, "decoded", decoded=pa.array([decoder.decode(i or b"") for i in part.column(ids).to_pylist()], pa.string()))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "decoded string"])
    return encoded.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(tidy(run), schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), path)
    return bpe_decode(encoded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
