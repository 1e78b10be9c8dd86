import base64
import random

import public_tokenizers
import pytest
import tiktoken
from lineagraph.llm import byte_bpe
from lineagraph.llm.byte_bpe import SegmentTreeBPE, byte_bpe_decode, byte_bpe_encode

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return SegmentTreeBPE(PATH, PATTERN)


def ids_of(coder, text):
    return list(memoryview(coder.encode(text)).cast("I"))


def test_same_as_the_library(docs, odd_texts, library):
    got = byte_bpe_decode(byte_bpe_encode(docs(odd_texts), PATH, PATTERN), PATH, PATTERN).orderBy("doc_id").collect()
    for row, text in zip(got, odd_texts, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row.ids == ids and row.n_tokens == len(ids)
        assert bytes(row.decoded) == library.decode_bytes(ids) == (text or "").encode()


def test_every_character(coder, library):
    for c in range(1, 0x110000, 7):
        if not 0xD800 <= c < 0xE000:
            text = f"aB{chr(c)}'s1{chr(c)}{chr(c)} z  {chr(c)}9"
            assert ids_of(coder, text) == library.encode_ordinary(text), hex(c)


def test_random_texts(coder, library):
    """Long pieces of few letters have many equal ranks; merges go on over them."""
    draw = random.Random(4)
    for letters in ("ab", "thein ", "aé漢 \n\t", "0123 .,-", "'sdtm re"):
        for n in (1, 2, 3, 7, 8, 9, 63, 64, 65, 700):
            text = "".join(draw.choice(letters) for _ in range(n))
            assert ids_of(coder, text) == library.encode_ordinary(text), text


def test_trees_against_repeated_least_pair(coder):
    """The merge of least rank, leftmost first, until none applies: in a tree alone and in one among others."""
    together = []
    draw, ranks = random.Random(5), coder.ranks
    for _ in range(300):
        data = bytes(draw.choice(b"therionsal") for _ in range(draw.randint(2, 40)))
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], coder.never), i) for i in range(len(parts) - 1))
            if rank == coder.never:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        expected = [ranks[data]] if data in ranks else [ranks[p] for p in parts]
        assert list(memoryview(coder.merge(data.decode())).cast("I")) == expected
        together.append((data.decode(), expected))
    got = coder.merge_all([piece for piece, _ in together])
    assert [list(memoryview(ids).cast("I")) for ids in got] == [ids for _, ids in together]


def test_a_full_cache_changes_nothing(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 30)
    draw = random.Random(6)
    for _ in range(40):
        texts = [" ".join("".join(draw.choices("thein", k=draw.randint(1, 5))) for _ in range(20)) + " " + "x" * 90 for _ in range(3)]
        assert [list(memoryview(ids).cast("I")) for ids in coder.encode_texts(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(coder.known) < 100 and not any(len(p) > 64 for p in coder.known)


def test_null_repeated_and_clashing_rows(spark):
    rows = [(None, "a b", 1, b"x"), (1, None, 2, b"y"), (1, "a b", 3, b"z"), (1, "a b", 3, b"z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, ids long, decoded binary")
    got = byte_bpe_decode(byte_bpe_encode(table, PATH, PATTERN), PATH, PATTERN)
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "n_tokens"]
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in got.collect()) == [(0, b"a b"), (1, b""), (1, b"a b"), (1, b"a b")]
    assert byte_bpe_decode(byte_bpe_encode(table.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0
    missing = spark.createDataFrame([(None,)], "ids array<int>")
    assert bytes(byte_bpe_decode(missing, PATH, PATTERN).first().decoded) == b""
