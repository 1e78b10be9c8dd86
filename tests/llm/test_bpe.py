import public_tokenizers
from lineagraph.llm.bpe import ForcedBoundaryBPE, bpe_decode, bpe_encode
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [(e.ids, tokenizer.decode(e.ids, skip_special_tokens=False)) for e in (tokenizer.encode(t or "", add_special_tokens=False) for t in texts)]


def test_same_as_the_library(docs, odd_texts):
    got = bpe_decode(bpe_encode(docs(odd_texts), PATH), PATH).orderBy("doc_id").collect()
    for row, (ids, text) in zip(got, expected(odd_texts), strict=True):
        assert list(memoryview(bytes(row.ids)).cast("I")) == ids
        assert (row.n_tokens, row.decoded) == (len(ids), text)


def test_every_character(docs):
    coder, step = ForcedBoundaryBPE(PATH), 13
    texts = [f"aB{chr(c)}'s1{chr(c)}{chr(c)} z" for c in range(1, 0x30000, step) if not 0xD800 <= c < 0xE000]
    for text, (ids, _) in zip(texts, expected(texts), strict=True):
        assert list(memoryview(coder.encode(text)).cast("I")) == ids, text


def test_a_cut_is_never_inside_a_token():
    coder = ForcedBoundaryBPE(PATH)
    for token in list(coder.ids)[::50]:
        assert len(coder.cut(coder.symbols(token))) == 1


def test_empty_table_and_clashing_columns(spark, docs):
    clash = docs(["a b"]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    assert bpe_decode(bpe_encode(clash, PATH), PATH).first().decoded == "a</w> b</w>"
    assert bpe_decode(bpe_encode(docs([]), PATH), PATH).count() == 0
