"""Sharding, fingerprints, line chunks and packing against their contracts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from lineagraph.llm import sharding
from lineagraph.llm.cws import edited_fingerprints, weighted_samples
from lineagraph.llm.line_dedup import line_dedup
from lineagraph.llm.packing import pack
from lineagraph.llm.sharding import shard_documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_shards_are_even_and_keep_groups(docs, odd_texts):
    texts = odd_texts + [f"text {i}" for i in range(60)] + ["hot copy"] * 50 + [f"pair {i // 2}" for i in range(40)]
    got = shard_documents(docs(texts), shards=5).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(texts) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(5))
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
    of = {r.doc_id: r.shard for r in got}
    cut = sum(len({of[i] for i, t in enumerate(texts) if t == f"pair {k}"}) > 1 for k in range(20))
    assert cut <= 1
    assert shard_documents(docs([]), shards=5).count() == 0
    assert [(r.shard, r.slot) for r in shard_documents(docs(["one"]), shards=5).collect()] == [(0, 0)]


def test_a_group_of_a_third_and_pairs_move_under_quotas_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BLOCK", 16)
    texts = ["hot copy"] * 2000 + [f"pair {i // 2}" for i in range(3000)] + [f"text {i}" for i in range(1000)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=12).collect()
    assert Counter(r.shard for r in got) == {s: 500 for s in range(12)}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(500)) for s in range(12))
    of = {}
    for r in got:
        of.setdefault(r.text_crc32, Counter())[r.shard] += 1
    hot = of[zlib.crc32(b"hot copy")]
    assert sum(n for _, n in hot.most_common(6)) >= 1600  # 1000 by hash alone
    assert sum(len(of[zlib.crc32(f"pair {k}".encode())]) > 1 for k in range(1500)) <= 75


def test_pairs_move_where_no_shard_has_room(docs):
    got = shard_documents(docs([f"pair {i // 2}" for i in range(2400)]), shards=8).collect()
    assert Counter(r.shard for r in got) == {s: 300 for s in range(8)}
    of = {r.doc_id: r.shard for r in got}
    assert sum(of[2 * k] != of[2 * k + 1] for k in range(1200)) <= 120  # 1050 by hash alone


def jaccard(a, b):
    a, b = Counter((a or "").split()), Counter((b or "").split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_edited_texts_and_likeness(docs):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["the", "of", *(f"w{i}x{k}" for k in range(60))], k=rng.randint(30, 200))) for i in range(40)]
    texts[7], texts[8], texts[20] = None, "", texts[3]
    got = {r.doc_id: r for r in edited_fingerprints(docs(texts)).collect()}
    assert len(got) == 40
    errors = []
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % 40] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t:
            errors.append(got[i].near_edited - jaccard(t, edited))
    assert abs(np.mean(errors)) < 0.05 and np.mean(np.abs(errors)) < 0.08
    assert got[20].fingerprint == got[3].fingerprint and got[7].fingerprint == got[8].fingerprint == "empty"
    assert got[7].near_next == 1.0 and got[8].near_next == 0.0
    assert edited_fingerprints(docs([])).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = "x " * 5 + "y " * 2 + "z q r s", "x " * 2 + "y " * 3 + "z q t u"
    rows = spark.createDataFrame([(0, 0, 0, a, b)], "block long, row long, turn int, text string, edited string")
    r = weighted_samples(rows, samples=1600).first()
    assert abs(np.mean(np.array(r.fp) == np.array(r.edited_fp)) - jaccard(a, b)) < 0.04


def test_one_against_more_collides_as_often_as_it_should(spark):
    once, twice, thrice = (" ".join(n * [f"w{i}" for i in range(40)]) for n in (1, 2, 3))
    rows = spark.createDataFrame([(0, k, 0, a, b) for k, (a, b) in enumerate(((once, twice), (once, thrice), (twice, thrice)))], "block long, row long, turn int, text string, edited string")
    for r in weighted_samples(rows, samples=1600).collect():
        assert abs(np.mean(np.array(r.fp) == np.array(r.edited_fp)) - (1 / 2, 1 / 3, 2 / 3)[r.row]) < 0.04


def test_shared_chunks_go_and_the_first_stays(docs):
    rng = random.Random(1)
    line = lambda: " ".join(rng.choices("abcdefghijklmnop", k=12))
    passage = [line() for _ in range(30)]
    texts = ["\n".join([line() for _ in range(9)] + passage), "\n".join([line() for _ in range(5)] + passage + [line() for _ in range(4)]), "\n".join(line() for _ in range(8)), None, "", "single"]
    got = {r.doc_id: r for r in line_dedup(docs(texts)).collect()}
    assert [got[i].text for i in (0, 2, 3, 4, 5)] == [texts[i] for i in (0, 2, 3, 4, 5)]
    assert got[1].n_removed_lines >= 20 and got[1].text.count("\n") + 1 == got[1].n_lines - got[1].n_removed_lines
    assert set(got[1].text.split("\n")) <= set(texts[1].split("\n")) and texts[1].split("\n")[0] in got[1].text
    assert line_dedup(docs([])).count() == 0


def test_line_dedup_of_odd_tables(spark):
    """Clashing columns, null and repeated ids, repeated rows, ties of the rolling hash and a very long text."""
    text, long = "\n".join(f"line {i}" for i in range(12)), "\n".join(f"long {i}" for i in range(30_000))
    rows = [(None, text, 1, 0), (None, text, 2, 0), (3, text, 3, 0), (3, "a\n" * 40 + "b", 4, 0), (5, long, 5, 0), (5, None, 6, 0), (6, "", 7, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _lines int, _removed int").withColumn("_row", F.col("_lines")).withColumn("others", F.lit(1))
    got = {r._lines: r for r in line_dedup(table).collect()}
    assert len(got) == 7 and got[5].text == long and got[6].text is None and got[7].text == ""
    assert [got[i].text for i in (1, 2, 3)].count(text) == 1 and [got[i].text for i in (1, 2, 3)].count("") == 2
    assert got[3]._row == 3 and got[3].others == 1 and got[3]._removed == 0


def test_packing_is_whole_and_tight(docs, odd_texts):
    texts = [*odd_texts, *(f"word{i} and more " * (20 * i) for i in range(12))]
    sources = [f"s{i % 3}" if i % 5 else None for i in range(len(texts))]
    got = pack(docs(texts, sources), PATH, window=64).collect()
    tokenizer, seen = Tokenizer.from_file(PATH), {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, t in enumerate(texts):
        assert b"".join(x for _, x in sorted(seen[i])) == np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, pieces in windows.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 64 or k == max(windows)
    assert pack(docs([]), PATH).count() == 0
