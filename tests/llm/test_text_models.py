"""Passages, language model, toxicity and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lineagraph.llm import toxicity as tox
from lineagraph.llm.ngram_lm import PRIOR, EliasFano, NgramTrie, lm_scores
from lineagraph.llm.simhash import drop_near_duplicates
from lineagraph.llm.substring_dedup import cut_repeats, repeated_passages, tree_intervals, window_keys
from pyspark.sql import functions as F


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


@pytest.fixture
def with_passages(odd_texts):
    rng = random.Random(2)
    passage, short = words(rng, 70), words(rng, 40)
    near = passage.copy()
    near[35] = "other"
    make = lambda middle: " ".join([*words(rng, 60), *middle, *words(rng, 60)])
    return [make(passage), make([]), make(passage), make(near), make(short), make(short), *odd_texts], len(passage)


def test_passages_are_found_and_cut(docs, with_passages):
    texts, n = with_passages
    table = docs(texts)
    found = repeated_passages(table)
    got = {(r.doc_id, r.source_doc_id): r for r in found.collect() if r.doc_id < 6}
    assert set(got) == {(2, 0), (3, 0)}
    assert got[2, 0].start_word == got[2, 0].source_start_word == 60 and got[2, 0].end_word == 60 + n
    cut = {r.doc_id: r.text for r in cut_repeats(table, found).collect()}
    assert cut[0] == texts[0] and len(cut[2].split()) == 120 and cut[6] is None
    assert repeated_passages(docs([])).count() == 0


def test_windows_are_compact():
    first, last = tree_intervals([0, 1, 2, 3, 4], [0, 5, 2, 7, 0])
    assert (first[1:4].tolist(), last[1:4].tolist()) == ([1, 1, 3], [1, 3, 3])
    text = " ".join(words(random.Random(3), 300)).encode()
    flat = np.frombuffer(text, np.uint8)
    key, row, span = window_keys(flat, np.array([0, len(flat)]))
    place, before, after = span >> 17, span >> 9 & 255, span >> 1 & 255
    assert len(key) and (before + after + 1 >= 46).all() and (place - before).min() == 0 and (place + after).max() == 295 and (row == 0).all()


def test_elias_fano_and_trie_round_trip(tmp_path):
    rng = np.random.default_rng(4)
    for values in (np.array([7], np.uint64), np.array([0, 0, 5], np.uint64), np.sort(rng.integers(0, 2**40, 1000).astype(np.uint64)), np.arange(500, dtype=np.uint64)):
        coded = EliasFano.of(values)
        assert (coded.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 2**41, 200).astype(np.uint64)])
        low = rng.integers(0, len(values) + 1, len(asked))
        high = rng.integers(low, len(values) + 1)
        wanted = [next((i for i in range(a, b) if values[i] >= v), b) for v, a, b in zip(asked, low, high)]
        assert coded.successor(asked, low, high).tolist() == wanted
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 50, (300, 2))})
    c, s = (np.array(x, np.uint64) for x in zip(*pairs))
    trie = NgramTrie.of(c, s, np.arange(1, len(c) + 1), {int(c[0]): 999})
    trie.write(f"{tmp_path}/t")
    other = NgramTrie.open(f"{tmp_path}/t")
    asked = np.repeat(np.arange(60, dtype=np.uint64), 60), np.tile(np.arange(60, dtype=np.uint64), 60)
    for a, b in zip(trie.find(*asked), other.find(*asked)):
        assert (a == b).all()
    assert ((trie.find(*asked)[0] != 65535) == np.array([(int(a), int(b)) in set(pairs) for a, b in zip(*asked)])).all()
    assert NgramTrie.of(c[:0], s[:0], s[:0].astype(np.int64)).find(*asked)[1].max() == 0


def test_lm_scores_match_brute_force_for_any_chunks(spark, monkeypatch):
    rng = random.Random(16)
    texts = [" ".join(rng.choices("alpha Beta gamma delta eps zeta".split(), weights=[9, 5, 3, 2, 1, 1], k=rng.randint(0, 60))) for _ in range(80)] + [None, "", "alpha"]
    table = spark.createDataFrame([(None if i == 70 else 3 if i in (4, 5) else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    ids = [None if i == 70 else 3 if i in (4, 5) else i for i in range(len(texts))]
    tokens = [(t or "").lower().split() + ["</s>"] for t in texts]
    counts = [Counter(), Counter(), Counter()]
    totals = Counter()
    for i, ws in zip(ids, tokens):
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            line = ["<s>", "<s>", *ws]
            for k in range(2, len(line)):
                for n in range(3):
                    counts[n][tuple(line[k - n : k + 1])] += 1
                    totals[tuple(line[k - n : k])] += n > 0
    total, kinds = sum(counts[0].values()), len(counts[0])

    def score(ws):
        out, line = 0.0, ["<s>", "<s>", *ws]
        for k in range(2, len(line)):
            p = (counts[0][line[k],] + 0.1) / (total + 0.1 * (kinds + 1))
            for n in (1, 2):
                p = (counts[n][tuple(line[k - n : k + 1])] + PRIOR * p) / (totals[tuple(line[k - n : k])] + PRIOR)
            out += math.log10(p)
        return out

    wanted = sorted((-1 if i is None else i, round(score(ws), 2)) for i, ws in zip(ids, tokens))
    monkeypatch.setattr("lineagraph.llm.ngram_lm.COMMON_TOKENS", 100)
    for chunk_bytes in (1 << 20, 1500, 200):
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm_scores(table, chunk_bytes=chunk_bytes).collect())
        assert [i for i, _ in got] == [i for i, _ in wanted]
        assert all(abs(a - b) < 0.006 + 0.002 * abs(b) for (_, a), (_, b) in zip(got, wanted)), chunk_bytes


def test_lm_counts_and_base_match_brute_force(docs, odd_texts):
    rng = random.Random(6)
    texts = [*odd_texts, *(" ".join(rng.choices("alpha Beta gamma delta eps".split(), k=40)) for _ in range(40))]
    got = {r.doc_id: r for r in lm_scores(docs(texts)).collect()}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for i, t in enumerate(texts)}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    total = sum(counts.values())
    for i, ws in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    assert lm_scores(docs([])).count() == 0


def model_of(texts):
    classes = tox.character_classes(" ".join(texts))
    grams = (classes[:-2] * tox.CLASSES + classes[1:-1]) * tox.CLASSES + classes[2:]
    return tox.trigram_model(np.bincount(grams, minlength=tox.CLASSES**3).astype(float))


def test_disguises_are_decoded():
    model = model_of(["the loser idiot stupid people read good books in the sun"] * 50)
    for text, word in (("l0ser", "loser"), ("1d10t", "idiot"), ("i d i o t", "idiot"), ("s-t-u-p-i-d", "stupid"), ("stuuuupid", "stupid")):
        assert word in tox.restored(f"the {text} people", model), text
    assert tox.restored("good books in the sun, 1999", model) == []


def test_scores_on_held_out_labels(spark, docs, odd_texts):
    rng = random.Random(7)
    plain = [f"w{i}ord" for i in range(300)]
    texts, toxic = [], []
    for i in range(600):
        body, bad = rng.choices(plain, k=60), i % 6 == 0
        if bad:
            body.insert(30, rng.choice(["vileword", "nastyone", "v i l e w o r d" if i > 500 else "vileword"]))
        texts.append(" ".join(body))
        toxic.append(int(bad))
    table = docs(texts + odd_texts)
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i < 400], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in tox.score(table, tox.fit(table, labels)).collect()}
    assert len(got) == len(texts) + len(odd_texts) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) != bool(toxic[i]) for i in range(400, 600)) <= 4
    assert all(s == got[0] or s < 0.5 for s in [got[600], got[601]])
    empty = docs([])
    assert tox.score(empty, tox.fit(empty, labels.limit(0))).count() == 0


def test_scoring_leaves_no_memo_behind():
    model = tox.ToxicityModel(np.zeros((tox.CLASSES,) * 3, np.float32))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three", None, "four"])], names=["text"])
    assert [len(b.column("score")) for b in tox.scored(model, "text", [batch])] == [3]
    assert not model.memo


def test_near_duplicates_leave_one(docs, odd_texts):
    rng = random.Random(8)
    base = words(rng, 300)
    near = base.copy()
    near[100] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(words(rng, 300)), " ".join(base), *odd_texts]
    kept = {r.doc_id for r in drop_near_duplicates(docs(texts)).collect()}
    assert kept & {0, 1, 2, 3} == {0, 2}
    assert len(kept & {4, 5, 6}) == 1 and len(kept & {7, 8}) == 1
    assert drop_near_duplicates(docs([])).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline as cp

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert tuple(after.columns) == cp.COLUMNS
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert 30 < docs.count() <= 60
    last = cp.STAGES[-1][1](spark, docs, folder)
    assert last.select("doc_id").distinct().count() == docs.count()
    assert last.agg(F.max("offset")).first()[0] < 2048
