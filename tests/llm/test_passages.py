"""Passages that later documents share behind a first one that holds only a part of them."""

import random

import numpy as np
import pytest
from lineagraph.llm import substring_dedup
from lineagraph.llm.substring_dedup import best_segments, compact_windows, interval_pairs, repeated_passages, window_keys


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("length", [54, 80, 200])
def test_near_passages_are_found(docs, length):
    """Passages with one word changed, each in two documents of unlike words: brute force finds all at Jaccard 0.8 or more."""
    rng = random.Random(length)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    texts, wanted = [], set()
    for k in range(120):
        passage = words(length)
        near = passage.copy()
        near[rng.randrange(length)] = "other"
        if similar(passage, near) >= 0.8:
            wanted.add(2 * k + 1)
        texts += [" ".join([*words(30), *p, *words(30)]) for p in (passage, near)]
    got = {r.doc_id: r for r in repeated_passages(docs(texts)).collect()}
    assert len(wanted) >= 100 and len(wanted & set(got)) >= 0.95 * len(wanted)
    for i, r in got.items():
        assert r.source_doc_id == i - 1
        a, b = texts[i].split()[r.start_word : r.end_word], texts[i - 1].split()[r.source_start_word : r.source_end_word]
        assert similar(a, b) >= 0.8 and r.end_word - r.start_word >= 50


def test_common_passages_with_unlike_first_holders(docs):
    """Forty documents share 30 words around which two halves of them share further ones: every one but the first of a half is linked."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    line, halves = words(30), [(words(15), words(15)) for _ in range(2)]
    texts = [" ".join([*words(20), *halves[i % 2][0], *line, *halves[i % 2][1], *words(20)]) for i in range(40)]
    got = {(r.doc_id, r.source_doc_id) for r in repeated_passages(docs(texts)).collect()}
    assert {a for a, _ in got} == set(range(2, 40)) and all(a % 2 == b % 2 for a, b in got)


def test_stretches_are_the_longest():
    rng = np.random.default_rng(3)
    for _ in range(300):
        match = rng.random(60) < rng.choice([0.5, 0.8, 0.95])
        good = [(a, b) for a in range(60) for b in range(a + 20, 61) if 5 * match[a:b].sum() >= 4 * (b - a)]
        found = best_segments(match, 20)
        assert bool(good) == bool(found)
        for a, b in found:
            assert (a, b) in good and (b - a == 20 or not any(c == a and d > b and match[d - 1] for c, d in good))


def test_interval_pairs_match_brute_force():
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdef") + rng.choice("ghij") for _ in range(400)).encode()
    flat, offsets = np.frombuffer(text, np.uint8), np.array([0, 600, len(text)])
    key, row, span = window_keys(flat, offsets)
    order = np.argsort(row, kind="stable")
    got = set(zip(*(x.tolist() for x in interval_pairs(key[order], span[order], row[order]))))
    wanted = 0
    for f, g in ((i, j) for i in range(len(key)) for j in range(len(key))):
        if row[f] == row[g] and key[f] & 3 < key[g] & 3:
            x, y = int(span[f] >> 17), int(span[g] >> 17)
            left = max(x - int(span[f] >> 9 & 255), y - int(span[g] >> 9 & 255))
            right = min(x + int(span[f] >> 1 & 255), y + int(span[g] >> 1 & 255))
            wanted += right - left + 1 >= 46 and left <= min(x, y) and max(x, y) <= right and abs(x - y) < 46
    assert len(got) and wanted >= len(got)
    assert len(compact_windows(np.arange(50, dtype=np.uint64), np.zeros(50, np.int64))[1]) == 4


def test_odd_tables(spark, docs):
    """Null and repeated ids, repeated rows, clashing and further columns, a very long text and none."""
    from lineagraph.llm.substring_dedup import cut_repeats

    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(9000)}" for _ in range(60))
    rows = [(None, passage, 1), (None, passage, 2), (3, passage, 3), (3, passage, 4), (7, f"x {passage} y", 5), (9, None, 6), (10, " ".join(f"v{i}" for i in range(60_000)) + " " + passage, 7), (11, passage, 8), (11, f"{passage} z", 9), (12, passage, 10)]
    table = spark.createDataFrame(rows, "doc_id long, text string, doc int").withColumnRenamed("doc", "own")
    found = repeated_passages(table)
    assert {(r.doc_id, r.source_doc_id) for r in found.collect()} == {(7, 3), (10, 3), (12, 3)}
    cut = {r.own: r.text for r in cut_repeats(table, found).collect()}
    assert len(cut) == 10 and cut[9] == f"{passage} z" and cut[10] == "" and cut[5].split() == ["x", "y"] and cut[1] == passage and cut[6] is None


def test_passages_behind_a_shorter_first_holder_are_found(docs):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    texts = []
    for _ in range(20):
        line = words(40)
        passage = [*words(8), *line, *words(8)]
        texts += [" ".join([*words(40), *middle, *words(40)]) for middle in (line, passage, passage)]
    got = {(r.doc_id, r.source_doc_id): (r.start_word, r.end_word) for r in repeated_passages(docs(texts)).collect()}
    assert got == {(i + 2, i + 1): (40, 96) for i in range(0, 60, 3)}


def test_common_around_matches_brute_force(spark):
    from lineagraph.llm.substring_dedup import common_around

    rng = random.Random(6)
    places = {d: sorted(rng.sample(range(200), rng.choice([60, 150, 190]))) for d in range(12)}
    nodes = [(d, p) for d in places for p in range(0, 200, 3)]
    got = {(r.doc, r.place): r.n for r in common_around(spark.createDataFrame(nodes, "doc long, place long"), spark.createDataFrame([(d, p) for d in places for p in places[d]], "doc long, place long"), 20).collect()}
    for d, p in nodes:
        held = set(places[d])
        runs = (sum(1 if i in held else -4 for i in range(a, e)) for a in range(p - 19, p + 1) for e in range(max(p + 1, a + 20), p + 21))
        most = max(runs)
        assert got.get((d, p)) == (most if most >= 0 else None)


def test_few_pairs_shuffle_only_their_slices(spark, monkeypatch, tmp_path):
    spark.range(3000).selectExpr("id as doc", "cast(repeat(cast(id as string), 50) as binary) as slice").write.parquet(str(tmp_path / "slices"))
    slices = spark.read.parquet(str(tmp_path / "slices"))
    pairs = spark.createDataFrame([(7, 3), (9, 3), (2999, 9)], "doc long, rep long")
    wanted = {(a, b, str(a).encode() * 50, str(b).encode() * 50) for a, b in ((7, 3), (9, 3), (2999, 9))}
    for most in (200_000, 2, 0):  # pairs are sent, the ids of one side are, nothing is
        monkeypatch.setattr(substring_dedup, "SENT_IDS", most)
        found = substring_dedup.with_slices(pairs, slices)
        assert {(r.doc, r.rep, bytes(r.own), bytes(r.other)) for r in found.collect()} == wanted
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == {200_000: 1, 2: 1, 0: 0}[most]


def test_long_documents_are_not_sent_for_each_of_their_pairs(spark, monkeypatch):
    """Two long slices with a hundred short partners each: the short ones are sent, whichever of the two comes first."""
    slices = spark.createDataFrame([(d, b"x" * (9000 if d in (0, 500) else 20 + d % 7)) for d in range(501)], "doc long, slice binary")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 101)] + [(500, i) for i in range(101, 201)], "doc long, rep long")
    kept = []
    monkeypatch.setattr(substring_dedup, "stored", lambda df: kept.append(df) or df)
    size = {r.doc: len(r.slice) for r in slices.collect()}
    met = substring_dedup.with_slices(pairs, slices)
    assert {(r.doc, r.rep, len(r.own), len(r.other)) for r in met.collect()} == {(r.doc, r.rep, size[r.doc], size[r.rep]) for r in pairs.collect()}
    assert {r.home for r in kept[0].collect()} == {0, 500}
