"""Near-duplicates at the stage's own threshold."""

import random

from lineagraph.llm.simhash import drop_near_duplicates, near_duplicates, similar_pairs


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, least):
    """The words with single ones changed, as many as leave the Jaccard similarity at ``least`` or more."""
    out = words.copy()
    for i in rng.sample(range(len(words)), len(words)):
        new = [*out[:i], f"x{rng.randrange(10**9)}", *out[i + 1 :]]
        if alike(words, new) < least:
            return out
        out = new
    return out


def test_pairs_at_the_threshold_are_found(docs):
    rng = random.Random(11)
    texts = []
    for _ in range(80):
        base = [f"w{rng.randrange(50_000)}" for _ in range(300)]
        near = edited(rng, base, 0.8)
        assert 0.8 <= alike(base, near) < 0.85
        texts += [" ".join(base), " ".join(near)]
    got = {(r.doc_id, r.group_id) for r in near_duplicates(docs(texts)).collect()}
    assert got <= {(i + 1, i) for i in range(0, 160, 2)} and len(got) >= 79


def test_pairs_behind_an_unlike_first_member_are_found(docs):
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(220)]
    texts = []
    for _ in range(30):  # all share most of their words, but only two each are similar enough
        own = [f"w{rng.randrange(50_000)}" for _ in range(60)]
        base = shared + own
        texts += [" ".join(base), " ".join(edited(rng, base, 0.9))]
    wanted = {(a, b) for a in range(60) for b in range(a + 1, 60) if alike(texts[a].split(), texts[b].split()) >= 0.8}
    assert wanted == {(i, i + 1) for i in range(0, 60, 2)}
    assert {(r.group_id, r.doc_id) for r in near_duplicates(docs(texts)).collect()} == wanted


def test_large_buckets_leave_nobody_waiting(spark):
    """100 nodes in the same buckets, of 25 clusters of four."""
    nodes = spark.createDataFrame([(i, [1, 2, 3]) for i in range(100)], "node long, keys array<long>")
    links = similar_pairs(nodes, lambda pairs: pairs.where("u % 25 = v % 25")).collect()
    assert {(r.u % 25, r.v % 25) for r in links} == {(k, k) for k in range(25)}
    assert len({n for r in links for n in (r.u, r.v)}) == 100


def test_ids_with_several_texts_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, 0), (3, a, 1), (3, b, 2), (4, b, 3), (5, b, 4), (5, b, 5), (None, a, 6), (None, a, 7), (6, None, 8), (7, "", 9)]
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, gone long")).collect()
    assert sorted(r.gone for r in got) == [0, 1, 2, 3, 6, 7, 8]
    assert drop_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
