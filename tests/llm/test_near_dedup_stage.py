"""The pipeline's near-dedup keeps the least id of each SimHash component, and nothing else decides."""

import random

import xxhash
from corpus_pipeline import near_dedup_stage
from lineagraph.llm.simhash import first_of_components


def fingerprint(text):
    words = text.split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(len(words) - 2)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_stage_follows_the_bits_of_simhash(spark, docs):
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(50_000)}" for _ in range(240)]
        for changed in (0, 0, 1, 1, 2, 4, 8):
            words = base.copy()
            for i in rng.sample(range(240), changed):
                words[i] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    fps = [fingerprint(t) for t in texts]
    first = list(range(len(fps)))
    for _ in fps:  # each takes the least id that its links reach
        first = [min(first[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    wanted = {i for i, f in enumerate(first) if f == i}
    assert 12 < len(wanted) < 72
    assert {r.doc_id for r in near_dedup_stage(spark, docs(texts), "").collect()} == wanted


def test_ids_with_several_texts_and_rows_without_id_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, 0), (3, a, 1), (3, b, 2), (4, b, 3), (5, b, 4), (5, b, 5), (None, a, 6), (None, a, 7), (6, None, 8), (7, "", 9)]
    got = first_of_components(spark.createDataFrame(rows, "doc_id long, text string, gone long")).collect()
    assert sorted(r.gone for r in got) == [0, 1, 2, 3, 6, 7, 8]
    assert first_of_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
