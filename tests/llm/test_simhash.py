import random

import numpy as np
import pytest
import xxhash
from lineagraph.llm.graph import components
from lineagraph.llm.simhash import fingerprint_links, simhash_components


def union(nodes, pairs):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("up_to", [2, 16])
def test_links_connect_what_brute_force_connects(spark, up_to):
    rng = random.Random(3)
    fps = {0, 2**63 - 1, -1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            fps.add((base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))) - 2**63)
    fps = sorted(fps)
    wanted = union(fps, [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    links = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), up_to).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 for r in links)
    assert union(fps, [(r.u, r.v) for r in links]) == wanted


def test_fingerprints_and_components(docs, odd_texts):
    texts = [*odd_texts, "A b C d e F", "one", "one two"]
    got = {r.doc_id: r for r in simhash_components(docs(texts), width=3).collect()}
    for i, text in enumerate(texts):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
        runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        bits = sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in runs) > len(runs))
        assert np.uint64(got[i].fp & (2**64 - 1)) == bits, text
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert got[3].component_id == got[4].component_id == got[len(odd_texts)].component_id == 3
    assert simhash_components(docs([])).count() == 0


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {99: 98, 100: 98}
