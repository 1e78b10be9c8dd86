import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from lineagraph.llm import ranked_search
from lineagraph.llm.ranked_search import OP11_SQL, Shard, ranked_search as search, weight

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=50):
    """Every document against every query."""
    counted = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked, out = {}, []
    for i, x in items:
        asked.setdefault(i, set()).update(terms(x))
    for item, wanted in asked.items():
        scores = []
        for i, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if t in c), i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=50):
    return sorted(map(tuple, search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), k).collect()), key=str)


def by_sql(docs, items):
    base = duckdb.connect()
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        base.register(name, pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(base.execute(OP11_SQL).fetchall(), key=str)


def texts(draw, n):
    """Zipf-like words, so that there are very common and rare terms."""
    words = [f"W{i}" if i % 3 else f"é{i}ß" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ,-_\t"[draw.randrange(5)].join(draw.choices(words, weights, k=draw.choice([1, 5, 40, 200]))) for _ in range(n)]


def test_random_documents(spark, monkeypatch):
    """Against brute force and the SQL, in many small shards so that thresholds are carried."""
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        draw = random.Random(3)
        docs = list(enumerate(texts(draw, 500)))
        items = list(enumerate(texts(draw, 25)))
        expected = brute_force(docs, items)
        assert found(spark, docs, items) == expected == by_sql(docs, items)
        assert found(spark, docs, items, 7) == brute_force(docs, items, 7)
        monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
        assert found(spark, docs, items) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_ties_nulls_and_repeated_rows(spark):
    docs = [(i % 90, "same words here") for i in range(120)] + [(None, "same words here"), (None, None), (3, ""), (4, " \n."), (5, "here " * 20_000), (6, "Same SAME É é")]
    items = [(0, "Same, words"), (0, "HERE"), (1, None), (2, ""), (None, "here"), (3, "absent"), (4, "é")]
    assert found(spark, docs, items) == brute_force(docs, items) == by_sql(docs, items)


def test_common_term_has_no_points(spark):
    """A term that all documents of a small table hold may weigh nothing; such documents are left out."""
    assert weight(1000, 1000) == 0
    docs = [(i, "all") for i in range(1000)] + [(2000, "all rare")]
    assert found(spark, docs, [(0, "all rare")])[0] == brute_force(docs, [(0, "all rare")])[0]


def test_documents_that_cannot_qualify_are_not_probed():
    """One rare and one common list: with a threshold above the common one's bound only the rare one's documents are probed."""
    lengths = np.full(1000, 10)
    sizes = np.where(np.arange(1000) % 100 == 0, 2, 1)
    terms_ = np.concatenate([[0, 1] if s == 2 else [0] for s in sizes])
    shard = Shard(lengths, sizes, terms_, np.ones(len(terms_), np.int64), np.array([10, 5000]), 1000, 10_000)
    first, scores = shard.search([0, 1], 5, np.zeros(0, np.int64))
    assert len(first) == 1000 and shard.probes == 0
    docs, _ = shard.search([0, 1], 5, np.sort(scores)[-5:])
    assert docs.tolist() == list(range(0, 1000, 100)) and shard.probes == 10


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(0, "a")]) == found(spark, [(0, "a")], []) == found(spark, [(0, None)], [(0, "a")]) == []
    docs = spark.createDataFrame([(1, "a b", 3, "x")], DOCS + ", n long, term string")
    items = spark.createDataFrame([(1, "a", 3, "x")], ITEMS + ", item long, term string")
    assert [r.doc_id for r in search(docs, items).collect()] == [1]
