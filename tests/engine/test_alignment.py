"""Common subsequences of many lists, and merged notebooks against the rule cell by cell."""

import random

import numpy as np
from pyspark.sql import functions as F

from lineagraph.operators.alignment import common_places, merged_lists


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_random_lists():
    draw = random.Random(1)
    for _ in range(600):
        a, b = ([draw.randrange(draw.choice([2, 4, 30])) for _ in range(draw.randrange(40))] for _ in range(2))
        if draw.random() < 0.3:
            b = a[: len(a) // 2] + b[:5] + a[len(a) // 2 :]
        x, y = common_places(np.array(a, np.int64), np.array(b, np.int64))
        assert len(x) == len(y) == length(a, b)
        assert all(a[i] == b[j] for i, j in zip(x, y)) and (np.diff(x) > 0).all() and (np.diff(y) > 0).all()


def test_long_lists_take_little_memory():
    """Lists of 20 000 whose table of lengths would have 400 million entries."""
    a = np.arange(20_000)
    b = np.concatenate([a[:5000], a[5100:15_000], np.arange(10**6, 10**6 + 300), a[15_000:]])
    x, _ = common_places(a, b)
    assert len(x) == 19_900


def merge(original, history, matches, merge_code):
    """Cell by cell: the original's cells before a match, then the history's, then the match."""
    out, i, k = [], 0, 0
    for m, n in [*matches, (len(original), len(history))]:
        out += [(x, None) for x in range(i, m) if merge_code or original[x][0] != "code"]
        out += [(None, x) for x in range(k, n)]
        if m < len(original):
            out.append((m, n))
        i, k = m + 1, n + 1
    return out


def test_merged_notebooks(spark):
    draw = random.Random(2)
    books = {i: [(draw.choice(["code", "text"]), draw.choice(["a", " a", "b", "c "])) for _ in range(draw.randrange(1, 12))] for i in range(30)}
    cells = spark.createDataFrame([(i, p, kind, text) for i, held in books.items() for p, (kind, text) in enumerate(held)], "id long, position long, kind string, text string")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(29)], "id long, other_id long")
    for merge_code in (False, True):
        got = {}
        for r in merged_lists(cells, pairs, F.col("kind") == "code", merge_code).orderBy("id", "place").collect():
            got.setdefault(r.id, []).append((r.place, r.from_original, r.from_history))
        for i in range(29):
            rows = got[i]
            assert [p for p, *_ in rows] == list(range(len(rows)))
            matches = [(o, h) for _, o, h in rows if o is not None and h is not None]
            a, b = ([(t.strip() if k == "code" else object()) for k, t in books[x]] for x in (i, i + 1))
            assert all(a[o] == b[h] for o, h in matches) and len(matches) == length(a, b)
            assert [(o, h) for _, o, h in rows] == merge(books[i], books[i + 1], matches, merge_code)


def test_no_cells(spark):
    cells = spark.createDataFrame([], "id long, position long, text string")
    assert merged_lists(cells, spark.createDataFrame([(1, 2)], "id long, other_id long"), F.lit(True)).count() == 0
