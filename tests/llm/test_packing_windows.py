"""Each full window has the target proportions, but for what queues save up for a piece."""

import pytest
from lineagraph.llm.packing import placements
from pyspark.sql import functions as F


def whole(found, rows, window):
    """The pieces are gapless, in line and in each row."""
    places = sorted((r.sequence_id * window + r.offset, r.length) for r in found.collect())
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    own = {}
    for r in found.collect():
        own.setdefault(r.row, []).append((r.start, r.length))
    for row in rows.collect():
        at = 0
        for start, length in sorted(own[row.row]):
            assert start == at
            at += length
        assert at == row.n


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.5}])
@pytest.mark.parametrize("least", [1, 16])
def test_every_window_has_the_target_proportions(spark, weights, least):
    rows = spark.createDataFrame([(i, "a" if i % 4 == 0 else "b", 100) for i in range(400)] + [(400, "rare", 7)], "row long, queue string, n long")
    found = placements(rows, window=200, weights=weights, least=least).join(rows, "row")
    got = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("queue") == "a", F.col("length"))).alias("a")).collect()
    want, until = (50, 200) if weights is None else (100, 90)
    assert {r.sequence_id for r in got} == set(range(201)) and all(r.n == 200 for r in got if r.sequence_id < 200)
    assert all(abs((r.a or 0) - want) <= 2 * least + 1 for r in got if r.sequence_id < until)
    whole(found, rows, 200)


def test_a_rare_queue_comes_in_fair_pieces(spark):
    rows = spark.createDataFrame([(i, "many", 1000) for i in range(300)] + [(900, "rare", 100), (901, "rare", 300), (902, "one", 1)], "row long, queue string, n long")
    found = placements(rows)
    whole(found, rows, 2048)
    rare = [r for r in found.collect() if r.row in (900, 901)]
    assert len(rare) <= 10 and len({r.sequence_id for r in rare}) >= 5


def test_many_queues(spark):
    rows = spark.createDataFrame([(i, f"q{i % 37}", 1 + i * i % 501) for i in range(700)], "row long, queue string, n long")
    found = placements(rows, window=256, least=16)
    whole(found, rows, 256)
    share = found.join(rows, "row").groupBy("queue", "sequence_id").agg(F.sum("length").alias("n")).collect()
    total = {r.queue: r.n for r in rows.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    windows = sum(total.values()) / 256
    assert all(r.n <= total[r.queue] / windows * 1.5 + 64 for r in share if r.sequence_id < int(windows))
