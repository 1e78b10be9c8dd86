"""Ranges, pairs and names in succession against all pairs."""

import random

import pytest

from lineagraph.operators import succession as su

SCHEMA = "trial_id long, model string, id long, name string, at long"


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    draw = random.Random(seed)
    befores = [(t, draw.choice(["activation", "access"]), i, draw.choice("fgh"), draw.randrange(30)) for i in range(60) for t in [draw.randrange(4)]]
    afters = [(t, m, i, n, at + draw.randrange(5)) for t, m, i, n, at in befores if t] + [(t, "trial", 0, "trial", 25) for t in range(5)]
    a, b = spark.createDataFrame(befores, SCHEMA), spark.createDataFrame(afters, SCHEMA)
    pairs = {(x[0], *x[1:3], *y[1:3]) for x in befores for y in afters if x[0] == y[0] and x[4] <= y[4] and x[1:3] != y[1:3]}
    assert {tuple(r) for r in su.successor_pairs(a, b).collect()} == pairs
    ranks = {(r.trial_id, r.rank): (r.model, r.id) for r in su.ranked(b).collect()}
    for r in su.successor_ranges(a, b).collect():
        mine = next(x for x in befores if x[:3] == (r.trial_id, r.model, r.id))
        wanted = {y[1:3] for y in afters if y[0] == r.trial_id and mine[4] <= y[4]}
        assert {ranks[r.trial_id, k] for k in range(r.since, r.until + 1)} == wanted and r.until - r.since + 1 == len(wanted)
    names = {(x[1], x[3], y[1], y[3]) for x in befores for y in afters if x[0] == y[0] and x[4] <= y[4] and x[1:3] != y[1:3]}
    assert {tuple(r) for r in su.successor_names(a, b).collect()} == names


def test_none_follows_and_empty(spark):
    a = spark.createDataFrame([(1, "access", 1, "f", 9), (2, "access", 2, "f", 1)], SCHEMA)
    b = spark.createDataFrame([(1, "access", 3, "f", 8)], SCHEMA)
    assert {(r.id, r.since, r.until) for r in su.successor_ranges(a, b).collect()} == {(1, 2, 1), (2, 1, 0)}
    assert su.successor_pairs(a, b).count() == su.successor_names(a.limit(0), b).count() == 0
