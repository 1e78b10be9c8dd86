"""The walk through members goes over contexts that lead on; what they lead to is taken once."""

from lineagraph.operators import lineage as li


def test_leaves_are_not_walked(spark, monkeypatch):
    chain = [(c, "next", c + 1, 0) for c in range(5)]
    leaves = [(c, f"k{i}", 1000 + 100 * c + i, 0) for c in range(6) for i in range(50)]
    member = spark.createDataFrame(chain + leaves, "collection_id long, key string, member_id long, checkpoint long")
    seeds = spark.createDataFrame([(1, 0, 5), (2, 3, 5)], "src long, node long, at long")
    dependency = spark.createDataFrame([(1000, 4), (4, 1000), (1001, 1001)], "dependent_id long, dependency_id long")
    walked = []

    def counted(write):
        def put(df):
            if df.columns == ["src", "node", "at"]:
                walked.append(df.count())
            return write(df)

        return put

    monkeypatch.setattr(li, "settle", counted(li.settle))
    if hasattr(li, "stored"):
        monkeypatch.setattr(li, "stored", counted(li.stored))
    got = {tuple(r) for r in li.derivation_through_members(member, seeds, dependency).collect()}
    want = {(1, n, 5) for n in range(6)} | {(2, n, 5) for n in (3, 4, 5)}
    want |= {(s, 1000 + 100 * c + i, 5) for s, n, _ in set(want) for c in [n] for i in range(50)} | {(2, 1000, 5)}
    assert got == want
    assert sum(walked) < 30, walked  # 9 collections, 4 contexts of dependencies, both seeds; not their 450 leaves, again and again
