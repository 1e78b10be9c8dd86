"""Line dedup and fingerprints of rows that come out of a shuffle are those of the same rows in a file."""

import random

import pytest
from pyspark.sql import functions as F

from lineagraph.llm.cws import edited_fingerprints
from lineagraph.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string"


@pytest.fixture
def shuffled(spark):
    """The same rows out of a groupBy, with a wide further column and partitions that are put together by size."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)

    def make(table):
        return table.groupBy("doc_id", "text").agg(F.max(F.expr("repeat(sha2(text, 512), 40)")).alias("wide"))

    yield make
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def texts(n):
    draw = random.Random(9)
    passages = [[f"line {p} {i} {draw.random()}" for i in range(30)] for p in range(12)]
    out = []
    for i in range(n):
        own = [f"own {i} {k} {draw.random()}" for k in range(draw.randint(2, 20))]
        at = draw.randint(0, len(own))
        out.append((i, "\n".join(own[:at] + draw.choice(passages) + own[at:])))
    return out


def test_line_dedup_of_shuffled_rows(spark, shuffled, tmp_path):
    spark.createDataFrame(texts(800), SCHEMA).repartition(8).write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t"))
    expected = {(r.doc_id, r.text, r.n_removed_lines) for r in line_dedup(plain).collect()}
    line_dedup(shuffled(plain)).write.parquet(str(tmp_path / "out"))
    got = {(r.doc_id, r.text, r.n_removed_lines) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected and sum(n for *_, n in got) > 10_000


def test_fingerprints_of_shuffled_rows(spark, shuffled, tmp_path):
    spark.createDataFrame(texts(800), SCHEMA).repartition(8).write.parquet(str(tmp_path / "t"))
    plain = spark.read.parquet(str(tmp_path / "t"))
    assert set(edited_fingerprints(shuffled(plain)).collect()) == set(edited_fingerprints(plain).collect())


def test_repeated_rows_of_one_id(spark):
    """Of three copies of an id's text one keeps its chunks; other texts of that id stay what they are."""
    a, b = "\n".join(f"a {i}" for i in range(40)), "\n".join(f"b {i}" for i in range(40))
    rows = [(1, a, "x"), (1, a, "y"), (1, a, "x"), (1, b, "z"), (2, a, "x"), (None, b, "n"), (None, b, "m"), (3, None, "u"), (3, None, "v"), (4, "one", "w"), (4, "one", "w")]
    got = sorted(map(tuple, line_dedup(spark.createDataFrame(rows, SCHEMA + ", _row string")).select("doc_id", "text", "n_lines", "n_removed_lines").collect()), key=str)
    expected = [(1, "", 40, 40)] * 2 + [(1, a, 40, 0), (1, "", 40, 40), (2, "", 40, 40), (None, b, 40, 0), (None, "", 40, 40)] + [(3, None, 0, 0)] * 2 + [(4, "one", 1, 0)] * 2
    assert got == sorted(expected, key=str)


def test_many_rows_without_id(spark):
    """They lie in several blocks, and each is followed by the next one in the order of (id, hash of the text)."""
    rows = [(None if i % 3 else i, f"text {i} " + "word " * (i % 7)) for i in range(9000)] + [(None, None), (None, "")]
    table = spark.createDataFrame(rows, SCHEMA)
    order = table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()
    wanted = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        take = len(r.text) // 4
        wanted.append((r.doc_id, len(r.text), r.text[: len(r.text) - take] + nxt.text[:take]))
    from lineagraph.llm.cws import with_next

    seen = with_next(table.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")))
    assert seen.where("doc_id is null and not is_ghost").select("block").distinct().count() > 2
    got = [(r.doc_id, r.n_chars, r.edited) for r in seen.where("not is_ghost").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
