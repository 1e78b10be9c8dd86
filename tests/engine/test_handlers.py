"""Handlers meet tries line by line, and the pairs of one line are dealt to several tasks."""

from pyspark.sql import functions as F

from lineagraph.operators import lookups as lo


def test_pairs_of_one_line_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(lo, "PAIRS_A_TASK", 100)
    rows = [(i, "try", 3, 1, 4) for i in range(40)] + [(100 + i, "except", 3, 2 + i % 4, 9) for i in range(40)] + [(200, "try", 3, 5, 5), (201, "try", 3, 6, None), (202, "except", None, 2, 3)]
    component = spark.createDataFrame(rows, "id long, type string, first_char_column int, first_char_line int, last_char_line int")
    got = lo.handlers(component, ["try"], ["except"])
    assert {tuple(r) for r in got.collect()} == {(i, 100 + j) for i in range(40) for j in range(40) if j % 4 < 3} and got.count() == 1200
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
