"""What a stored table was shuffled for is deleted once it is written."""

import time

import pytest
from lineagraph.checkpoints import CLEANUP, settle, stored
from lineagraph.operators.closure import ancestors, graph_closure
from lineagraph.operators.trees import numbered
from pyspark.sql import functions as F


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


@pytest.mark.parametrize("keep", [stored, settle])
def test_no_shuffle_files_are_left(spark, keep):
    counted = spark.range(5000).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("n"))
    known = spark.range(300).withColumnRenamed("id", "k").distinct()
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    kept = keep(counted.join(known, "k"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(CLEANUP) == setting
    assert kept.count() == 300 and kept.agg(F.sum("n")).first()[0] == 3000 and counted.count() == 500


def test_rounds_are_kept_as_tables(spark):
    """Tables of columns are smaller than checkpoints, and small ones are known to be small, so that joins send them."""
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 2)]
    nodes = spark.createDataFrame(rows, "tree_id long, id long, parent_id long").selectExpr("*", "id as place", "'x' as label")
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, next_node long")
    found = {
        8: ancestors(nodes, "id", "parent_id"),
        3: graph_closure(spark.createDataFrame([(1, 1)], "src long, node long"), loop),
        4: numbered(nodes, alike=False),
    }
    for n, df in found.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan and "LogicalRDD" not in plan
        assert df.count() == n
