"""Cutting the lineage of a DataFrame by a reliable checkpoint."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ALONE: dict[str, str] = {}
#: Spark's setting (4.1 or later) by which what an execution has shuffled is deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names.

    A session of one machine (master ``local``) that names none, as in tests, gets a new temporary
    folder. On a cluster the setting must name a folder that all machines share.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    return _ALONE.setdefault(app, tempfile.mkdtemp(prefix="lineagraph-"))


@contextlib.contextmanager
def leaving_no_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files; else they stay until the driver happens to collect its garbage.

    Only for what is not executed again, as that would shuffle anew.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with leaving_no_shuffles(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # an execution of its own


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with leaving_no_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
