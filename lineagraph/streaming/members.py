"""The state of collections kept up from a stream of member versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagraph.sources.store import upsert


def latest_members(versions: DataFrame) -> DataFrame:
    """Per collection and key the latest member so far; works on batch and (update mode) streaming frames."""
    return versions.groupBy("collection_id", "key").agg(F.max_by("member_id", F.struct("checkpoint", "member_id")).alias("member_id"), F.max("checkpoint").alias("checkpoint"))


def versions_by_window(versions: DataFrame, width: str, late: str) -> DataFrame:
    """How many versions each collection gets in windows of event time; rows later than ``late`` are left out."""
    return versions.withWatermark("checkpoint", late).groupBy(F.window("checkpoint", width), "collection_id").agg(F.count("*").alias("versions"))


def upsert_into(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: put a batch's rows in place of the table's rows of the same key."""

    def apply(batch: DataFrame, _: int) -> None:
        write(upsert(read(), batch, key))

    return apply
