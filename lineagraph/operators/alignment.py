"""Two lists compared: a longest common subsequence, and both merged by it.

Equal ends are matched first, then what is left by halving the first list (Hirschberg's method), a row
of lengths at a time, so two lists take memory in proportion to their sizes and time to their product.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and each beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return row


def common_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of one of their longest common subsequences."""
    out: list[tuple[int, int, int]] = []  # runs: places and how long
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        most = min(j - i, m - k)
        if not most:
            continue
        differ = np.flatnonzero(a[i : i + most] != b[k : k + most])
        lead = int(differ[0]) if len(differ) else most
        if lead:
            out.append((i, k, lead))
            i, k, most = i + lead, k + lead, most - lead
        differ = np.flatnonzero((a[j - most : j] != b[m - most : m])[::-1])
        tail = int(differ[0]) if len(differ) else most
        if tail:
            out.append((j - tail, m - tail, tail))
            j, m = j - tail, m - tail
        if j - i < 2 or m == k:
            if j - i == 1 and len(at := np.flatnonzero(b[k:m] == a[i])):
                out.append((i, k + int(at[0]), 1))
            continue
        half = (i + j) // 2
        both = _lengths(a[i:half], b[k:m]) + _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int(np.argmax(both))
        todo += [(i, half, k, cut), (half, j, cut, m)]
    out.sort()
    places = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.arange(r[c], r[c] + r[2]) for r in out)])
    return places(0), places(1)


def common_subsequences(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, other_id, place, other_place): a longest common subsequence of two lists each, as places from 0.

    ``lists`` has (id, place, value), ``pairs`` (id, other_id). Values are compared by 64-bit hashes, null ones
    are equal. A pair's lists are compared in one task.
    """
    value = F.xxhash64(F.col("value").isNull(), "value")
    rows = lists.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), lambda x: x["v"]).alias("values"))
    both = pairs.select("id", "other_id").join(rows, "id").join(rows.select(F.col("id").alias("other_id"), F.col("values").alias("other_values")), "other_id")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy() for c in ("values", "other_values"))
                x, y = common_places(a, b)
                same = [pa.array([batch.column(c)[i].as_py()] * len(x), batch.schema.field(c).type) for c in ("id", "other_id")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["id", "other_id", "place", "other_place"])

    return both.select("id", "other_id", "values", "other_values").mapInArrow(run, f"id {kinds['id']}, other_id {kinds['other_id']}, place int, other_place int")


def merged_lists(cells: DataFrame, pairs: DataFrame, code: Column, merge_code: bool = False, original_first: bool = True) -> DataFrame:
    """(id, other_id, place, from_original, from_history): an original list merged with its history.

    ``cells`` has (id, position, text), ``pairs`` (id: the original, other_id: the history), ``code`` says of a cell
    whether it is code. Code cells of one text, white space at its ends aside, are matched along a longest
    common subsequence; matched ones are one cell. Between two of them come the original's other cells (code only
    with ``merge_code``) and then the history's, or the other way round.
    """
    order = Window.partitionBy("id").orderBy("position", "text")
    listed = cells.select("id", (F.row_number().over(order) - 1).alias("place"), code.alias("code"), F.trim("text").alias("text"))
    # cells that are no code are unlike all others
    unlike = F.when(F.col("code"), F.concat(F.lit("="), F.coalesce("text", F.lit("")))).otherwise(F.concat_ws(" ", F.col("id").cast("string"), F.col("place").cast("string")))
    matched = common_subsequences(listed.select("id", "place", unlike.alias("value")), pairs)

    def side(of: str, place: str, other: str, rank: int) -> DataFrame:
        mine = pairs.select("id", "other_id").join(listed.withColumnRenamed("id", of), of)
        known = matched.select("id", "other_id", F.col(place).alias("place"), F.col(other).alias("partner"))
        met = mine.join(known, ["id", "other_id", "place"], "left")
        before = F.count("partner").over(Window.partitionBy("id", "other_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        return met.select("id", "other_id", "place", "partner", "code", before.alias("gap"), F.lit(rank).alias("rank"))

    first = side("id", "place", "other_place", 0 if original_first else 1).where(F.col("partner").isNotNull() | ~F.col("code") | F.lit(merge_code))
    second = side("other_id", "other_place", "place", 1 if original_first else 0).where("partner is null")
    original = first.select("id", "other_id", "gap", F.when(F.col("partner").isNotNull(), 2).otherwise(F.col("rank")).alias("rank"), F.col("place").alias("from_original"), F.col("partner").alias("from_history"), "place")
    history = second.select("id", "other_id", "gap", "rank", F.lit(None).cast("int").alias("from_original"), F.col("place").alias("from_history"), "place")
    rows = original.unionByName(history)
    at = F.row_number().over(Window.partitionBy("id", "other_id").orderBy("gap", "rank", "place")) - 1
    return rows.select("id", "other_id", at.alias("at"), "from_original", "from_history").withColumnRenamed("at", "place")
