"""What may follow what in a trial: ranges of ranks instead of pairs.

All that something precedes are those that happen no earlier, so of the trial's moments in order they
are the last ones: one range for each. Pairs are made only for two sets that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDS = ["trial_id", "model", "id"]


def ranked(afters: DataFrame) -> DataFrame:
    """Moments (trial_id, model, id, at) with their ``rank`` in the trial from 1, by (at, model, id)."""
    return afters.select(*IDS, "at", F.row_number().over(Window.partitionBy("trial_id").orderBy("at", "model", "id")).cast("long").alias("rank"))


def successor_ranges(befores: DataFrame, afters: DataFrame) -> DataFrame:
    """(trial_id, model, id, since, until): for each of the befores the ranks of the afters that follow it.

    Both have (trial_id, model, id, at). A range is empty (until is less than since) if none follows. One sort
    of both together counts the afters before each.
    """
    kinds = ((befores, 0), (afters, 1))
    both = kinds[0][0].select(*IDS, "at", F.lit(0).alias("is_after")).unionByName(kinds[1][0].select(*IDS, "at", F.lit(1).alias("is_after")))
    order = Window.partitionBy("trial_id").orderBy("at", "is_after")
    earlier = F.sum("is_after").over(order.rowsBetween(Window.unboundedPreceding, 0))  # an after at the same moment comes later
    counted = both.select(*IDS, "is_after", earlier.alias("earlier"), F.sum("is_after").over(Window.partitionBy("trial_id")).alias("until"))
    return counted.where("is_after = 0").select(*IDS, (F.col("earlier") + 1).alias("since"), "until")


def successor_pairs(befores: DataFrame, afters: DataFrame) -> DataFrame:
    """(trial_id, before_model, before, after_model, after) of two sets, but a moment with itself."""
    of = successor_ranges(befores, afters).select("trial_id", F.col("model").alias("before_model"), F.col("id").alias("before"), "since")
    to = ranked(afters).select("trial_id", F.col("model").alias("after_model"), F.col("id").alias("after"), "rank")
    apart = (F.col("before_model") != F.col("after_model")) | (F.col("before") != F.col("after"))
    return of.join(to, "trial_id").where((F.col("rank") >= F.col("since")) & apart).drop("since", "rank")


def successor_names(befores: DataFrame, afters: DataFrame) -> DataFrame:
    """(before_model, before, after_model, after): names of which one precedes the other in some trial.

    Both have (trial_id, model, id, name, at). The first of a name precedes what any of it does, and the last
    of a name follows what any of it does; only a thing that is alone with its model and name in its trial doesn't
    precede them.
    """
    first = befores.groupBy("trial_id", F.col("model").alias("before_model"), F.col("name").alias("before")).agg(F.min("at").alias("first"), F.min("id").alias("least"), F.max("id").alias("most"))
    last = afters.groupBy("trial_id", F.col("model").alias("after_model"), F.col("name").alias("after")).agg(F.max("at").alias("last"))
    alone = (F.col("before_model") == F.col("after_model")) & (F.col("before") == F.col("after")) & (F.col("least") == F.col("most"))
    return first.join(last, "trial_id").where((F.col("first") <= F.col("last")) & ~alone).select("before_model", "before", "after_model", "after").distinct()
