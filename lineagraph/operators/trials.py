"""Selections over trials, tags and file accesses of trials."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineagraph.functions.scalars import basename, duration_micros, version_parts


def distinct_scripts(trial: DataFrame) -> DataFrame:
    return trial.select(basename(F.col("script")).alias("script")).distinct()


def last_trial(trial: DataFrame, script: str) -> DataFrame:
    """The trials that start when the script's last one does; the script is not asked for again."""
    latest = trial.where(F.col("script") == script).agg(F.max("start").alias("start"))
    return trial.join(F.broadcast(latest), "start", "left_semi")


def find_by_name_and_time(trial: DataFrame, script: str, prefix: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").startswith(prefix)
    return trial.where((F.col("script") == script) & (text("start") | text("finish"))).orderBy("start", "id").limit(1)


def load_trial(trial: DataFrame, tag: DataFrame, ref: str) -> DataFrame:
    """Trials whose id or one of whose tags is the reference."""
    tagged = trial.join(tag.select(F.col("trial_id").alias("id"), F.col("name").alias("tag")), "id", "left")
    return tagged.where((F.col("id").cast("string") == ref) | (F.col("tag") == ref)).drop("tag").distinct()


def last_own_modules(trial: DataFrame) -> DataFrame:
    """The latest trial that inherits its modules from no other."""
    return trial.where("inherited_id is null and start is not null").agg(F.max_by("id", F.struct("start", "id")).alias("id"))


def reverse_trials(trial: DataFrame, limit: int, experiment: int | None) -> DataFrame:
    return trial.where(F.col("experiment_id").eqNullSafe(F.lit(experiment))).orderBy(F.desc_nulls_last("start"), "id").limit(limit)


def count_by_experiment(trial: DataFrame) -> DataFrame:
    return trial.groupBy("experiment_id").agg(F.count("*").alias("trials"))


def durations(trial: DataFrame) -> DataFrame:
    return trial.select("id", duration_micros(F.col("start"), F.col("finish")).alias("micros"))


def modules(trial: DataFrame, module: DataFrame) -> DataFrame:
    """(trial, module): the modules of the trial that a trial inherits from, else its own."""
    owner = trial.select(F.col("id").alias("trial"), F.coalesce("inherited_id", "id").alias("trial_id"))
    return owner.join(module.withColumnRenamed("id", "module"), "trial_id").select("trial", "module", "name", "version")


def environment(attributes: DataFrame) -> DataFrame:
    """Per trial and name the last value."""
    return attributes.groupBy("trial_id", "name").agg(F.max("value").alias("value"))


def environment_map(attributes: DataFrame) -> DataFrame:
    named = environment(attributes)
    return named.groupBy("trial_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("environment"))


def versioned_files(trial: DataFrame, module: DataFrame, access: DataFrame) -> DataFrame:
    """Per trial and path one row: an access before a module before the script, the first access first."""
    rows = (
        access.select("trial_id", F.col("name").alias("path"), F.lit("access").alias("kind"), F.lit(2).alias("rank"), "id")
        .unionByName(module.select("trial_id", F.col("name").alias("path"), F.lit("module").alias("kind"), F.lit(1).alias("rank"), "id"))
        .unionByName(trial.select(F.col("id").alias("trial_id"), F.col("script").alias("path"), F.lit("script").alias("kind"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id")))
    )
    best = F.row_number().over(Window.partitionBy("trial_id", "path").orderBy(F.desc("rank"), "id"))
    return rows.withColumn("place", best).where("place = 1").select("trial_id", "path", "kind", "id")


def access_versions(access: DataFrame, suffix: str) -> DataFrame:
    """Contents before and after each access of the paths with a suffix, in order."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("moment"), F.col("content_hash_before").alias("hash")), F.struct(F.lit(1).alias("moment"), F.col("content_hash_after").alias("hash"))))
    return access.where(F.col("name").endswith(suffix)).select("trial_id", "id", "name", both.alias("x")).select("trial_id", "id", "name", "x.moment", "x.hash").where("hash is not null")


def report(trial: DataFrame, tag: DataFrame) -> DataFrame:
    tags = tag.groupBy(F.col("trial_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"), F.count("*").alias("n_tags"))
    return trial.join(tags, "id", "left").select("id", "script", "status", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("n_tags", F.lit(0)).alias("n_tags"))


def latest_tag(tag: DataFrame) -> DataFrame:
    """Per trial the greatest automatic tag, by its numbers."""
    auto = tag.where("type = 'AUTO'").withColumn("parts", version_parts(F.col("name")))
    return auto.groupBy("trial_id").agg(F.max_by("name", "parts").alias("name"))


def next_tags(tag: DataFrame) -> DataFrame:
    """What patch, minor and major bumps make of each trial's latest tag."""
    p = version_parts(F.col("name"))
    dotted = lambda *xs: F.concat_ws(".", *(x.cast("string") for x in xs))
    return latest_tag(tag).select("trial_id", "name", dotted(p[0], p[1], p[2] + 1).alias("patch"), dotted(p[0], p[1] + 1, F.lit(1)).alias("minor"), dotted(p[0] + 1, F.lit(1), F.lit(1)).alias("major"))


def differing_files(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Paths (path, hash) whose stored and found contents differ, a missing one included."""
    both = stored.select("path", F.col("hash").alias("stored")).join(found.select("path", F.col("hash").alias("found")), "path", "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("found")))
