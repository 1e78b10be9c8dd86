"""Registered queries of succession in time, over trials, activations, evaluations and accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineagraph.operators import succession as su
from lineagraph.plans.queries import query
from lineagraph.sources.store import Store

#: Moments of all models: an activation begins before what follows its start, and follows what precedes its finish.
BEFORE = (
    ", befores AS (SELECT trial_id, 'activation' AS model, id, name, start_checkpoint AS t FROM activation UNION ALL SELECT trial_id, 'evaluation', e.id, c.name, e.activation_id * 10 + e.checkpoint FROM evaluation e JOIN code_component c ON c.id = e.code_component_id "
    "UNION ALL SELECT trial_id, 'access', id, name, id * 10 FROM file_access UNION ALL SELECT trial_id, 'trial', 0, 'trial', min(start_checkpoint) FROM activation GROUP BY 1) "
)
AFTER = (
    ", afters AS (SELECT trial_id, 'activation' AS model, id, name, finish_checkpoint AS t FROM activation UNION ALL SELECT trial_id, model, id, name, t FROM befores WHERE model IN ('evaluation', 'access') "
    "UNION ALL SELECT trial_id, 'trial', 0, 'trial', max(finish_checkpoint) FROM activation GROUP BY 1) "
)
RANGES = (
    ", ranges AS (SELECT b.trial_id, b.model, b.id, 1 + count(a.id) FILTER (a.t < b.t) AS since, count(a.id) AS until FROM befores b LEFT JOIN afters a ON a.trial_id = b.trial_id GROUP BY 1, 2, 3) "
)


def moments(s: Store) -> tuple[DataFrame, DataFrame]:
    row = lambda t, model, id_, name, at: t.select("trial_id", F.lit(model).alias("model"), id_.cast("long").alias("id"), name.alias("name"), at.cast("long").alias("at"))
    named = s.evaluation.join(s.code_component.select(F.col("id").alias("code_component_id"), "name"), "code_component_id")
    same = row(named, "evaluation", F.col("id"), F.col("name"), F.col("activation_id") * 10 + F.col("checkpoint")).unionByName(row(s.file_access, "access", F.col("id"), F.col("name"), F.col("id") * 10))
    span = s.activation.groupBy("trial_id").agg(F.min("start_checkpoint").alias("start"), F.max("finish_checkpoint").alias("finish"))
    of_trial = lambda at: row(span, "trial", F.lit(0), F.lit("trial"), F.col(at))
    of_call = lambda at: row(s.activation, "activation", F.col("id"), F.col("name"), F.col(at))
    return same.unionByName(of_trial("start")).unionByName(of_call("start_checkpoint")), same.unionByName(of_trial("finish")).unionByName(of_call("finish_checkpoint"))


def written_after_urgent(s: Store) -> DataFrame:
    befores, afters = moments(s)
    return su.successor_pairs(befores.where("model = 'activation' and name = '1-URGENT'"), afters.where("model = 'access' or model = 'trial'"))


def influencers(s: Store) -> DataFrame:
    """How many activations may have influenced each: those that start no later than it finishes, but itself."""
    starts = s.activation.select("trial_id", F.lit("activation").alias("model"), "id", (-F.col("start_checkpoint")).alias("at"))
    ends = s.activation.select("trial_id", F.lit("activation").alias("model"), "id", (-F.col("finish_checkpoint")).alias("at"))
    return su.successor_ranges(ends, starts).select("trial_id", "id", (F.col("until") - F.col("since")).alias("influencers"))


ALL = "activation evaluation code_component file_access"
query("rul_08_successor_ranges", ALL, BEFORE + AFTER + RANGES + "SELECT * FROM ranges")(lambda s: su.successor_ranges(*moments(s)))
query(
    "rul_08_pairs_asked_for",
    ALL,
    BEFORE + AFTER + "SELECT b.trial_id, b.model AS before_model, b.id AS before, a.model AS after_model, a.id AS after FROM befores b JOIN afters a ON a.trial_id = b.trial_id AND b.t <= a.t WHERE b.model = 'activation' AND b.name = '1-URGENT' AND a.model IN ('access', 'trial')",
)(written_after_urgent)
query(
    "rul_09_names_in_succession",
    ALL,
    BEFORE + AFTER + "SELECT DISTINCT b.model AS before_model, b.name AS before, a.model AS after_model, a.name AS after FROM befores b JOIN afters a ON a.trial_id = b.trial_id AND b.t <= a.t AND (a.model <> b.model OR a.id <> b.id) WHERE b.model <> 'evaluation' AND a.model <> 'evaluation'",
)(lambda s: su.successor_names(*(m.where("model <> 'evaluation'") for m in moments(s))))
query(
    "rul_25_influencer_counts",
    "activation",
    "SELECT b.trial_id, b.id, count(a.id) AS influencers FROM activation b LEFT JOIN activation a ON a.trial_id = b.trial_id AND a.id <> b.id AND a.start_checkpoint <= b.finish_checkpoint GROUP BY 1, 2",
)(influencers)
