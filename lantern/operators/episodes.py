"""Episodes: maximal intervals in which an entity has enough persistent anomalous metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.detect import streaks


def entity_steps(points: DataFrame, persistence: int = 3, consensus: int = 2) -> DataFrame:
    """(case_id, entity, obs_idx, ts, active, contributing, in_episode) of every step."""
    on = F.col("streak") >= persistence
    step = streaks(points).groupBy("case_id", "entity", "obs_idx", "ts").agg(F.count_if(on).alias("active"), F.collect_list(F.when(on, F.col("metric"))).alias("contributing"))
    return step.withColumn("in_episode", F.col("active") >= consensus)


def entity_episodes(steps: DataFrame) -> DataFrame:
    """(case_id, entity, start_idx, end_idx, start_ts, end_ts, duration_s, peak_active, metrics): gaps and islands."""
    inside = steps.where("in_episode")
    island = F.col("obs_idx") - F.row_number().over(Window.partitionBy("case_id", "entity").orderBy("obs_idx"))
    return (
        inside.withColumn("_island", island)
        .groupBy("case_id", "entity", "_island")
        .agg(F.min("obs_idx").alias("start_idx"), F.max("obs_idx").alias("end_idx"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.max("active").alias("peak_active"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("contributing")))).alias("metrics"))
        .withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))
        .drop("_island")
    )


def truncate(episodes: DataFrame, steps: DataFrame, cutoff: int) -> DataFrame:
    """Episodes as known at ``cutoff``: later ones go, a running one ends at the last step observed by then."""
    last = steps.where(F.col("ts") <= cutoff).groupBy("case_id", "entity").agg(F.max("ts").alias("_ts"), F.max("obs_idx").alias("_idx"))
    seen = episodes.where(F.col("start_ts") <= cutoff).join(last, ["case_id", "entity"])
    out = seen.withColumns({"end_ts": F.least("end_ts", "_ts"), "end_idx": F.least("end_idx", "_idx")})
    return out.withColumn("duration_s", F.col("end_ts") - F.col("start_ts")).drop("_ts", "_idx")


def evidence(steps: DataFrame) -> DataFrame:
    """(case_id, entity, has_episode, first_ts, peak_active): peak over all steps, first start of an episode."""
    return steps.groupBy("case_id", "entity").agg(F.max("in_episode").alias("has_episode"), F.min(F.when(F.col("in_episode"), F.col("ts"))).alias("first_ts"), F.max("active").alias("peak_active"))
