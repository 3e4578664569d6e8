"""Strictly causal anomaly detection on long metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["case_id", "metric"]


def is_close(a: Column, b: Column, rel: float = 1e-9, tol: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def _status(center: Column, spread: Column, n: Column, value: Column, warmup: int, least: int, threshold: float, epsilon: float) -> tuple[Column, Column]:
    """(status, signed score).  The order of the cases is the contract: warm-up, missing, too short, flat, scored."""
    flat = spread <= 1e-12
    z = F.when(flat, F.when(is_close(value, center), F.lit(0.0)).otherwise((value - center) / epsilon)).otherwise((value - center) / (spread + epsilon))
    out = F.when(flat, ~is_close(value, center)).otherwise(F.abs(z) >= threshold)
    status = F.when(F.col("obs_idx") < warmup, "warmup").when(value.isNull(), "missing_observation").when(n < least, "insufficient_history").when(out, "anomaly").otherwise("normal")
    return status, F.when(status.isin("anomaly", "normal"), z)


def check_parameters(window: int, threshold: float, warmup: int, least: int) -> None:
    if window < 1 or warmup < 1 or not 1 <= least <= window or threshold <= 0:
        raise ValueError("window, warm-up, history and threshold must be positive, and the history fit the window")


def zscore_points(metrics: DataFrame, window: int = 60, threshold: float = 3.0, warmup: int | None = None, least: int | None = None, epsilon: float = 1e-6) -> DataFrame:
    """(case_id, entity, metric, ts, obs_idx, status, score, is_anomaly, valid_history): z against the rows before.

    The frame counts rows, nulls included; mean and spread are over its values that are not null.  NaN is null.
    """
    warmup = window if warmup is None else warmup
    least = max(2, warmup // 2) if least is None else least
    check_parameters(window, threshold, warmup, least)
    frame = Window.partitionBy(*SERIES).orderBy("obs_idx").rowsBetween(-window, -1)
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    df = metrics.withColumn("value", v)
    df = df.withColumns({"_n": F.count("value").over(frame), "_mu": F.avg("value").over(frame), "_sd": F.stddev_pop("value").over(frame), "_lo": F.min("value").over(frame), "_hi": F.max("value").over(frame)})
    # A constant frame has no spread at all; rounding in the running mean mustn't suggest one.
    same = F.col("_lo") == F.col("_hi")
    df = df.withColumns({"_mu": F.when(same, F.col("_lo")).otherwise(F.col("_mu")), "_sd": F.when(same, F.lit(0.0)).otherwise(F.col("_sd"))})
    status, z = _status(F.col("_mu"), F.col("_sd"), F.col("_n"), F.col("value"), warmup, least, threshold, epsilon)
    return df.select("case_id", "entity", "metric", "ts", "obs_idx", status.alias("status"), z.alias("score"), (status == "anomaly").alias("is_anomaly"), F.col("_n").alias("valid_history"))


def mad_points(metrics: DataFrame, window: int = 60, threshold: float = 3.0, warmup: int | None = None, least: int | None = None, epsilon: float = 1e-6) -> DataFrame:
    """As :func:`zscore_points`, with the median and 1.4826 times the median absolute deviation of the frame."""
    warmup = window if warmup is None else warmup
    least = max(2, warmup // 2) if least is None else least
    check_parameters(window, threshold, warmup, least)
    frame = Window.partitionBy(*SERIES).orderBy("obs_idx").rowsBetween(-window, -1)
    df = metrics.withColumn("value", F.nanvl(F.col("value"), F.lit(None).cast("double"))).withColumn("_f", F.collect_list("value").over(frame))

    def middle(a: Column) -> Column:
        s, n = F.array_sort(a), F.size(a)
        at = lambda i: F.get(s, i.cast("int"))
        return F.when(n == 0, F.lit(None)).when(n % 2 == 1, at((n - 1) / 2)).otherwise((at(n / 2 - 1) + at(n / 2)) / 2)

    df = df.withColumn("_med", middle(F.col("_f")))
    df = df.withColumn("_mad", middle(F.transform("_f", lambda x: F.abs(x - F.col("_med")))) * 1.4826).withColumn("_n", F.size("_f"))
    status, z = _status(F.col("_med"), F.col("_mad"), F.col("_n"), F.col("value"), warmup, least, threshold, epsilon)
    return df.select("case_id", "entity", "metric", "ts", "obs_idx", status.alias("status"), z.alias("score"), (status == "anomaly").alias("is_anomaly"), F.col("_n").cast("bigint").alias("valid_history"))


def as_of(points: DataFrame, cutoff: int, time: str = "ts") -> DataFrame:
    """The causal prefix: what could be known at ``cutoff``."""
    return points.where(F.col(time) <= cutoff)


def metric_summary(points: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return points.groupBy("case_id", "metric").agg(F.max(F.abs("score")).alias("peak_score"), *[n(s) for s in ("warmup", "missing_observation", "insufficient_history", "normal", "anomaly")], F.min(F.when(F.col("is_anomaly"), F.col("ts"))).alias("first_anomaly_ts"))


def case_summary(points: DataFrame) -> DataFrame:
    hit = F.col("is_anomaly")
    return points.groupBy("case_id").agg(
        F.count_distinct(F.when(hit, F.col("metric"))).alias("detected_metrics"),
        F.min(F.when(hit, F.col("ts"))).alias("earliest_ts"),
        F.count_if(hit).alias("anomalies"),
        F.count_distinct(F.when(hit, F.col("obs_idx"))).alias("observations_with_anomaly"),
    )


def entity_evidence(points: DataFrame) -> DataFrame:
    hit = F.col("is_anomaly")
    step = points.groupBy("case_id", "entity", "ts").agg(F.count_if(hit).alias("active"), F.collect_set(F.when(hit, F.col("metric"))).alias("m"))
    return step.groupBy("case_id", "entity").agg(
        F.max("active").alias("peak_active"),
        F.min(F.when(F.col("active") > 0, F.col("ts"))).alias("first_anomaly_ts"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("m")))), ",").alias("anomalous_metrics"),
    )


def streaks(points: DataFrame) -> DataFrame:
    """Length of the run of anomalies that ends at each row; anything else resets it."""
    w = Window.partitionBy(*SERIES).orderBy("obs_idx")
    run = points.withColumn("_g", F.sum((~F.col("is_anomaly")).cast("int")).over(w))
    inside = Window.partitionBy(*SERIES, "_g").orderBy("obs_idx").rowsBetween(Window.unboundedPreceding, 0)
    return run.withColumn("streak", F.sum(F.col("is_anomaly").cast("int")).over(inside)).drop("_g")


def case_alarms(points: DataFrame, persistence: int = 1, consensus: int = 1) -> DataFrame:
    """(case_id, ts, active, alarm): at least ``consensus`` metrics whose streak is ``persistence`` or longer."""
    if persistence < 1 or consensus < 1:
        raise ValueError("persistence and consensus start at 1")
    on = F.count_if(F.col("streak") >= persistence)
    return streaks(points).groupBy("case_id", "ts").agg(on.alias("active"), (on >= consensus).alias("alarm"))
