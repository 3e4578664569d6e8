"""Consistency of a hypothesis with time and topology, onset features, and shifts between rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.graph import within


def earliness(evidence: DataFrame) -> DataFrame:
    """(case_id, entity, earliness): 1 for the earliest onset of the case, 0 for the latest, and 0 where all are equal or there is none."""
    w = Window.partitionBy("case_id")
    t0, t1 = F.min("first_ts").over(w), F.max("first_ts").over(w)
    e = F.when(F.col("first_ts").isNull() | (t0 == t1), 0.0).otherwise(1 - (F.col("first_ts") - t0) / (t1 - t0))
    return evidence.select("case_id", "entity", F.round(e, 9).alias("earliness"))


def consistency(evidence: DataFrame, edges: DataFrame, latency: DataFrame) -> DataFrame:
    """(case_id, entity, temporal, topology, propagation, score, passed) of every entity as the suspected root.

    Temporal: against the first onset of any other entity, 1 if not later, .85 within 15 s, .4 later; .9 if no other has one, .7 without onset.
    Topology: 1 if an entity with an onset is at most two edges away, in any direction, .5 if all of them are further, .9 if there is no other.
    Propagation: an onset of its own and a latency score (``latency``: case_id, entity, score) above .4 anywhere in the case
    give 1, the onset alone .85, the latency alone .8, neither .5.  Weights .35, .35, .30; passed from .65.
    """
    hot = F.col("has_episode")
    own = evidence.select("case_id", "entity", F.when(hot, F.col("first_ts")).alias("t"))
    # The first onset of the others: the case's two first ones tell it for every entity, so entities aren't paired.
    firsts = own.where("t is not null").withColumn("_r", F.row_number().over(Window.partitionBy("case_id").orderBy("t", "entity"))).where("_r <= 2")
    case = firsts.groupBy("case_id").agg(F.min("t").alias("_t1"), F.max(F.when(F.col("_r") == 1, F.col("entity"))).alias("_e1"), F.max(F.when(F.col("_r") == 2, F.col("t"))).alias("_t2"))
    slow = latency.groupBy("case_id").agg(F.max(F.col("score") > 0.4).alias("_slow"))
    there = own.where("t is not null").select(F.col("case_id").alias("_c"), F.col("entity").alias("_d"))
    near = within(edges, 2).join(there, (F.col("case_id") == F.col("_c")) & (F.col("dst") == F.col("_d"))).select("case_id", F.col("src").alias("entity")).distinct().withColumn("_near", F.lit(True))
    j = own.join(case, "case_id", "left").join(slow, "case_id", "left").join(near, ["case_id", "entity"], "left")
    first = F.when(F.col("entity") == F.col("_e1"), F.col("_t2")).otherwise(F.col("_t1"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    temporal = F.when(F.col("t").isNull(), 0.7).when(first.isNull(), 0.9).when(F.col("t") <= first, 1.0).when(F.col("t") - first <= 15, 0.85).otherwise(0.4)
    topology = F.when(first.isNull(), 0.9).when(yes("_near"), 1.0).otherwise(0.5)
    prop = F.when(F.col("t").isNotNull() & yes("_slow"), 1.0).when(F.col("t").isNotNull(), 0.85).when(yes("_slow"), 0.8).otherwise(0.5)
    out = j.select("case_id", "entity", temporal.alias("temporal"), topology.alias("topology"), prop.alias("propagation"))
    score = F.round(0.35 * F.col("temporal") + 0.35 * F.col("topology") + 0.30 * F.col("propagation"), 9)
    return out.withColumn("score", score).withColumn("passed", F.col("score") >= 0.65)


def shifts(before: DataFrame, after: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, entity, old_rank, new_rank, shift): promoted, demoted or same, and whether the case's new first entity calls it."""
    a = before.select("case_id", "entity", F.col("rank").alias("old_rank"))
    b = after.select("case_id", "entity", F.col("rank").alias("new_rank"))
    top = b.where("new_rank = 1").select(F.col("case_id").alias("_c"), F.col("entity").alias("_top"))
    called = edges.select(F.col("case_id").alias("_c"), F.col("src").alias("_top"), F.col("dst").alias("_d")).distinct().join(top, ["_c", "_top"]).select("_c", "_d")
    j = a.join(b, ["case_id", "entity"]).join(called, (F.col("case_id") == F.col("_c")) & (F.col("entity") == F.col("_d")), "left")
    kind = F.when(F.col("new_rank") < F.col("old_rank"), "promoted").when(F.col("new_rank") > F.col("old_rank"), "demoted").otherwise("same")
    return j.select("case_id", "entity", "old_rank", "new_rank", kind.alias("shift"), F.col("_d").isNotNull().alias("downstream"))


def recovery(before: DataFrame, after: DataFrame, key: str, value: str, tolerance: float = 0.1) -> DataFrame:
    """(key, before, after, verdict) of a full outer comparison of two snapshots: recovered, worse, same, appeared or gone."""
    a = before.select(F.col(key).alias("_k1"), F.col(value).alias("before"))
    b = after.select(F.col(key).alias("_k2"), F.col(value).alias("after"))
    j = a.join(b, F.col("_k1").eqNullSafe(F.col("_k2")), "full_outer")
    x, y = F.col("before"), F.col("after")
    verdict = F.when(x.isNull(), "appeared").when(y.isNull(), "gone").when(y < x * (1 - tolerance), "recovered").when(y > x * (1 + tolerance), "worse").otherwise("same")
    return j.select(F.coalesce("_k1", "_k2").alias(key), "before", "after", verdict.alias("verdict"))


def sampled_series(metrics: DataFrame, step: int = 15, most: int = 30) -> DataFrame:
    """Every step-th observation of a metric, at most ``most``, as a plot would show it."""
    return metrics.where((F.col("obs_idx") % step == 0) & (F.col("obs_idx") < step * most)).select("case_id", "metric", "obs_idx", "value")


def windows(metrics: DataFrame, onset: int, rows: int = 600) -> DataFrame:
    """(case_id, metric, ts, value, side): forward-filled values, the last ``rows`` before the onset and the first after it."""
    order = Window.partitionBy("case_id", "metric").orderBy("obs_idx")
    filled = metrics.withColumn("value", F.last("value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    side = filled.withColumn("side", F.when(F.col("ts") < onset, "normal").otherwise("incident"))
    n = F.when(F.col("side") == "normal", F.row_number().over(Window.partitionBy("case_id", "metric", "side").orderBy(F.desc("obs_idx")))).otherwise(F.row_number().over(Window.partitionBy("case_id", "metric", "side").orderBy("obs_idx")))
    return side.withColumn("_n", n).where(F.col("_n") <= rows).select("case_id", "metric", "ts", "value", "side")


def verify_recovery(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """(case_id, recovered, unresolved, regressions, status, support) of an intervention, from two snapshots of every service.

    Snapshots have case_id, service, anomaly_score, latency_p90 and error_rate, absent values count 0; targets has case_id and target.
    A symptom is a score above .2, a latency above 100 or any errors.  It is recovered when it is gone, or when a score fell by 65 %;
    a score that rises from there to above .4, or more errors than before and than 5, is a regression.  The status is RESOLVED,
    NOT_RESOLVED or UNCERTAIN; support says whether the outcome speaks for the target: SUPPORTS, CONTRADICTS or INCONCLUSIVE.
    """
    names = ("anomaly_score", "latency_p90", "error_rate")
    side = lambda df, tag: df.select(F.col("case_id").alias(f"_c{tag}"), F.col("service").alias(f"_s{tag}"), *[F.col(c).cast("double").alias(f"{tag}{i}") for i, c in enumerate(names)])
    j = side(before, "b").join(side(after, "a"), (F.col("_cb") == F.col("_ca")) & (F.col("_sb") == F.col("_sa")), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    b, a = [zero(f"b{i}") for i in range(3)], [zero(f"a{i}") for i in range(3)]
    hot = b[0] > 0.2
    healed = hot & ((a[0] <= 0.2) | (F.coalesce(F.try_divide(b[0] - a[0], b[0]), F.lit(0.0)) >= 0.65))
    counts = {
        "rec": healed.cast("int") + ((b[1] > 100) & (a[1] <= 100)).cast("int") + ((b[2] > 0) & (a[2] == 0)).cast("int"),
        "left": (hot & ~healed).cast("int") + ((b[1] > 100) & (a[1] > 100)).cast("int"),
        "worse": (~hot & (a[0] > 0.4)).cast("int") + ((a[2] > b[2]) & (a[2] > 5)).cast("int"),
    }
    each = j.select(F.coalesce("_cb", "_ca").alias("case_id"), F.coalesce("_sb", "_sa").alias("service"), *[v.alias(k) for k, v in counts.items()], (hot | (b[1] > 100) | (b[2] > 0)).alias("sick"), F.col("b0").isNotNull().alias("seen"))
    t = targets.select(F.col("case_id").alias("_t"), F.coalesce("target", F.lit("")).alias("target"))
    each = each.join(t, F.col("case_id") == F.col("_t"), "left").withColumn("target", F.coalesce("target", F.lit("")))
    own = F.contains(F.col("service"), F.col("target")) & (F.col("target") != "")
    if_ = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    g = each.groupBy("case_id").agg(
        F.sum("rec").alias("recovered"), F.sum("left").alias("unresolved"), F.sum("worse").alias("regressions"), if_(own, "rec").alias("own_rec"), if_(~own, "rec").alias("far_rec"), if_(~own, "left").alias("far_left"),
        F.max(F.col("sick") & (F.col("service") != F.col("target"))).alias("far_sick"), F.max("seen").alias("seen"), F.max("target").alias("target"),
    )
    target_well, worse, left = (F.col("target") == "") | (F.col("own_rec") > 0), F.col("regressions") > 0, F.col("unresolved") > 0
    status = F.when(worse | (left & ~target_well), "NOT_RESOLVED").when(left, "UNCERTAIN").when((F.col("recovered") > 0) | ~F.col("seen"), "RESOLVED").otherwise("UNCERTAIN")
    g = g.withColumn("status", status)
    far_well = (F.col("far_left") == 0) & (~F.col("far_sick") | (F.col("far_rec") > 0) | (F.col("status") == "RESOLVED"))
    support = F.when(worse | ((F.col("status") == "NOT_RESOLVED") & (F.col("own_rec") == 0)), "CONTRADICTS").when((F.col("status") == "RESOLVED") & (far_well | ~F.col("far_sick")), "SUPPORTS").otherwise("INCONCLUSIVE")
    return g.select("case_id", "recovered", "unresolved", "regressions", "status", support.alias("support"))
