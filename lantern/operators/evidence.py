"""Fusing evidence of several kinds into hypotheses, and judging them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.operators.ranking import ranked, share

#: The weight of each kind of evidence.
WEIGHTS = {"metric": 0.30, "trace": 0.30, "change": 0.15, "log": 0.10, "topology": 0.05, "temporal": 0.10}


def fuse(raw: DataFrame, weights: Mapping[str, float] = WEIGHTS, horizon_s: float = 300.0) -> DataFrame:
    """(case_id, entity, evidence, composite, margin, confidence, rank).

    raw has, per candidate, metric, trace, log, topology, change, consistency (null is 1) and first_ts (null: no onset).  Metrics, traces
    and topology count over the case's largest, logs so after log1p, onsets by closeness to the earliest.
    """
    w = Window.partitionBy("case_id")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    temporal = F.when(F.col("first_ts").isNotNull(), F.greatest(F.lit(0.0), 1 - (F.col("first_ts") - F.min("first_ts").over(w)) / horizon_s)).otherwise(0.0)
    parts = {"metric": share(zero("metric"), ["case_id"]), "trace": share(zero("trace"), ["case_id"]), "log": share(F.log1p(zero("log")), ["case_id"]), "topology": share(zero("topology"), ["case_id"]), "change": zero("change"), "temporal": temporal}
    scored = raw.withColumns({f"n_{k}": v for k, v in parts.items()})
    ev = sum((F.col(f"n_{k}") * weights.get(k, 0.0) for k in parts), F.lit(0.0))
    cc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("consistency", F.lit(1.0))))
    out = scored.withColumn("evidence", F.round(ev, 9)).withColumn("composite", F.round(ev * (0.4 + 0.6 * cc), 9))
    order = [F.desc("composite"), F.asc("entity")]
    r = ranked(out, ["case_id"], order)
    nxt = F.coalesce(F.lead("composite").over(Window.partitionBy("case_id").orderBy(*order)), F.lit(0.0))
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("composite") - nxt) / F.greatest("composite", F.lit(1e-6))))
    r = r.withColumn("margin", F.round(margin, 6))
    conf = F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.col("composite") * (0.75 + 0.25 * F.col("margin"))))
    return r.select("case_id", "entity", "evidence", "composite", "margin", F.round(conf, 6).alias("confidence"), "rank")


def disambiguate(profiles: DataFrame, threshold: float = 0.15, lead_needed: float = 1.05) -> DataFrame:
    """(case_id, first, chosen, margin, switched): where the first two are close, the best composite of the first three.

    profiles has case_id, entity, score, elevation, residual.  A later candidate takes over only if it beats the best so far by 5 %;
    the order of the first three matters, so it is a fold over an array of three.
    """
    r = ranked(profiles, ["case_id"], [F.desc("score"), F.asc("entity")]).where("rank <= 3")
    zero = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    comp = 0.4 * zero("score") + 0.3 * F.least(F.lit(1.0), zero("elevation")) + 0.3 * F.least(F.lit(1.0), zero("residual") / 5)
    g = r.select("case_id", F.struct("rank", "entity", zero("score").alias("score"), F.round(comp, 9).alias("c")).alias("x")).groupBy("case_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    first = F.get("xs", F.lit(0))
    margin = F.when(F.size("xs") > 1, first["score"] - F.get("xs", F.lit(1))["score"]).otherwise(1.0)

    def better(acc: Column, x: Column) -> Column:
        return F.when(x["c"] > acc["c"] * lead_needed, x).otherwise(acc)

    best = F.aggregate(F.slice("xs", 2, 2), first, better)
    chosen = F.when(margin < threshold, best["entity"]).otherwise(first["entity"])
    return g.select("case_id", first["entity"].alias("first"), chosen.alias("chosen"), F.round(margin, 9).alias("margin"), (chosen != first["entity"]).alias("switched"))


def rate_limit(events: DataFrame, key: str, time_us: str, seconds: int = 60, most: int = 3) -> DataFrame:
    """Events with the number of the key's events in the seconds up to each, and whether that is within the limit."""
    w = Window.partitionBy(key).orderBy(time_us).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("allowed", F.col("recent") <= most)


def tool_evidence(universe: DataFrame, evidence: DataFrame, elevation: DataFrame, logs: DataFrame, edges: DataFrame, error: str) -> DataFrame:
    """(case_id, entity, tool, cost, value): what each kind of query would tell of every entity of the universe; nothing is 0.

    metrics: most metrics anomalous at once; traces: latency elevation; logs: lines that tell of an error; neighbours: callers
    and callees; health: 1 with an episode; change: lines that tell of a deployment or restart.  All kinds are made in one
    pass each, so that a search only selects.  logs has case_id, container and message.
    """
    from lantern.operators.prepare import is_change
    from lantern.operators.ranking import COSTS

    said = logs.groupBy("case_id", F.col("container").alias("entity")).agg(F.count_if(F.col("message").rlike(error)).alias("logs"), F.count_if(is_change(F.col("message"))).alias("change"))
    ends = edges.select("case_id", F.inline(F.array(F.struct(F.col("src").alias("entity"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("entity"), F.col("src").alias("other"))))).where("entity <> other")
    near = ends.groupBy("case_id", "entity").agg(F.count_distinct("other").alias("neighbours"))
    own = evidence.select("case_id", "entity", F.col("peak_active").alias("metrics"), F.col("has_episode").cast("int").alias("health"))
    traced = elevation.select("case_id", "entity", F.col("score").alias("traces"))
    full = universe.select("case_id", "entity").distinct()
    for part in (own, traced, said, near):
        full = full.join(part, ["case_id", "entity"], "left")
    told = F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(c).alias("cost"), F.coalesce(F.col(t).cast("double"), F.lit(0.0)).alias("value")) for t, c in COSTS.items()])
    return full.select("case_id", "entity", F.inline(told))
