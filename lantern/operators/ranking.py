"""Rankings of root-cause candidates.  Every order is total: the last key is a name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(x: Column, group: Sequence[str]) -> Column:
    """x over the largest x of the group; 0 where that is not positive."""
    top = F.max(x).over(Window.partitionBy(*group))
    return F.when(top > 0, x / top).otherwise(F.lit(0.0))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def s_comb(points: DataFrame, steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, entity, score, first_ts, rank): half peak number of active metrics, half summed log of their peak scores.

    A metric that contributes to any episode of the entity counts with its largest score over all of the entity's episode steps.
    """
    inside = steps.where("in_episode").select("case_id", "entity", "obs_idx")
    contributes = steps.where("in_episode").select("case_id", "entity", F.explode("contributing").alias("metric")).distinct()
    in_steps = points.join(inside, ["case_id", "entity", "obs_idx"], "left_semi").join(contributes, ["case_id", "entity", "metric"], "left_semi")
    peak = in_steps.groupBy("case_id", "entity", "metric").agg(F.max(F.greatest(F.coalesce(F.abs("score"), F.lit(0.0)), F.lit(0.0))).alias("z"))
    mag = peak.groupBy("case_id", "entity").agg(F.sum(F.log1p("z")).alias("_m"))
    own = evidence.join(mag, ["case_id", "entity"], "left")
    own = own.withColumns({"_c": F.when(F.col("has_episode"), F.col("peak_active")).otherwise(0).cast("double"), "_m": F.coalesce("_m", F.lit(0.0))})
    score = F.when(F.col("has_episode"), 0.5 * share(F.col("_c"), ["case_id"]) + 0.5 * share(F.col("_m"), ["case_id"])).otherwise(0.0)
    scored = own.select("case_id", "entity", F.round(score, 9).alias("score"), F.when(F.col("has_episode"), F.col("first_ts")).alias("first_ts"))
    return ranked(scored, ["case_id"], [F.desc("score"), F.asc_nulls_last("first_ts"), F.asc("entity")])


def observational(evidence: DataFrame, edges: DataFrame, use: Mapping[str, bool]) -> DataFrame:
    """Strength, earliness, coverage and propagation of every entity, and the rank by the sum of those in ``use``."""
    w = Window.partitionBy("case_id")
    anom = F.col("has_episode")
    t0, t1 = F.min(F.when(anom, F.col("first_ts"))).over(w), F.max(F.when(anom, F.col("first_ts"))).over(w)
    peak = F.when(anom, F.col("peak_active")).otherwise(0).cast("double")
    own = evidence.select("case_id", "entity", "has_episode", F.when(anom, F.col("first_ts")).alias("first_ts"), peak.alias("peak"), F.when(~anom, F.lit(0.0)).when(t0 == t1, F.lit(1.0)).otherwise(1 - (F.col("first_ts") - t0) / (t1 - t0)).alias("r_early"))
    own = own.withColumn("r_strength", F.when(anom, share(F.col("peak"), ["case_id"])).otherwise(0.0))
    callee = own.select(F.col("case_id").alias("_c"), F.col("entity").alias("_e"), F.col("has_episode").alias("_a"), F.col("first_ts").alias("_t"))
    near = edges.select("case_id", "src", "dst").distinct().join(callee, (F.col("case_id") == F.col("_c")) & (F.col("dst") == F.col("_e")), "left").select(F.col("case_id").alias("_c"), F.col("src").alias("_e"), F.coalesce("_a", F.lit(False)).alias("_a"), "_t")
    full = own.join(near, (F.col("case_id") == F.col("_c")) & (F.col("entity") == F.col("_e")), "left")
    n, hit, later = F.count("_e"), F.count_if(F.col("_a")), F.count_if(F.col("_a") & (F.col("_t") >= F.col("first_ts")))
    part = lambda x: F.when(F.first("has_episode") & (n > 0), x / n).otherwise(0.0)
    out = full.groupBy("case_id", "entity").agg(*[F.first(c).alias(c) for c in ("first_ts", "peak", "r_early", "r_strength")], part(hit).alias("r_coverage"), part(later).alias("r_prop"))
    total = F.lit(0.0)
    for name in ("r_strength", "r_early", "r_coverage", "r_prop"):
        if use.get(name):
            total = total + F.col(name)
    out = out.select("case_id", "entity", F.round(total, 9).alias("score"), *[F.round(c, 9).alias(c) for c in ("r_strength", "r_early", "r_coverage", "r_prop")], "first_ts", "peak")
    return ranked(out, ["case_id"], [F.desc("score"), F.asc_nulls_last("first_ts"), F.desc("peak"), F.asc("entity")])


#: The four configurations of the observational ranking.
CONFIGURATIONS = {
    "a": {"r_strength": True},
    "b": {"r_strength": True, "r_early": True},
    "c": {"r_strength": True, "r_coverage": True},
    "d": {"r_strength": True, "r_early": True, "r_prop": True},
}


def by_score(universe: DataFrame, evidence: DataFrame, score: str) -> DataFrame:
    """Every entity of the universe by score, absent evidence as 0, then by name."""
    all_ = universe.select("case_id", "entity").distinct().join(evidence.select("case_id", "entity", F.col(score).alias("score")), ["case_id", "entity"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked(all_, ["case_id"], [F.desc("score"), F.asc("entity")])


def fuse_equal(rankings: Sequence[DataFrame]) -> DataFrame:
    """Equal-weight fusion: each score over its largest in the case, averaged; absent scores are 0."""
    union = None
    for i, r in enumerate(rankings):
        one = r.select("case_id", "entity", F.lit(i).alias("_i"), share(F.col("score"), ["case_id"]).alias("s"))
        union = one if union is None else union.unionAll(one)
    fused = union.groupBy("case_id", "entity").agg(F.round(F.sum("s") / len(rankings), 9).alias("score"))
    return ranked(fused, ["case_id"], [F.desc("score"), F.asc("entity")])


def tiebreak(ranking: DataFrame, elevation: DataFrame) -> DataFrame:
    """(..., new_rank, tied, moved): exact score ties by trace elevation, all else as before."""
    e = elevation.select("case_id", "entity", F.col("score").alias("_e"))
    joined = ranking.join(e, ["case_id", "entity"], "left").withColumn("e_elev", F.coalesce("_e", F.lit(0.0))).drop("_e")
    joined = joined.withColumn("tied", F.count("*").over(Window.partitionBy("case_id", "score")) > 1)
    out = ranked(joined, ["case_id"], [F.desc("score"), F.desc("e_elev"), F.asc("rank")], "new_rank")
    return out.withColumn("moved", F.col("tied") & (F.col("rank") != F.col("new_rank")))


def margins(ranking: DataFrame) -> DataFrame:
    """(case_id, margin): first score less the second; 1.0 where there is only one."""
    two = ranking.where("rank <= 2").groupBy("case_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("b"))
    return two.select("case_id", F.coalesce(F.col("a") - F.col("b"), F.lit(1.0)).alias("margin"))


def softmax(ranking: DataFrame) -> DataFrame:
    """(case_id, entity, probability), shifted by the largest score."""
    w = Window.partitionBy("case_id")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return ranking.withColumn("_e", e).select("case_id", "entity", (F.col("_e") / F.sum("_e").over(w)).alias("probability"))


def hash_order(universe: DataFrame, seed: str = "") -> DataFrame:
    """The random baseline: names ordered by a hash with the case, scores evenly spread."""
    w = Window.partitionBy("case_id")
    r = ranked(universe.select("case_id", "entity").distinct(), ["case_id"], [F.sha2(F.concat(F.lit(seed), "case_id", F.lit("|"), "entity"), 256), F.col("entity")])
    n = F.count("*").over(w)
    return r.withColumn("score", F.round((n - F.col("rank") + 1) / n, 9))


def coverage_rank(baseline: DataFrame, coverage: DataFrame) -> DataFrame:
    """Rank by propagation coverage, then the baseline's score, then its order."""
    c = coverage.select("case_id", "entity", "coverage")
    joined = baseline.join(c, ["case_id", "entity"], "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))
    return ranked(joined, ["case_id"], [F.desc("coverage"), F.desc("score"), F.asc("rank")], "new_rank")


def alerts(metrics: DataFrame, spans: DataFrame, logs: DataFrame, universe: DataFrame, onset: int, end: int, error: str) -> DataFrame:
    """(case_id, entity, score, rank): number of alerts of every entity of the universe, most first, then by name.

    One for each metric that goes above its mean by three deviations of the time before the onset at any step of the incident; one if the 95th
    percentile of its spans is three times what it was; one for each log line of the incident that tells of an error.
    metrics has case_id, entity, metric, ts, value; spans case_id, service, start_us, duration_us; logs case_id, container, timestamp, message.
    """
    inc = (F.col("ts") >= onset) & (F.col("ts") <= end)
    before, during = F.when(F.col("ts") < onset, F.col("value")), F.when(inc, F.col("value"))
    per = metrics.groupBy("case_id", "entity", "metric").agg(F.avg(before).alias("mu"), F.stddev_pop(before).alias("sd"), F.max(during).alias("top"))
    hot = per.where(F.col("top") > F.col("mu") + 3 * F.greatest(F.col("sd"), F.lit(1e-6))).groupBy("case_id", "entity").agg(F.count("*").alias("n"))
    t = F.col("start_us") / 1e6
    d = F.col("duration_us").cast("double")
    p95 = spans.groupBy("case_id", F.col("service").alias("entity")).agg(F.percentile(F.when(t < onset, d), 0.95).alias("a"), F.percentile(F.when((t >= onset) & (t <= end), d), 0.95).alias("b"))
    slow = p95.where((F.col("b") > 0) & (F.col("b") >= 3 * F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(1e-3)))).select("case_id", "entity", F.lit(1).cast("bigint").alias("n"))
    said = logs.where((F.col("timestamp") >= onset) & (F.col("timestamp") <= end) & F.col("message").rlike(error)).groupBy("case_id", F.col("container").alias("entity")).agg(F.count("*").alias("n"))
    total = hot.unionByName(slow).unionByName(said).groupBy("case_id", "entity").agg(F.sum("n").cast("double").alias("score"))
    return by_score(universe, total, "score")


def rerank_head(ranking: DataFrame, relief: DataFrame, k: int = 5) -> DataFrame:
    """(case_id, entity, rank, new_rank): the first k by relief, then as before; all others keep their order behind them.

    An entity of the head without relief counts as 0.
    """
    r = relief.select("case_id", "entity", F.col("relief").alias("_r"))
    j = ranking.join(r, ["case_id", "entity"], "left").withColumn("_head", F.col("rank") <= k)
    order = [F.desc("_head"), F.desc(F.when(F.col("_head"), F.coalesce("_r", F.lit(0.0)))), F.asc("rank"), F.asc("entity")]
    return ranked(j, ["case_id"], order, "new_rank").select("case_id", "entity", "rank", "new_rank")


#: What a query of each kind costs.
COSTS = {"metrics": 1, "traces": 3, "logs": 2, "neighbours": 1, "health": 1, "change": 2}


def next_query(candidates: DataFrame, spent: DataFrame, budget: int) -> DataFrame:
    """(case_id, service, tool, priority, cost): the query of highest priority that is still affordable and not yet asked.

    Ties: the dearer first, then by service and tool.  ``spent`` has case_id, service and tool of the queries asked.
    """
    cost = F.create_map(*[x for k, v in COSTS.items() for x in (F.lit(k), F.lit(v))])
    paid = spent.groupBy("case_id").agg(F.sum(F.try_element_at(cost, F.col("tool"))).alias("_paid"))
    open_ = candidates.join(spent.select("case_id", "service", "tool").distinct(), ["case_id", "service", "tool"], "left_anti")
    can = open_.withColumn("cost", F.try_element_at(cost, F.col("tool"))).join(paid, "case_id", "left").where(F.col("cost") <= budget - F.coalesce("_paid", F.lit(0)))
    return ranked(can, ["case_id"], [F.desc("priority"), F.desc("cost"), F.asc("service"), F.asc("tool")], "_r").where("_r = 1").select("case_id", "service", "tool", "priority", "cost")
