"""Service graphs: reachability, propagation, and confirmation of episodes by their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.lineage import cut


def metric_name(c: Column) -> tuple[Column, Column]:
    """(entity, signal), split at the first underscore; an empty part is an error."""
    entity = F.substring_index(c, "_", 1)
    signal = F.regexp_extract(c, r"^[^_]*_(.*)$", 1)
    bad = F.raise_error(F.concat(F.lit("not <entity>_<signal>: "), c))
    return F.when((entity == "") | (signal == ""), bad).otherwise(entity), signal


def reach(edges: DataFrame) -> DataFrame:
    """(case_id, src, dst): all pairs with a directed path, by semi-naive iteration; cycles end it when nothing is new.

    The closure itself is the result, so its size is what is asked for; every round joins only the pairs that are new.
    """
    e = cut(edges.select("case_id", "src", "dst").where("src <> dst").distinct())
    known, fresh = e, e
    step = e.select(F.col("case_id").alias("_c"), F.col("src").alias("_m"), F.col("dst").alias("_d"))
    while True:  # the closure is finite, so a round without new pairs always comes
        nxt = fresh.join(step, (F.col("case_id") == F.col("_c")) & (F.col("dst") == F.col("_m"))).select("case_id", "src", F.col("_d").alias("dst")).where("src <> dst").distinct()
        fresh = cut(nxt.join(known, ["case_id", "src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = cut(known.unionAll(fresh))


def within(edges: DataFrame, hops: int) -> DataFrame:
    """(case_id, src, dst, hops): the shortest way of at most that many hops, in either direction."""
    both = edges.select("case_id", "src", "dst").unionAll(edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    step = both.select(F.col("case_id").alias("_c"), F.col("src").alias("_m"), F.col("dst").alias("_d"))
    known = cut(both.withColumn("hops", F.lit(1)))
    fresh = known
    for h in range(2, hops + 1):
        nxt = fresh.join(step, (F.col("case_id") == F.col("_c")) & (F.col("dst") == F.col("_m"))).select("case_id", "src", F.col("_d").alias("dst")).where("src <> dst").distinct()
        fresh = cut(nxt.join(known, ["case_id", "src", "dst"], "left_anti").withColumn("hops", F.lit(h)))
        if fresh.isEmpty():
            break
        known = cut(known.unionAll(fresh))
    return known


def propagation_coverage(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """(case_id, entity, coverage): number of anomalous entities that can be reached along edges of rising onset.

    Edges count in either direction between anomalous entities and run from the earlier onset to the later, so they can't form a cycle.
    """
    hot = evidence.where("has_episode").select("case_id", "entity", "first_ts")
    a = hot.select(F.col("case_id").alias("_c1"), F.col("entity").alias("_e1"), F.col("first_ts").alias("_t1"))
    b = hot.select(F.col("case_id").alias("_c2"), F.col("entity").alias("_e2"), F.col("first_ts").alias("_t2"))
    near = edges.select("case_id", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct()
    j = near.join(a, (F.col("case_id") == F.col("_c1")) & (F.col("u") == F.col("_e1"))).join(b, (F.col("case_id") == F.col("_c2")) & (F.col("v") == F.col("_e2"))).where("_t1 <> _t2")
    up = F.col("_t1") < F.col("_t2")
    oriented = j.select("case_id", F.when(up, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("dst"))
    n = reach(oriented).groupBy("case_id", F.col("src").alias("entity")).agg(F.count("*").alias("reached"))
    out = evidence.select("case_id", "entity").join(n, ["case_id", "entity"], "left")
    return out.select("case_id", "entity", F.coalesce("reached", F.lit(0)).cast("bigint").alias("coverage"))


def confirm(episodes: DataFrame, edges: DataFrame, candidates: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, candidate_ts, confirmed_ts, confirmed): a candidate onset is confirmed by an episode with a later neighbour.

    An episode qualifies that starts at or after the candidate, or runs then; the earliest strictly later episode of a neighbour
    in the graph confirms it, not before the candidate's own step.
    """
    both = edges.select("case_id", "src", "dst").unionAll(edges.select("case_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    i = episodes.select("case_id", F.col("entity").alias("ei"), F.col("start_ts").alias("ti"), F.col("end_ts").alias("tei"))
    j = episodes.select(F.col("case_id").alias("_c"), F.col("entity").alias("ej"), F.col("start_ts").alias("tj"))
    pairs = i.join(both, (i["case_id"] == both["case_id"]) & (F.col("ei") == F.col("src"))).select(i["case_id"], "ei", "ti", "tei", "dst")
    pairs = pairs.join(j, (F.col("case_id") == F.col("_c")) & (F.col("dst") == F.col("ej")) & (F.col("tj") > F.col("ti"))).select("case_id", "ti", "tei", "tj")
    step = observed.join(candidates, "case_id").where("ts >= candidate_ts").groupBy("case_id", "candidate_ts").agg(F.min("ts").alias("step_ts"))
    hit = candidates.join(pairs, "case_id").where("ti >= candidate_ts or (ti <= candidate_ts and candidate_ts <= tei)").groupBy("case_id", "candidate_ts").agg(F.min("tj").alias("tj"))
    out = candidates.join(step, ["case_id", "candidate_ts"], "left").join(hit, ["case_id", "candidate_ts"], "left")
    return out.select("case_id", "candidate_ts", F.when(F.col("tj").isNotNull(), F.greatest("step_ts", "tj")).alias("confirmed_ts"), F.col("tj").isNotNull().alias("confirmed"))


def visible_at(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """(case_id, ts, edges): number of edges that can be seen at each step: a running count over first sightings, no range join."""
    marks = edges.select("case_id", F.col("first_visible_us").alias("t"), F.lit(1).alias("n"), F.lit(None).cast("bigint").alias("ts"))
    asks = steps.select("case_id", (F.col("ts") * 1_000_000).alias("t"), F.lit(0).alias("n"), "ts")
    w = Window.partitionBy("case_id").orderBy("t", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("edges", F.sum("n").over(w)).where("ts is not null").select("case_id", "ts", "edges")


def incident_window(truth: DataFrame, detected: DataFrame, mode: str, onset: int | None = None, end: int | None = None) -> DataFrame:
    """(case_id, onset_ts, end_ts, mode, available): oracle, detected or custom; a case without detection never falls back to the truth."""
    if mode == "oracle":
        return truth.select("case_id", F.col("inject_ts").alias("onset_ts"), F.col("last_ts").alias("end_ts"), F.lit(mode).alias("mode"), F.col("inject_ts").isNotNull().alias("available"))
    if mode == "detected":
        first = detected.groupBy("case_id").agg(F.min("first_ts").alias("onset_ts"))
        return truth.select("case_id", "last_ts").join(first, "case_id", "left").select("case_id", "onset_ts", F.when(F.col("onset_ts").isNotNull(), F.col("last_ts")).alias("end_ts"), F.lit(mode).alias("mode"), F.col("onset_ts").isNotNull().alias("available"))
    if mode == "custom" and onset is not None:
        return truth.select("case_id", F.lit(onset).cast("bigint").alias("onset_ts"), F.coalesce(F.lit(end).cast("bigint"), F.col("last_ts")).alias("end_ts"), F.lit(mode).alias("mode"), F.lit(True).alias("available"))
    raise ValueError("mode is oracle, detected, or custom with an onset")
