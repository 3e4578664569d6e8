"""Span trees: edges, interval algebra, latency distributions and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_spans(spans: DataFrame, key: Sequence[str], content: Sequence[str]) -> DataFrame:
    """One row per span: identical copies are one, conflicting ones an error when the result is read."""
    one = spans.groupBy(*key).agg(F.min(F.struct(*content)).alias("_a"), F.max(F.struct(*content)).alias("_b"))
    same = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.raise_error(F.lit("spans of one id that conflict")))
    return one.withColumn("_s", same).select(*key, "_s.*")


def completed(spans: DataFrame, cutoff_us: int) -> DataFrame:
    """Spans that have ended at the cutoff."""
    return spans.where(F.col("start_us") + F.col("duration_us") <= cutoff_us)


def relations(spans: DataFrame) -> DataFrame:
    """One row per call: child joined to its parent, both services known and different."""
    c = spans.select("case_id", "span_id", "parent_span_id", F.col("service").alias("dst"), F.col("start_us").alias("c_start"), F.col("duration_us").alias("c_raw"))
    p = spans.select(F.col("case_id").alias("_case"), F.col("span_id").alias("_id"), F.col("service").alias("src"), F.col("start_us").alias("p_start"), F.col("duration_us").alias("p_raw"))
    j = c.where("parent_span_id is not null").join(p, (F.col("case_id") == F.col("_case")) & (F.col("parent_span_id") == F.col("_id"))).where("src <> dst and src <> '' and dst <> ''")
    p_dur, c_dur = F.greatest("p_raw", F.lit(0)), F.greatest("c_raw", F.lit(0))
    return j.select(
        "case_id", "src", "dst", F.col("_id").alias("caller_span_id"), "span_id", p_dur.alias("caller_duration"), c_dur.alias("callee_duration"),
        (F.col("c_start") - F.col("p_start")).alias("start_lag"), (F.col("p_start") + F.col("p_raw") - F.col("c_start") - F.col("c_raw")).alias("return_lag"),
        F.when(p_dur > 0, c_dur / p_dur).otherwise(0.0).alias("fraction"), F.greatest(F.col("p_start") + F.col("p_raw"), F.col("c_start") + F.col("c_raw")).alias("visible_us"),
    )


def edges(calls: DataFrame) -> DataFrame:
    """(case_id, src, dst, n, first_visible_us): an edge can be seen once both ends of a call are complete."""
    return calls.groupBy("case_id", "src", "dst").agg(F.count("*").alias("n"), F.min("visible_us").alias("first_visible_us"))


def interval_union(intervals: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): maximal intervals; touching ones merge, empty ones don't count."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    there = intervals.where(F.col(end) > F.col(start))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = there.withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    island = marked.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def decompose(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(span_id, duration, children, covered, self_time, covered_fraction, self_fraction, overlap) of every parent.

    Children are clipped to the parent; overlap is judged on the children as they are.
    """
    c = children.select(F.col("parent_span_id").alias("_p"), F.col("start").alias("c0"), (F.col("start") + F.greatest("duration", F.lit(0))).alias("c1"))
    p = parents.select("span_id", F.col("start").alias("p0"), F.greatest("duration", F.lit(0)).alias("duration"))
    j = p.join(c, F.col("span_id") == F.col("_p"))
    raw = Window.partitionBy("span_id").orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1)
    flagged = j.withColumn("_lap", (F.col("c1") > F.col("c0")) & (F.col("c0") < F.max(F.when(F.col("c1") > F.col("c0"), F.col("c1"))).over(raw)))
    seen = flagged.groupBy("span_id").agg(F.count("*").alias("children"), F.coalesce(F.max("_lap"), F.lit(False)).alias("overlap"))
    clipped = j.select("span_id", F.greatest("c0", "p0").alias("start"), F.least("c1", F.col("p0") + F.col("duration")).alias("end"))
    cover = interval_union(clipped, ["span_id"]).groupBy("span_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    out = p.join(seen, "span_id", "left").join(cover, "span_id", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    fraction = lambda x: F.when(F.col("duration") > 0, F.round(x / F.col("duration"), 9)).otherwise(0.0)
    own = F.col("duration") - F.col("covered")
    return out.select("span_id", "duration", F.coalesce("children", F.lit(0)).alias("children"), "covered", own.alias("self_time"), fraction(F.col("covered")).alias("covered_fraction"), fraction(own).alias("self_fraction"), F.coalesce("overlap", F.lit(False)).alias("overlap"))


def nearest_rank(sorted_values: Column, n: Column, p: float) -> Column:
    """The value at the index p * (n - 1), rounded half to even."""
    return F.get(sorted_values, F.bround((n - 1) * F.lit(p)).cast("int"))


def distribution(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = (0.1, 0.5, 0.9, 0.99), prefix: str = "") -> DataFrame:
    """(keys, n, min, p.., max, mean) with nearest-rank percentiles.

    Equal values are counted first and the ranks found on running counts, so a group is never one array: what a task
    holds is bounded by the distinct values of a group, and they stream through a window.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    run = counted.withColumn("_to", F.sum("_c").over(w.orderBy("_v"))).withColumn("_n", F.sum("_c").over(w))

    def at(p: float) -> Column:
        k = F.bround((F.col("_n") - 1) * F.lit(p)).cast("bigint")
        return F.max(F.when((k < F.col("_to")) & (k >= F.col("_to") - F.col("_c")), F.col("_v")))

    named = lambda x: f"{prefix}{x}"
    return run.groupBy(*keys).agg(F.sum("_c").alias(named("n")), F.min("_v").alias(named("min")), *[at(p).alias(named(f"p{p * 100:g}")) for p in percentiles], F.max("_v").alias(named("max")), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias(named("mean")))


def edge_latency(calls: DataFrame, decomposed: DataFrame | None = None) -> DataFrame:
    """Per edge: number of calls, sums, and nearest-rank percentiles of what a call took.

    All measures of a call become rows of one table, so one exchange of counted values serves every percentile.
    """
    keys = ["case_id", "src", "dst"]
    base = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("caller_duration").alias("total_caller"), F.sum("callee_duration").alias("total_callee"))
    wanted = {"caller_duration": ("caller", (0.1, 0.5, 0.9)), "callee_duration": ("callee", (0.5, 0.9)), "return_lag": ("lag", (0.9,)), "fraction": ("fraction", (0.5,))}
    if decomposed is not None:
        calls = calls.join(decomposed.select(F.col("span_id").alias("caller_span_id"), "covered_fraction"), "caller_span_id", "left")
        wanted["covered_fraction"] = ("covered", (0.5,))
    values = F.array(*[F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(wanted)])
    spread = distribution(calls.select(*keys, F.inline(values)), [*keys, "_m"], "_x", (0.1, 0.5, 0.9))
    whole = ("caller_duration", "callee_duration", "return_lag")  # these are integers, and stay it
    picked = []
    for i, (c, (name, ps)) in enumerate(wanted.items()):
        for p in ps:
            x = F.max(F.when(F.col("_m") == i, F.col(f"p{p * 100:g}")))
            picked.append((x.cast("bigint") if c in whole else x).alias(f"{name}_p{p * 100:g}"))
    return base.join(spread.groupBy(*keys).agg(*picked), keys, "left")


def examples(calls: DataFrame, n: int = 5) -> DataFrame:
    """The n calls of every edge whose caller took longest, ties by span id."""
    w = Window.partitionBy("case_id", "src", "dst").orderBy(F.desc("caller_duration"), F.asc("span_id"))
    return calls.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("case_id", "src", "dst", "place", "caller_span_id", "span_id", "caller_duration")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def attribution(latency: DataFrame) -> DataFrame:
    """Per edge: elevation of the tail, share of the caller's waiting, terminal factor, and their product.

    The terminal factor is 1 where the way back takes half the caller's tail or more, or where the callee calls nobody; else 1 less the
    median share of the callee's own time that its calls cover.
    """
    w = Window.partitionBy("case_id", "src")
    p90, p10 = F.col("caller_p90"), F.col("caller_p10")
    elevation = F.when((p90 <= 0) | (p10 >= p90), 0.0).otherwise(clamp((p90 - p10) / p90))
    total = F.sum("total_caller").over(w)
    phi = F.when((total <= 0) | (F.col("total_caller") <= 0), 0.0).otherwise(clamp(F.col("total_caller") / total))
    # Callers have few edges, so the median of their edges' medians is a small aggregate.
    own = latency.groupBy("case_id", "src").agg(F.percentile("covered_p50", 0.5).alias("_cov")).select(F.col("case_id").alias("_c"), F.col("src").alias("_s"), "_cov")
    j = latency.withColumns({"elevation": elevation, "concentration": phi, "siblings": F.count("*").over(w)}).join(own, (F.col("case_id") == F.col("_c")) & (F.col("dst") == F.col("_s")), "left")
    lag = (p90 > 0) & (F.col("lag_p90") >= 0.5 * p90)
    factor = F.when(lag | F.col("_cov").isNull(), 1.0).otherwise(clamp(1 - F.col("_cov")))
    return j.withColumn("terminal", factor).select("case_id", "src", "dst", F.round("elevation", 9).alias("elevation"), F.round("concentration", 9).alias("concentration"), "siblings", F.round("terminal", 9).alias("terminal"), F.coalesce(lag, F.lit(False)).alias("lag_dominant"), F.round(clamp(F.col("elevation") * F.col("concentration") * F.col("terminal")), 9).alias("score"))


def entity_trace(attributed: DataFrame) -> DataFrame:
    """(case_id, entity, score, primary_src): the callee's largest inbound attribution, ties by caller."""
    w = Window.partitionBy("case_id", "dst").orderBy(F.desc("score"), F.asc("src"))
    return attributed.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("case_id", F.col("dst").alias("entity"), "score", F.col("src").alias("primary_src"))


def inbound_elevation(latency: DataFrame) -> DataFrame:
    """(case_id, entity, score): the largest elevation of an edge into the entity."""
    p90, p10 = F.col("caller_p90"), F.col("caller_p10")
    e = F.when((p90 <= 0) | (p10 >= p90), 0.0).otherwise(clamp((p90 - p10) / p90))
    return latency.groupBy("case_id", F.col("dst").alias("entity")).agg(F.round(F.max(e), 9).alias("score"))


def uninstrumented(expected: DataFrame, spans: DataFrame) -> DataFrame:
    """Expected services that no span names."""
    return expected.join(spans.select("case_id", F.col("service").alias("entity")).distinct(), ["case_id", "entity"], "left_anti")


def p95_alerts(spans: DataFrame, onset_us: int, factor: float = 3.0) -> DataFrame:
    """(case_id, service, normal_p95, incident_p95, alert): linear percentiles before and from the onset."""
    d = lambda before: F.percentile(F.when((F.col("start_us") < onset_us) if before else (F.col("start_us") >= onset_us), F.col("duration_us").cast("double")), 0.95)
    out = spans.groupBy("case_id", "service").agg(d(True).alias("normal_p95"), d(False).alias("incident_p95"))
    return out.withColumn("alert", F.coalesce((F.col("normal_p95") > 0) & (F.col("incident_p95") >= factor * F.col("normal_p95")), F.lit(False)))
