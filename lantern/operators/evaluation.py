"""Evaluation: detection outcomes, ranking metrics, headroom, and clustered resampling statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.blocks import running


def detection_outcome(points: DataFrame, alarms: DataFrame, inject: int) -> DataFrame:
    """Per case: false-alarm rate before, density after, first alarm on each side, latency and outcome."""
    step = points.groupBy("case_id", "ts").agg(F.max(F.col("status").isin("normal", "anomaly")).alias("evaluated")).join(alarms.select("case_id", "ts", "alarm"), ["case_id", "ts"])
    pre, ok, hit = F.col("ts") < inject, F.col("evaluated"), F.col("evaluated") & F.col("alarm")
    out = step.groupBy("case_id").agg(
        F.count_if(pre & ok).alias("pre_steps"), F.count_if(pre & ~ok).alias("pre_missing"), F.count_if(pre & hit).alias("pre_alarms"), F.min(F.when(pre & hit, F.col("ts"))).alias("first_pre_alarm_ts"),
        F.count_if(~pre & ok).alias("post_steps"), F.count_if(~pre & hit).alias("post_alarms"), F.min(F.when(~pre & hit, F.col("ts"))).alias("t_detect"),
    )
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 9)
    outcome = F.when(F.col("t_detect").isNotNull(), F.when(F.col("first_pre_alarm_ts").isNull(), "clean_detection").otherwise("noisy_detection")).when(F.col("first_pre_alarm_ts").isNotNull(), "early_alarm_only").otherwise("complete_miss")
    return out.select("case_id", "first_pre_alarm_ts", "t_detect", (F.col("t_detect") - inject).alias("latency_s"), rate("pre_alarms", "pre_steps").alias("far"), rate("post_alarms", "post_steps").alias("density"), "pre_steps", "pre_missing", outcome.alias("outcome"))


def top_metrics(summary: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.desc(F.coalesce("peak_score", F.lit(0.0))), F.desc("anomaly"), F.asc("metric"))
    return summary.withColumn("place", F.row_number().over(w)).where((F.col("place") <= n) & ((F.col("peak_score") > 0) | (F.col("anomaly") > 0))).select("case_id", "metric", "place")


def rollup(results: DataFrame, by: Sequence[str], measures: dict) -> DataFrame:
    """Overall and by each of ``by`` alone, in one pass: grouping sets; an unknown group is 'unknown'."""
    filled = results.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by], *[c for c in results.columns if c not in by])
    sets = [[], *[[F.col(c)] for c in by]]
    level = F.lit("overall")
    for c in by:
        level = F.when(F.grouping(c) == 0, F.lit(c)).otherwise(level)
    out = filled.groupingSets(sets, *[F.col(c) for c in by]).agg(level.alias("level"), *[v.alias(k) for k, v in measures.items()])
    return out.select("level", F.coalesce(*[F.col(c) for c in by], F.lit("all")).alias("value"), *measures)


def case_metrics(rankings: DataFrame, truth: DataFrame, keys: Sequence[str] = ("case_id", "method")) -> DataFrame:
    """(keys, first, top_1, top_3, top_5, reciprocal_rank): first place of a true root cause; none counts 0.

    rankings has entity and rank; truth has case_id and entity.  Every case of the truth appears for every method that ranks it.
    """
    t = truth.select("case_id", "entity").distinct().withColumn("_t", F.lit(1))
    first = rankings.join(t, ["case_id", "entity"], "left").groupBy(*keys).agg(F.min(F.when(F.col("_t") == 1, F.col("rank"))).alias("first"))
    known = first.join(truth.select("case_id").distinct(), "case_id", "left_semi")
    top = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"top_{k}")
    return known.select(*keys, "first", *[top(k) for k in (1, 2, 3, 4, 5)], F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def method_aggregate(metrics: DataFrame, by: str = "method") -> DataFrame:
    """AC@1..5, Avg@3 and Avg@5, MRR and the share of cases without the root cause."""
    avg = lambda c: F.round(F.avg(c), 9)
    at = lambda n: sum((F.col(f"top_{k}") for k in range(2, n + 1)), F.col("top_1")) / n
    return metrics.groupBy(by).agg(F.count("*").alias("cases"), *[avg(f"top_{k}").alias(f"ac_{k}") for k in (1, 2, 3, 4, 5)], avg(at(3)).alias("avg_3"), avg(at(5)).alias("avg_5"), avg("reciprocal_rank").alias("mrr"), F.round(F.avg(F.col("first").isNull().cast("int")), 9).alias("missing_rate"))


def headroom(metrics: DataFrame, fault: str) -> DataFrame:
    """(level, mrr): what the best single method, the best per fault and the best per case would reach; ties go to the first name."""
    m = metrics.groupBy("method").agg(F.avg("reciprocal_rank").alias("m"))
    fixed = m.agg(F.round(F.max("m"), 9).alias("mrr")).select(F.lit("best_fixed").alias("level"), "mrr")
    per = metrics.groupBy(fault, "method").agg(F.sum("reciprocal_rank").alias("s"), F.count("*").alias("n")).groupBy(fault).agg(F.max_by(F.struct("s", "n"), F.col("s") / F.col("n")).alias("b"))
    per_fault = per.agg(F.round(F.sum("b.s") / F.sum("b.n"), 9).alias("mrr")).select(F.lit("best_per_fault").alias("level"), "mrr")
    case = metrics.groupBy("case_id").agg(F.max("reciprocal_rank").alias("r")).agg(F.round(F.avg("r"), 9).alias("mrr")).select(F.lit("best_per_case").alias("level"), "mrr")
    return fixed.unionAll(per_fault).unionAll(case)


def pairs(metrics: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(case_id, a, b): the same cases under two methods; a case that one of them lacks, or has twice, is an error when read."""
    one = metrics.where(F.col("method").isin(a, b)).groupBy("case_id").agg(*[F.max(F.when(F.col("method") == m, F.col(value))).alias(n) for m, n in ((a, "a"), (b, "b"))], F.count_if(F.col("method") == a).alias("_x"), F.count_if(F.col("method") == b).alias("_y"))
    ok = (F.col("_x") == 1) & (F.col("_y") == 1)
    return one.select("case_id", F.when(ok, F.col("a")).otherwise(F.raise_error(F.concat(F.lit("not paired: "), "case_id"))).alias("a"), "b")


def contingency(paired: DataFrame) -> DataFrame:
    """n11, n10, n01, n00 of two yes-or-no measures, and the geometric mean of (1 + a) / (1 + b)."""
    n = lambda x, y: F.count_if(((F.col("a") >= 1) == F.lit(x)) & ((F.col("b") >= 1) == F.lit(y)))
    return paired.agg(n(True, True).alias("n11"), n(True, False).alias("n10"), n(False, True).alias("n01"), n(False, False).alias("n00"), F.round(F.exp(F.avg(F.log1p("a") - F.log1p("b"))), 9).alias("geometric_ratio"))


def geometric_ratio(paired: DataFrame) -> DataFrame:
    """(n, mean_log, ratio): the geometric mean of a / b, over the pairs where both are above 0 (run times, for example)."""
    log = F.avg(F.log("a") - F.log("b"))
    return paired.where("a > 0 and b > 0").agg(F.count("*").alias("n"), F.round(log, 9).alias("mean_log"), F.round(F.exp(log), 9).alias("ratio"))


def family_consistency(paired: DataFrame, family: DataFrame) -> DataFrame:
    """(outcome, families): families whose mean got better, worse or stayed."""
    f = paired.join(family, "case_id").groupBy("family").agg(F.round(F.avg(F.col("a") - F.col("b")), 12).alias("d"))
    return f.groupBy(F.when(F.col("d") > 0, "improved").when(F.col("d") < 0, "degraded").otherwise("tied").alias("outcome")).agg(F.count("*").alias("families"))


def spread(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Linear quartiles, range between them, and the ceiling-rank 95th percentile."""
    q = F.percentile(value, [0.25, 0.5, 0.75])
    return df.groupBy(*by).agg(F.count(value).alias("n"), q.alias("_q"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95")).select(*by, "n", *[F.round(F.get("_q", F.lit(i)), 9).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.round(F.get("_q", F.lit(2)) - F.get("_q", F.lit(0)), 9).alias("iqr"), "p95")


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """Holm's step-down: the running maximum of p * (m - i) from the smallest p, at most 1.  A family of tests is small by nature."""
    w = Window.orderBy(F.asc(p), F.asc("name"))
    m = F.count("*").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    step = tests.withColumn("_i", F.row_number().over(w)).withColumn("_m", m)
    adj = F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_i") + 1))
    return step.withColumn("_a", adj).withColumn("p_holm", F.round(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)), 12)).drop("_i", "_m", "_a")


def randomization_test(paired: DataFrame, family: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(difference, p_value): sign flips of whole families, signs drawn from a hash of the family.

    Families are summed first.  A partition adds up a vector with one number per replicate, so what leaves it has
    ``replicates`` rows however many families it holds, and the signs don't depend on the partitioning.
    """
    f = paired.join(family, "case_id").groupBy("family").agg(F.sum(F.col("a") - F.col("b")).alias("s"), F.count("*").alias("n"))
    drawn = f.select(F.xxhash64(F.lit(seed), "family").alias("h"), F.col("s").cast("double").alias("s"))

    def flip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(replicates)
        for b in batches:
            for h, s in zip(b.column("h").to_pylist(), b.column("s").to_numpy(zero_copy_only=False), strict=True):
                signs = np.unpackbits(np.frombuffer(np.random.Generator(np.random.Philox(key=h % 2**64)).bytes(-(-replicates // 8)), np.uint8))[:replicates]
                total += np.where(signs == 1, s, -s)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(total)], ["r", "t"])

    seen = f.agg((F.sum("s") / F.sum("n")).alias("difference"), F.sum("n").alias("_n"))
    sums = drawn.mapInArrow(flip, "r bigint, t double").groupBy("r").agg(F.sum("t").alias("t"))
    j = sums.join(F.broadcast(seen))
    hit = F.abs(F.col("t") / F.col("_n")) >= F.abs("difference") - 1e-12
    return j.groupBy("difference").agg(((1 + F.count_if(hit)) / (replicates + 1)).alias("p_value"))


def cluster_bootstrap(paired: DataFrame, family: DataFrame, level: float = 0.95, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """(difference, low, high): families drawn with replacement, as ratio of sums, percentile interval.

    A draw is a hashed index into the families, which are numbered by name; the join on that index is an equi join.
    """
    f = paired.join(family, "case_id").groupBy("family").agg(F.sum(F.col("a") - F.col("b")).alias("s"), F.count("*").alias("n"))
    numbered = f.withColumn("i", F.row_number().over(Window.orderBy("family")) - 1)
    k = numbered.count()
    spark = paired.sparkSession
    draws = spark.range(replicates).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0)))).alias("j")).select("r", F.pmod(F.xxhash64(F.lit(seed), "r", "j"), F.lit(max(k, 1))).cast("int").alias("i"))
    # The draws look small to the planner before they are exploded; three numbers a family are broadcast instead.
    means = draws.join(F.broadcast(numbered.select("i", "s", "n")), "i").groupBy("r").agg((F.sum("s") / F.sum("n")).alias("d"))
    q = means.agg(F.percentile("d", [(1 - level) / 2, (1 + level) / 2]).alias("q"))
    return f.agg((F.sum("s") / F.sum("n")).alias("difference")).join(F.broadcast(q)).select("difference", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def pairwise_examples(candidates: DataFrame, truth: DataFrame, features: Sequence[str]) -> DataFrame:
    """(case_id, entity, label, features): root less other, label 1, and its mirror image, label 0."""
    t = truth.select("case_id", "entity").distinct()
    root = candidates.join(t, ["case_id", "entity"], "left_semi").select("case_id", *[F.col(f).alias(f"_r_{f}") for f in features])
    other = candidates.join(t, ["case_id", "entity"], "left_anti")
    j = other.join(root, "case_id")
    both = F.array(F.struct(F.lit(1).alias("label"), *[(F.col(f"_r_{f}") - F.col(f)).alias(f) for f in features]), F.struct(F.lit(0).alias("label"), *[(F.col(f) - F.col(f"_r_{f}")).alias(f) for f in features]))
    return j.select("case_id", "entity", F.explode(both).alias("x")).select("case_id", "entity", "x.*")


def fit_pairwise(examples: DataFrame, features: Sequence[str], c: float = 1.0) -> dict[str, float]:
    """Weights of a logistic model without intercept on the mirrored differences, fitted by the distributed solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(examples.select(F.col("label").cast("double").alias("label"), *[F.col(f).cast("double") for f in features]))
    n = max(1, data.count())
    fitted = LogisticRegression(featuresCol="_x", labelCol="label", fitIntercept=False, standardization=False, regParam=1 / (c * n), maxIter=200).fit(data)
    return dict(zip(features, map(float, fitted.coefficients), strict=True))


def rank_pairwise(candidates: DataFrame, weights: dict[str, float]) -> DataFrame:
    score = sum((F.col(f).cast("double") * w for f, w in weights.items()), F.lit(0.0))
    s = candidates.select("case_id", "entity", F.round(score, 9).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), F.asc("entity"))))


def folds(cases: DataFrame, family: str, k: int = 3) -> DataFrame:
    """The fold of each case: its family's number modulo k.  Families are numbered over many tasks."""
    n = running(cases.select(F.col(family).alias("_f")).distinct().withColumn("_g", F.lit(0)), ["_g"], [F.col("_f").asc_nulls_first()])
    return cases.join(n.select("_f", ((F.col("_pos") - 1) % k).cast("int").alias("fold")), F.col(family).eqNullSafe(F.col("_f"))).drop("_f")


def outcome_rates(results: DataFrame, by: str = "method") -> DataFrame:
    """Per method: cases, abstention, false remediation, recovery, regression, hits per query and mean runtime.

    results has status, abstained, authorized, top_1, recovered, regressed, queries and runtime.  A rate without a denominator is null,
    not 0: remediation is judged over authorised cases only, efficiency over the queries asked, runtime over the cases that succeeded.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok, auth = F.col("status") == "SUCCESS", yes("authorized")
    rate = lambda hit, of: F.round(F.try_divide(F.count_if(hit).cast("double"), of), 9)
    n_auth = F.count_if(auth)
    asked = F.sum(F.coalesce("queries", F.lit(0)))
    return results.groupBy(by).agg(
        F.count("*").alias("cases"),
        F.count_if(ok).alias("evaluated"),
        rate(~ok | yes("abstained"), F.count("*")).alias("abstention_rate"),
        rate(auth & (F.coalesce("top_1", F.lit(0)) == 0), n_auth).alias("false_remediation_rate"),
        rate(auth & yes("recovered"), n_auth).alias("recovery_rate"),
        rate(auth & yes("regressed"), n_auth).alias("regression_rate"),
        F.round(F.try_divide(F.count_if(ok & (F.col("top_1") == 1)).cast("double"), asked), 9).alias("query_efficiency"),
        F.round(F.avg(F.when(ok, F.col("runtime"))), 9).alias("mean_runtime"),
    )


def availability(selected: DataFrame, index: DataFrame) -> DataFrame:
    """One row: how many of the selected cases have metrics, logs, traces, and all three, and how many lack each.

    index has case_id, n_metrics, has_logs, n_logs, has_traces, n_traces; a case that isn't in it has nothing.
    """
    own = index.groupBy(F.col("case_id").alias("_c")).agg(F.max("n_metrics").alias("m"), F.max(F.coalesce("has_logs", F.lit(False)) | (F.coalesce("n_logs", F.lit(0)) > 0)).alias("l"), F.max(F.coalesce("has_traces", F.lit(False)) | (F.coalesce("n_traces", F.lit(0)) > 0)).alias("t"))
    j = selected.select("case_id").distinct().join(own, F.col("case_id") == F.col("_c"), "left")
    m, lo, t = F.coalesce(F.col("m") > 0, F.lit(False)), F.coalesce("l", F.lit(False)), F.coalesce("t", F.lit(False))
    n = F.count("*")
    return j.agg(n.alias("cases"), F.count_if(m).alias("metrics"), F.count_if(lo).alias("logs"), F.count_if(t).alias("traces"), F.count_if(m & lo & t).alias("all_three"), (n - F.count_if(m)).alias("no_metrics"), (n - F.count_if(lo)).alias("no_logs"), (n - F.count_if(t)).alias("no_traces"))


def compare(paired: DataFrame, family: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """One row with the whole paired comparison: difference, p-value, interval, sizes, spread of both sides and the table of successes."""
    sizes = paired.join(family, "case_id").groupBy("family").agg(F.count("*").alias("n")).agg(F.sum("n").alias("executions"), F.count("*").alias("families"), F.min("n").alias("least_repetitions"), F.max("n").alias("most_repetitions"), F.round(F.avg("n"), 4).alias("mean_repetitions"))
    side = lambda c: spread(paired, c).select(*[F.col(x).alias(f"{c}_{x}") for x in ("q1", "median", "q3", "iqr")])
    won = lambda x, y: F.count_if(((F.col("a") >= 0.5) == F.lit(x)) & ((F.col("b") >= 0.5) == F.lit(y)))
    table = paired.agg(F.round(F.avg("a"), 6).alias("a_mean"), F.round(F.avg("b"), 6).alias("b_mean"), won(True, False).alias("n10"), won(False, True).alias("n01"), won(True, True).alias("n11"), won(False, False).alias("n00"))
    out = randomization_test(paired, family, replicates, seed).join(cluster_bootstrap(paired, family, replicates=replicates, seed=seed).select("low", "high"))
    for one in (sizes, side("a"), side("b"), table):  # every part is one row
        out = out.join(one)
    return out


def leak_free_split(cases: DataFrame, family: Sequence[str], dev: float = 0.5, val: float = 0.25, seed: int = 42) -> DataFrame:
    """(case_id, partition): families in a seeded order; the first share of them is dev, the next val, the rest held_out.

    A family is never split.  A case that occurs twice is an error when read.  Families are numbered over many tasks, since they grow with the cases.
    """
    if dev < 0 or val < 0 or dev + val > 1:
        raise ValueError("the shares of dev and val are 0 at least and 1 together at most")
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in family])
    each = cases.groupBy("case_id").agg(F.count("*").alias("_n"), F.min(name).alias("_f"))
    each = each.select(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("listed twice: "), F.col("case_id"))).cast("string")).otherwise(F.col("case_id")).alias("case_id"), "_f")
    fams = each.select("_f").distinct().withColumn("_g", F.lit(0)).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "_f")))
    placed = running(fams, ["_g"], [F.col("_h"), F.col("_f")]).select(F.col("_f").alias("_k"), "_pos")
    n = placed.agg(F.count("*").alias("_all"))
    part = F.when(F.col("_pos") <= F.bround(F.col("_all") * dev), "dev").when(F.col("_pos") <= F.bround(F.col("_all") * dev) + F.bround(F.col("_all") * val), "val").otherwise("held_out")
    named = placed.join(F.broadcast(n)).select("_k", part.alias("partition"))
    return each.join(named, F.col("_f") == F.col("_k")).select("case_id", "partition")


def floor_percentile(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    """(by, n, value): the element at the 0-based place floor(q * n) of the sorted values, the last one at most; nulls don't count.

    Values are numbered by ranges, so a group of any size is spread over tasks.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    n = rows.groupBy(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]).agg(F.count("*").alias("n"))
    placed = running(rows, by, [F.col("_v")])
    on = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    return placed.join(n, on).where(F.col("_pos") == F.least(F.floor(F.col("n") * q) + 1, F.col("n"))).select(*by, "n", F.col("_v").alias(value))


def first_of_stratum(queries: DataFrame, stratum: str, per_stratum: int = 2) -> DataFrame:
    """(query, stratum): the first queries of every stratum; a null stratum is 'unknown'.  That limit is the feature."""
    named = queries.select("query", F.coalesce(F.col(stratum), F.lit("unknown")).alias(stratum)).distinct()
    return named.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("query"))).where(F.col("_r") <= per_stratum).drop("_r")


def annotation_sample(queries: DataFrame, ranking: DataFrame, stratum: str, per_stratum: int = 2, top: int = 3) -> DataFrame:
    """(query, stratum, rank, doc): the queries of :func:`first_of_stratum` with their top documents; the ranking need have no others."""
    first = first_of_stratum(queries, stratum, per_stratum)
    return first.join(ranking.where(F.col("rank") <= top).select("query", "rank", "doc"), "query").select("query", stratum, "rank", "doc")


def graded(annotations: DataFrame, query_names: DataFrame, doc_names: DataFrame) -> DataFrame:
    """(query, doc, grade): annotations under the corpus' own names, the highest grade where one document was annotated under several.

    annotations has pool_query, pool_doc, grade; the two others translate pool_query to query and pool_doc to doc.  Names that aren't
    known are left out, and so are queries without any relevant document.
    """
    named = annotations.join(query_names, "pool_query").join(doc_names, "pool_doc")
    best = named.groupBy("query", "doc").agg(F.max("grade").alias("grade"))
    relevant = best.where("grade > 0").select("query").distinct()
    return best.join(relevant, "query", "left_semi")


def leaked(cases: DataFrame, family: str, partition: str) -> DataFrame:
    """(family, partitions, cases): families that lie in more than one partition, so what is tuned on one is known in the other.

    A null family or partition leaks nothing.  The sets combine on the map side.
    """
    there = cases.where(F.col(family).isNotNull() & F.col(partition).isNotNull())
    g = there.groupBy(F.col(family).alias("family")).agg(F.sort_array(F.collect_set(partition)).alias("partitions"), F.count("*").alias("cases"))
    return g.where(F.size("partitions") > 1)
