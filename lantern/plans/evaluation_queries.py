"""Queries of the evaluation operators, over the rankings, cases and alarms that are there, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.operators import detect, evaluation
from lantern.plans import telemetry_queries as tq
from lantern.sources.tables import table


def label(c: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(""))


def rankings(s: SparkSession, d: str) -> DataFrame:
    """(case_id, method, entity, score, rank) of the latest finite scores."""
    newest = F.max(F.struct("computed_at", "score")).alias("m")
    valid = table(s, d, "ranked_entity", ["case_id", "method", "entity", "score", "computed_at"]).groupBy("case_id", "method", "entity").agg(newest).select("case_id", "method", "entity", "m.score")
    finite = valid.where("score is not null and not isnan(score) and abs(score) < double('infinity')")
    return finite.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "method").orderBy(F.desc("score"), "entity")))


def cases(s: SparkSession, d: str) -> DataFrame:
    """(case_id, entity, suite, system, fault, family, has_service) of the valid row of each case."""
    cols = ["dataset", "system", "fault", "root_cause_service", "suite"]
    m = table(s, d, "manifest_case", ["case_id", "listed_at", *cols]).groupBy("case_id").agg(F.max(F.struct("listed_at", *cols)).alias("m")).select("case_id", "m.*")
    suite = F.coalesce(label(F.col("suite")), label(F.split_part("dataset", F.lit("-"), F.lit(1))))
    out = m.select("case_id", label(F.col("root_cause_service")).alias("entity"), suite.alias("suite"), label(F.col("system")).alias("system"), label(F.col("fault")).alias("fault"))
    return out.withColumn("family", F.concat_ws("|", "suite", "system", F.coalesce("entity", F.lit("")), "fault"))


def metrics(s: SparkSession, d: str) -> DataFrame:
    return evaluation.case_metrics(rankings(s, d), cases(s, d).where("entity is not null"))


def with_fault(s: SparkSession, d: str) -> DataFrame:
    return metrics(s, d).join(cases(s, d).select("case_id", "fault", "suite", "system", "family"), "case_id")


def shared(s: SparkSession, d: str) -> DataFrame:
    """Cases that both compared methods rank."""
    m = metrics(s, d).where("method in ('pairwise', 's_comb')")
    both = m.groupBy("case_id").agg(F.count("*").alias("n")).where("n = 2").select("case_id")
    return m.join(both, "case_id", "left_semi")


def paired(s: SparkSession, d: str, value: str = "reciprocal_rank") -> DataFrame:
    return evaluation.pairs(shared(s, d), "pairwise", "s_comb", value)


def family(s: SparkSession, d: str) -> DataFrame:
    return cases(s, d).select("case_id", "family")


def outcome(s: SparkSession, d: str) -> DataFrame:
    p = tq.points(s, d)
    return evaluation.detection_outcome(p, detect.case_alarms(p, 1, 6), tq.CUTOFF)


def p_values(s: SparkSession, d: str) -> DataFrame:
    """A family of tests to correct: the share of cases that each method ranks worse than 's_comb', as a stand-in p."""
    m = metrics(s, d)
    a = m.where("method = 's_comb'").select("case_id", F.col("reciprocal_rank").alias("x"))
    j = m.where("method <> 's_comb'").join(a, "case_id")
    return j.groupBy(F.col("method").alias("name")).agg(F.round(F.avg((F.col("reciprocal_rank") < F.col("x")).cast("int")) / 10, 9).alias("p"))


FEATURES = ["s_comb_score", "trace_elev_score", "causal_residual_z", "log_anomaly_score"]


def candidates(s: SparkSession, d: str) -> DataFrame:
    """(case_id, entity, features): the valid profiles; what is missing or not finite is 0, and each is squeezed to (-1, 1)."""
    cols = ["case_id", F.coalesce(F.nullif("entity", F.lit("")), F.nullif("service_id", F.lit(""))).alias("entity"), *FEATURES]
    newest = table(s, d, "candidate_evidence_profile").groupBy("profile_id").agg(F.max(F.struct("ingested_at", *cols)).alias("m")).select("m.*")
    clean = lambda f: F.when(F.col(f).isNull() | F.isnan(f) | (F.abs(F.col(f)) == float("inf")), 0.0).otherwise(F.round(F.col(f) / (1 + F.abs(F.col(f))), 9)).alias(f)
    return newest.select("case_id", "entity", *map(clean, FEATURES))


def examples(s: SparkSession, d: str) -> DataFrame:
    return evaluation.pairwise_examples(candidates(s, d), cases(s, d).where("entity is not null"), FEATURES)


def pairwise(s: SparkSession, d: str) -> DataFrame:
    return evaluation.rank_pairwise(candidates(s, d), evaluation.fit_pairwise(examples(s, d), FEATURES))


def rollup(s: SparkSession, d: str) -> DataFrame:
    """Detection outcomes over all cases, by outcome and by case."""
    measures = {"cases": F.count("*"), "detected": F.count("t_detect"), "latency_s": F.round(F.avg("latency_s"), 6), "far": F.round(F.avg("far"), 9)}
    return evaluation.rollup(outcome(s, d), ["outcome", "case_id"], measures)


def ranking_rollup(s: SparkSession, d: str) -> DataFrame:
    measures = {"cases": F.count("*"), "mrr": F.round(F.avg("reciprocal_rank"), 9), "top_1": F.sum("top_1")}
    return evaluation.rollup(with_fault(s, d).where("method = 'fusion'"), ["suite", "system", "fault"], measures)


def manifest_audit(s: SparkSession, d: str) -> DataFrame:
    """Rows, cases, repeated listings and labels that are missing."""
    m = table(s, d, "manifest_case")
    return m.agg(F.count("*").alias("rows"), F.count_distinct("case_id").alias("cases"), (F.count("*") - F.count_distinct("case_id")).alias("listed_again"), F.count_if(F.col("root_cause_service").isNull()).alias("no_service"), F.count_if(F.col("partition").isNull()).alias("no_partition"), F.count_if(F.coalesce(F.trim("suite"), F.lit("")) == "").alias("no_suite"))


def manifest_hash(s: SparkSession, d: str) -> DataFrame:
    """A hash of every system's cases that doesn't depend on row order: the sum and the exclusive or of all their hashes."""
    h = F.md5(F.concat_ws("|", "case_id", "family"))
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("bigint")
    return cases(s, d).groupBy("system").agg(F.count("*").alias("cases"), F.sum(half(1).cast("decimal(38,0)")).cast("string").alias("sum_hash"), F.bit_xor(half(16)).alias("xor_hash"))


QUERIES = {
    "case_metrics": lambda s, d: metrics(s, d).withColumn("reciprocal_rank", F.round("reciprocal_rank", 9)),
    "method_aggregate": lambda s, d: evaluation.method_aggregate(metrics(s, d)),
    "detection_outcome": outcome,
    "detection_rollup": rollup,
    "ranking_rollup": ranking_rollup,
    "geometric_ratio": lambda s, d: evaluation.geometric_ratio(paired(s, d)),
    "top_metrics": lambda s, d: evaluation.top_metrics(detect.metric_summary(tq.points(s, d)).withColumn("peak_score", F.round("peak_score", 6))),
    "oracle_headroom": lambda s, d: evaluation.headroom(with_fault(s, d), "fault"),
    "contingency": lambda s, d: evaluation.contingency(paired(s, d, "top_1")),
    "family_consistency": lambda s, d: evaluation.family_consistency(paired(s, d), family(s, d)),
    "score_spread": lambda s, d: evaluation.spread(rankings(s, d), "score", ["method"]),
    "holm": lambda s, d: evaluation.holm(p_values(s, d)),
    "randomization_p": lambda s, d: evaluation.randomization_test(paired(s, d), family(s, d)),
    "bootstrap_ci": lambda s, d: evaluation.cluster_bootstrap(paired(s, d), family(s, d)),
    "pairwise_examples": examples,
    "rank_pairwise": pairwise,
    "family_folds": lambda s, d: evaluation.folds(cases(s, d).select("case_id", "family"), "family"),
    "manifest_audit": manifest_audit,
    "manifest_hash": manifest_hash,
}


def _clean(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '')"


EVAL = f"""
valid AS (SELECT case_id, method, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id, method, entity ORDER BY computed_at DESC, score DESC NULLS LAST) AS rn FROM ranked_entity) WHERE rn = 1),
rankings AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id, method ORDER BY score DESC, entity) AS INTEGER) AS rank FROM valid WHERE score IS NOT NULL AND isfinite(score)),
listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY listed_at DESC) AS rn FROM manifest_case) WHERE rn = 1),
cases0 AS (SELECT case_id, {_clean('root_cause_service')} AS entity, coalesce({_clean('suite')}, {_clean("split_part(dataset, '-', 1)")}) AS suite, {_clean('system')} AS system, {_clean('fault')} AS fault FROM listed),
cases AS (SELECT *, suite || '|' || system || '|' || coalesce(entity, '') || '|' || fault AS family FROM cases0),
firsts AS (SELECT r.case_id, r.method, min(r.rank) FILTER (r.entity = c.entity) AS first FROM rankings r JOIN cases c ON c.case_id = r.case_id AND c.entity IS NOT NULL GROUP BY ALL),
metrics AS (SELECT case_id, method, first, {', '.join(f'CAST(coalesce(first <= {k}, false) AS INTEGER) AS top_{k}' for k in range(1, 6))}, coalesce(1 / CAST(first AS DOUBLE), 0) AS reciprocal_rank FROM firsts),
shared AS (SELECT * FROM metrics WHERE method IN ('pairwise', 's_comb') AND case_id IN (SELECT case_id FROM metrics WHERE method IN ('pairwise', 's_comb') GROUP BY 1 HAVING count(*) = 2)),
paired AS (SELECT case_id, max(reciprocal_rank) FILTER (method = 'pairwise') AS a, max(reciprocal_rank) FILTER (method = 's_comb') AS b, max(top_1) FILTER (method = 'pairwise') AS ta, max(top_1) FILTER (method = 's_comb') AS tb FROM shared GROUP BY ALL)"""

_SQUEEZE = ", ".join(f"CASE WHEN {f} IS NULL OR NOT isfinite({f}) THEN 0 ELSE round({f} / (1 + abs({f})), 9) END AS {f}" for f in FEATURES)

_OUTCOME = f"""WITH {tq.STREAKS},
al AS (SELECT case_id, ts, count(*) FILTER (streak >= 1) >= 6 AS alarm FROM streaks GROUP BY ALL),
st AS (SELECT case_id, ts, bool_or(status IN ('normal', 'anomaly')) AS ok FROM points GROUP BY ALL),
j AS (SELECT *, ts < {tq.CUTOFF} AS pre FROM st JOIN al USING (case_id, ts)),
g AS (SELECT case_id, count(*) FILTER (pre AND ok) AS pre_steps, count(*) FILTER (pre AND NOT ok) AS pre_missing, count(*) FILTER (pre AND ok AND alarm) AS pa, min(ts) FILTER (pre AND ok AND alarm) AS first_pre_alarm_ts,
  count(*) FILTER (NOT pre AND ok) AS ps, count(*) FILTER (NOT pre AND ok AND alarm) AS pp, min(ts) FILTER (NOT pre AND ok AND alarm) AS t_detect FROM j GROUP BY ALL)
SELECT case_id, first_pre_alarm_ts, t_detect, t_detect - {tq.CUTOFF} AS latency_s, round(coalesce(pa / CAST(nullif(pre_steps, 0) AS DOUBLE), 0), 9) AS far, round(coalesce(pp / CAST(nullif(ps, 0) AS DOUBLE), 0), 9) AS density, pre_steps, pre_missing,
  CASE WHEN t_detect IS NOT NULL THEN CASE WHEN first_pre_alarm_ts IS NULL THEN 'clean_detection' ELSE 'noisy_detection' END WHEN first_pre_alarm_ts IS NOT NULL THEN 'early_alarm_only' ELSE 'complete_miss' END AS outcome FROM g"""

ORACLES = {
    "detection_rollup": f"""SELECT CASE WHEN grouping(case_id) = 0 THEN 'case_id' WHEN grouping(outcome) = 0 THEN 'outcome' ELSE 'overall' END AS level, coalesce(outcome, case_id, 'all') AS value, count(*) AS cases, count(t_detect) AS detected, round(avg(latency_s), 6) AS latency_s, round(avg(far), 9) AS far
FROM ({_OUTCOME}) GROUP BY GROUPING SETS ((), (outcome), (case_id))""",
    "geometric_ratio": f"WITH {EVAL} SELECT count(*) AS n, round(avg(ln(a) - ln(b)), 9) AS mean_log, round(exp(avg(ln(a) - ln(b))), 9) AS ratio FROM paired WHERE a > 0 AND b > 0",
    "case_metrics": f"WITH {EVAL} SELECT * REPLACE (round(reciprocal_rank, 9) AS reciprocal_rank) FROM metrics",
    "method_aggregate": f"WITH {EVAL} SELECT method, count(*) AS cases, {', '.join(f'round(avg(top_{k}), 9) AS ac_{k}' for k in range(1, 6))}, round(avg((top_1 + top_2 + top_3) / 3.0), 9) AS avg_3, round(avg((top_1 + top_2 + top_3 + top_4 + top_5) / 5.0), 9) AS avg_5, round(avg(reciprocal_rank), 9) AS mrr, round(avg(CASE WHEN first IS NULL THEN 1 ELSE 0 END), 9) AS missing_rate FROM metrics GROUP BY ALL",
    "detection_outcome": _OUTCOME,
    "ranking_rollup": f"""WITH {EVAL}, f AS (SELECT m.*, coalesce(suite, 'unknown') AS suite, coalesce(system, 'unknown') AS system, coalesce(fault, 'unknown') AS fault FROM metrics m JOIN cases USING (case_id) WHERE method = 'fusion')
SELECT CASE WHEN grouping(fault) = 0 THEN 'fault' WHEN grouping(system) = 0 THEN 'system' WHEN grouping(suite) = 0 THEN 'suite' ELSE 'overall' END AS level, coalesce(suite, system, fault, 'all') AS value, count(*) AS cases, round(avg(reciprocal_rank), 9) AS mrr, CAST(sum(top_1) AS BIGINT) AS top_1
FROM f GROUP BY GROUPING SETS ((), (suite), (system), (fault))""",
    "top_metrics": f"WITH {tq.POINTS}, s AS (SELECT case_id, metric, round(max(abs(score)), 6) AS peak, count(*) FILTER (is_anomaly) AS n FROM points GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(peak, 0) DESC, n DESC, metric) AS INTEGER) AS place FROM s) SELECT case_id, metric, place FROM r WHERE place <= 5 AND (peak > 0 OR n > 0)",
    "oracle_headroom": f"""WITH {EVAL}, f AS (SELECT m.*, fault FROM metrics m JOIN cases USING (case_id)), a AS (SELECT method, avg(reciprocal_rank) AS m FROM metrics GROUP BY ALL),
b AS (SELECT fault, method, sum(reciprocal_rank) AS s, count(*) AS n FROM f GROUP BY ALL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fault ORDER BY s / n DESC) AS r FROM b) WHERE r = 1), e AS (SELECT case_id, max(reciprocal_rank) AS r FROM metrics GROUP BY ALL)
SELECT 'best_fixed' AS level, round(max(m), 9) AS mrr FROM a UNION ALL SELECT 'best_per_fault', round(sum(s) / sum(n), 9) FROM c UNION ALL SELECT 'best_per_case', round(avg(r), 9) FROM e""",
    "contingency": f"WITH {EVAL} SELECT count(*) FILTER (ta = 1 AND tb = 1) AS n11, count(*) FILTER (ta = 1 AND tb = 0) AS n10, count(*) FILTER (ta = 0 AND tb = 1) AS n01, count(*) FILTER (ta = 0 AND tb = 0) AS n00, round(exp(avg(ln(1 + ta) - ln(1 + tb))), 9) AS geometric_ratio FROM paired",
    "family_consistency": f"WITH {EVAL}, f AS (SELECT family, round(avg(a - b), 12) AS d FROM paired JOIN cases USING (case_id) GROUP BY ALL) SELECT CASE WHEN d > 0 THEN 'improved' WHEN d < 0 THEN 'degraded' ELSE 'tied' END AS outcome, count(*) AS families FROM f GROUP BY ALL",
    "score_spread": f"WITH {EVAL} SELECT method, count(score) AS n, round(quantile_cont(score, 0.25), 9) AS q1, round(median(score), 9) AS median, round(quantile_cont(score, 0.75), 9) AS q3, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 9) AS iqr, quantile_disc(score, 0.95) AS p95 FROM rankings GROUP BY ALL",
    "holm": f"WITH {EVAL}, t AS (SELECT m.method AS name, round(avg(CASE WHEN m.reciprocal_rank < x.reciprocal_rank THEN 1 ELSE 0 END) / 10, 9) AS p FROM metrics m JOIN metrics x ON x.case_id = m.case_id AND x.method = 's_comb' WHERE m.method <> 's_comb' GROUP BY ALL), i AS (SELECT *, row_number() OVER (ORDER BY p, name) AS i, count(*) OVER () AS m FROM t) SELECT name, p, round(max(least(1, p * (m - i + 1))) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 12) AS p_holm FROM i",
    "pairwise_examples": f"""WITH {EVAL}, prof AS (SELECT case_id, coalesce(nullif(entity, ''), nullif(service_id, '')) AS entity, {_SQUEEZE} FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ingested_at DESC) AS rn FROM candidate_evidence_profile) WHERE rn = 1),
j AS (SELECT o.case_id, o.entity, {', '.join(f'r.{f} - o.{f} AS {f}' for f in FEATURES)} FROM prof o JOIN cases c ON c.case_id = o.case_id AND c.entity IS NOT NULL AND o.entity <> c.entity JOIN prof r ON r.case_id = o.case_id AND r.entity = c.entity)
SELECT case_id, entity, 1 AS label, {', '.join(FEATURES)} FROM j UNION ALL SELECT case_id, entity, 0, {', '.join(f'-{f}' for f in FEATURES)} FROM j""",
    "family_folds": f"WITH {EVAL}, n AS (SELECT family, CAST((row_number() OVER (ORDER BY family) - 1) % 3 AS INTEGER) AS fold FROM (SELECT DISTINCT family FROM cases)) SELECT case_id, family, fold FROM cases JOIN n USING (family)",
    "manifest_audit": "SELECT count(*) AS rows, count(DISTINCT case_id) AS cases, count(*) - count(DISTINCT case_id) AS listed_again, count(*) FILTER (root_cause_service IS NULL) AS no_service, count(*) FILTER (partition IS NULL) AS no_partition, count(*) FILTER (coalesce(trim(suite), '') = '') AS no_suite FROM manifest_case",
    "manifest_hash": f"WITH {EVAL}, h AS (SELECT system, md5(concat_ws('|', case_id, family)) AS h FROM cases) SELECT system, count(*) AS cases, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_hash, bit_xor(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS xor_hash FROM h GROUP BY ALL",
}
