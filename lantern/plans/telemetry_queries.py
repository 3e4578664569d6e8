"""Queries of detection, episodes, traces, graphs and rankings, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.lineage import cut
from lantern.operators import detect, episodes, graph, ranking, traces
from lantern.sources import telemetry

WINDOW, THRESHOLD, WARMUP, LEAST = 24, 2.0, 24, 12
K, M = 1, 2
CUTOFF = 1705276800  # 2024-01-15 00:00:00 UTC

# ---- Spark ------------------------------------------------------------------------------------------------


def metrics(s: SparkSession, d: str) -> DataFrame:
    return telemetry.metrics_long(s, d)


def points(s: SparkSession, d: str) -> DataFrame:
    return detect.zscore_points(metrics(s, d), WINDOW, THRESHOLD, WARMUP, LEAST)


def steps(s: SparkSession, d: str) -> DataFrame:
    return episodes.entity_steps(points(s, d), K, M)


def evidence(s: SparkSession, d: str) -> DataFrame:
    return episodes.evidence(steps(s, d))


def calls(s: SparkSession, d: str) -> DataFrame:
    return traces.relations(telemetry.spans(s, d))


def edges(s: SparkSession, d: str) -> DataFrame:
    return traces.edges(calls(s, d))


def universe(s: SparkSession, d: str) -> DataFrame:
    return telemetry.spans(s, d).select("case_id", F.col("service").alias("entity")).distinct()


def span_decomposition_us(s: SparkSession, d: str) -> DataFrame:
    sp = telemetry.spans(s, d)
    parents = sp.select("span_id", F.col("start_us").alias("start"), F.col("duration_us").alias("duration"))
    children = sp.where("parent_span_id is not null").select("parent_span_id", F.col("start_us").alias("start"), F.col("duration_us").alias("duration"))
    return traces.decompose(parents, children)


def latency(s: SparkSession, d: str) -> DataFrame:
    # Every percentile reads the calls: they are joined once and written.
    return traces.edge_latency(cut(calls(s, d)), cut(span_decomposition_us(s, d).select("span_id", "covered_fraction")))


def r_points(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def s_comb(s: SparkSession, d: str) -> DataFrame:
    p = cut(points(s, d))
    st = cut(episodes.entity_steps(p, K, M))
    return ranking.s_comb(p, st, episodes.evidence(st))


def elevation(s: SparkSession, d: str) -> DataFrame:
    return traces.inbound_elevation(latency(s, d))


def trace_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.by_score(universe(s, d), elevation(s, d), "score")


def fusion(s: SparkSession, d: str) -> DataFrame:
    return ranking.fuse_equal([s_comb(s, d), trace_rank(s, d)])


def as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


def eps(s: SparkSession, d: str) -> DataFrame:
    return episodes.entity_episodes(steps(s, d))


def eps_truncated(s: SparkSession, d: str) -> DataFrame:
    st = cut(steps(s, d))
    return as_text(episodes.truncate(episodes.entity_episodes(st), st, CUTOFF), "metrics")


def tcec(s: SparkSession, d: str) -> DataFrame:
    p = cut(points(s, d))
    st = cut(episodes.entity_steps(p, K, M))
    alarms = detect.case_alarms(p, K, 3)
    cand = alarms.where("alarm").select("case_id", F.col("ts").alias("candidate_ts"))
    return graph.confirm(cut(episodes.entity_episodes(st)), edges(s, d), cand, st.select("case_id", "ts").distinct())


def order_decomposition(s: SparkSession, d: str) -> DataFrame:
    return traces.decompose(*telemetry.order_spans(s, d))


def order_union(s: SparkSession, d: str) -> DataFrame:
    _, children = telemetry.order_spans(s, d)
    return traces.interval_union(children.select("parent_span_id", "start", (F.col("start") + F.col("duration")).alias("end")), ["parent_span_id"])


def truth(s: SparkSession, d: str) -> DataFrame:
    return metrics(s, d).groupBy("case_id").agg(F.lit(CUTOFF).cast("bigint").alias("inject_ts"), F.max("ts").alias("last_ts"))


def dist_value(s: SparkSession, d: str) -> DataFrame:
    sp = telemetry.spans(s, d)
    out = traces.distribution(sp, ["case_id", "service"], "duration_us")
    return out.withColumn("mean", F.round("mean", 6))


QUERIES = {
    "metrics_long": metrics,
    "zscore_points": lambda s, d: r_points(points(s, d)),
    "mad_points": lambda s, d: r_points(detect.mad_points(metrics(s, d), WINDOW, THRESHOLD, WARMUP, LEAST)),
    "truncate_as_of": lambda s, d: detect.metric_summary(detect.as_of(points(s, d), CUTOFF)).withColumn("peak_score", F.round("peak_score", 6)),
    "metric_summary": lambda s, d: detect.metric_summary(points(s, d)).withColumn("peak_score", F.round("peak_score", 6)),
    "case_summary": lambda s, d: detect.case_summary(points(s, d)),
    "entity_evidence": lambda s, d: detect.entity_evidence(points(s, d)),
    "streaks": lambda s, d: detect.streaks(points(s, d)).groupBy("case_id", "metric").agg(F.max("streak").alias("longest"), F.count_if(F.col("streak") == 2).alias("twos")),
    "case_alarms": lambda s, d: detect.case_alarms(points(s, d), K, M),
    "case_alarms_k2_m2": lambda s, d: detect.case_alarms(points(s, d), 2, 2),
    "entity_episodes": lambda s, d: as_text(eps(s, d), "metrics"),
    "truncate_episodes": eps_truncated,
    "rank_s_comb": s_comb,
    "rank_margin": lambda s, d: ranking.margins(s_comb(s, d)).withColumn("margin", F.round("margin", 9)),
    "rank_softmax": lambda s, d: ranking.softmax(s_comb(s, d)).withColumn("probability", F.round("probability", 9)),
    "rank_random": lambda s, d: ranking.hash_order(universe(s, d)),
    **{f"rank_rca_{k}": lambda s, d, use=use: ranking.observational(evidence(s, d), edges(s, d), use) for k, use in ranking.CONFIGURATIONS.items()},
    "span_edges": edges,
    "span_relations": calls,
    "edge_latency": lambda s, d: latency(s, d).withColumns({c: F.round(c, 9) for c in ("fraction_p50", "covered_p50")}),
    "edge_examples": lambda s, d: traces.examples(calls(s, d)),
    "edge_attribution": lambda s, d: traces.attribution(latency(s, d)),
    "entity_trace": lambda s, d: traces.entity_trace(traces.attribution(latency(s, d))),
    "distribution_summary": dist_value,
    "interval_union": order_union,
    "span_decomposition": order_decomposition,
    "completed_spans": lambda s, d: traces.completed(telemetry.spans(s, d), CUTOFF * 1_000_000).select("case_id", "span_id"),
    "rank_trace_elevation": trace_rank,
    "rank_fusion": fusion,
    "rank_tiebreak": lambda s, d: ranking.tiebreak(s_comb(s, d).withColumn("score", F.round("score", 1)), elevation(s, d)),
    "trace_p95_alerts": lambda s, d: traces.p95_alerts(telemetry.spans(s, d), CUTOFF * 1_000_000, 1.02),
    "uninstrumented": lambda s, d: traces.uninstrumented(telemetry.spans(s, d).select("case_id", F.explode(F.array(*map(F.lit, ("click", "view", "search", "logout")))).alias("entity")).distinct(), telemetry.spans(s, d)),
    "reachability": lambda s, d: graph.reach(edges(s, d)),
    "neighbourhood": lambda s, d: graph.within(edges(s, d), 2),
    "propagation_coverage": lambda s, d: graph.propagation_coverage(evidence(s, d), edges(s, d)),
    "rank_propagation": lambda s, d: ranking.coverage_rank(s_comb(s, d), graph.propagation_coverage(evidence(s, d), edges(s, d))).select("case_id", "entity", "coverage", "score", "new_rank"),
    "tcec": tcec,
    "edge_first_visible": lambda s, d: graph.visible_at(edges(s, d), metrics(s, d).select("case_id", "ts").distinct()),
    "incident_window_oracle": lambda s, d: graph.incident_window(truth(s, d), evidence(s, d), "oracle"),
    "incident_window_detected": lambda s, d: graph.incident_window(truth(s, d), evidence(s, d), "detected"),
}

# ---- DuckDB -----------------------------------------------------------------------------------------------

METRICS = """
ev AS (SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS case_id, event_type AS entity, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS ts, value FROM events),
bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM ev),
spine AS (SELECT case_id, entity, unnest(generate_series(lo, hi, 3600)) AS ts FROM (SELECT DISTINCT case_id, entity FROM ev), bounds),
hourly AS (SELECT case_id, entity, ts, count(*) AS n, sum(value) AS s, avg(value) AS a FROM ev GROUP BY ALL),
joined AS (SELECT spine.case_id, spine.entity, spine.ts, n, s, a FROM spine LEFT JOIN hourly USING (case_id, entity, ts)),
signals AS (
  SELECT case_id, entity, ts, 'count' AS signal, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM joined
  UNION ALL SELECT case_id, entity, ts, 'sum', round(coalesce(s, 0), 6) FROM joined
  UNION ALL SELECT case_id, entity, ts, 'avg', round(a, 6) FROM joined),
metrics AS (SELECT case_id, ts, CAST(row_number() OVER (PARTITION BY case_id, entity, signal ORDER BY ts) - 1 AS INTEGER) AS obs_idx, entity || '_' || signal AS metric, entity, signal, value FROM signals)"""

_SCORED = """
  SELECT case_id, entity, metric, ts, obs_idx,
    CASE WHEN obs_idx < {warm} THEN 'warmup' WHEN value IS NULL THEN 'missing_observation' WHEN n < {least} THEN 'insufficient_history'
         WHEN sd <= 1e-12 THEN CASE WHEN abs(value - mu) <= greatest(1e-9 * greatest(abs(value), abs(mu)), 1e-12) THEN 'normal' ELSE 'anomaly' END
         WHEN abs((value - mu) / (sd + 1e-6)) >= {thr} THEN 'anomaly' ELSE 'normal' END AS status,
    CASE WHEN sd <= 1e-12 THEN CASE WHEN abs(value - mu) <= greatest(1e-9 * greatest(abs(value), abs(mu)), 1e-12) THEN 0 ELSE (value - mu) / 1e-6 END
         ELSE (value - mu) / (sd + 1e-6) END AS z, n AS valid_history
  FROM framed""".format(warm=WARMUP, least=LEAST, thr=THRESHOLD)

_OUT = """SELECT case_id, entity, metric, ts, obs_idx, status, CASE WHEN status IN ('anomaly', 'normal') THEN z END AS score, status = 'anomaly' AS is_anomaly, valid_history FROM scored"""

POINTS = METRICS + f""",
rolled AS (SELECT *, count(value) OVER w AS n, avg(value) OVER w AS mu0, stddev_pop(value) OVER w AS sd0, min(value) OVER w AS lo, max(value) OVER w AS hi FROM metrics
  WINDOW w AS (PARTITION BY case_id, metric ORDER BY obs_idx ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
framed AS (SELECT * EXCLUDE (mu0, sd0), CASE WHEN lo = hi THEN lo ELSE mu0 END AS mu, CASE WHEN lo = hi THEN 0 ELSE sd0 END AS sd FROM rolled),
scored AS ({_SCORED}),
points AS ({_OUT})"""

MAD = METRICS + f""",
rolled AS (SELECT *, count(value) OVER w AS n, list(value) FILTER (value IS NOT NULL) OVER w AS f FROM metrics
  WINDOW w AS (PARTITION BY case_id, metric ORDER BY obs_idx ROWS BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING)),
centred AS (SELECT *, list_median(f) AS mu FROM rolled),
framed AS (SELECT *, 1.4826 * list_median(list_transform(f, lambda x: abs(x - mu))) AS sd FROM centred),
scored AS ({_SCORED}),
points AS ({_OUT})"""

STREAKS = POINTS + """,
resets AS (SELECT *, sum(CASE WHEN is_anomaly THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, metric ORDER BY obs_idx) AS g FROM points),
streaks AS (SELECT *, CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, metric, g ORDER BY obs_idx) AS BIGINT) AS streak FROM resets)"""

STEPS = STREAKS + f""",
steps AS (SELECT case_id, entity, obs_idx, ts, count(*) FILTER (streak >= {K}) AS active, list(metric) FILTER (streak >= {K}) AS contributing, count(*) FILTER (streak >= {K}) >= {M} AS in_episode FROM streaks GROUP BY ALL),
evidence AS (SELECT case_id, entity, bool_or(in_episode) AS has_episode, min(ts) FILTER (in_episode) AS first_ts, max(active) AS peak_active FROM steps GROUP BY ALL),
islands AS (SELECT *, obs_idx - row_number() OVER (PARTITION BY case_id, entity ORDER BY obs_idx) AS island FROM steps WHERE in_episode),
episodes AS (SELECT case_id, entity, min(obs_idx) AS start_idx, max(obs_idx) AS end_idx, min(ts) AS start_ts, max(ts) AS end_ts, max(active) AS peak_active,
  array_to_string(list_sort(list_distinct(flatten(list(contributing)))), ',') AS metrics, max(ts) - min(ts) AS duration_s FROM islands GROUP BY case_id, entity, island)"""

SCOMB = STEPS + """,
contributes AS (SELECT DISTINCT case_id, entity, unnest(contributing) AS metric FROM steps WHERE in_episode),
peaks AS (SELECT p.case_id, p.entity, p.metric, max(coalesce(abs(p.score), 0)) AS z FROM points p
  JOIN (SELECT case_id, entity, obs_idx FROM steps WHERE in_episode) s USING (case_id, entity, obs_idx) JOIN contributes c USING (case_id, entity, metric) GROUP BY ALL),
mags AS (SELECT case_id, entity, sum(ln(1 + z)) AS m FROM peaks GROUP BY ALL),
own AS (SELECT e.*, CASE WHEN has_episode THEN CAST(peak_active AS DOUBLE) ELSE 0 END AS c, coalesce(m, 0) AS mm FROM evidence e LEFT JOIN mags USING (case_id, entity)),
scomb0 AS (SELECT case_id, entity, CASE WHEN has_episode THEN first_ts END AS first_ts,
  round(CASE WHEN has_episode THEN 0.5 * coalesce(c / nullif(max(c) OVER (PARTITION BY case_id), 0), 0) + 0.5 * coalesce(mm / nullif(max(mm) OVER (PARTITION BY case_id), 0), 0) ELSE 0 END, 9) AS score FROM own),
scomb AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, first_ts ASC NULLS LAST, entity) AS INTEGER) AS rank FROM scomb0)"""

SPANS = """
spans AS (SELECT *, lag(span_id) OVER (PARTITION BY trace_id ORDER BY start_us, span_id) AS parent_span_id FROM (
  SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS case_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS span_id, event_type AS service,
    epoch_us(ts) AS start_us, CAST(round(value * 1000000) AS BIGINT) AS duration_us FROM events)),
calls AS (SELECT c.case_id, p.service AS src, c.service AS dst, p.span_id AS caller_span_id, c.span_id, greatest(p.duration_us, 0) AS caller_duration, greatest(c.duration_us, 0) AS callee_duration,
    c.start_us - p.start_us AS start_lag, p.start_us + p.duration_us - c.start_us - c.duration_us AS return_lag,
    CASE WHEN p.duration_us > 0 THEN greatest(c.duration_us, 0) / CAST(p.duration_us AS DOUBLE) ELSE 0 END AS fraction, greatest(p.start_us + p.duration_us, c.start_us + c.duration_us) AS visible_us
  FROM spans c JOIN spans p ON c.case_id = p.case_id AND c.parent_span_id = p.span_id WHERE c.service <> p.service),
edges AS (SELECT case_id, src, dst, count(*) AS n, min(visible_us) AS first_visible_us FROM calls GROUP BY ALL)"""

# A span here has one child at most (the next event of the day), so its cover is one clipped interval.
LATENCY = SPANS + """,
cover AS (SELECT p.span_id, CASE WHEN p.duration_us > 0 THEN round(greatest(0, coalesce(least(c.start_us + c.duration_us, p.start_us + p.duration_us) - greatest(c.start_us, p.start_us), 0)) / CAST(p.duration_us AS DOUBLE), 9) ELSE 0 END AS covered_fraction
  FROM spans p LEFT JOIN spans c ON c.parent_span_id = p.span_id AND c.case_id = p.case_id),
lists AS (SELECT case_id, src, dst, count(*) AS calls, CAST(sum(caller_duration) AS BIGINT) AS total_caller, CAST(sum(callee_duration) AS BIGINT) AS total_callee,
    list_sort(list(caller_duration)) AS a, list_sort(list(callee_duration)) AS b, list_sort(list(return_lag)) AS l, list_sort(list(fraction)) AS f, list_sort(list(covered_fraction)) AS k
  FROM calls JOIN cover ON calls.caller_span_id = cover.span_id GROUP BY ALL),
latency AS (SELECT case_id, src, dst, calls, total_caller, total_callee,
    a[CAST(round_even(0.1 * (calls - 1), 0) AS INTEGER) + 1] AS caller_p10, a[CAST(round_even(0.5 * (calls - 1), 0) AS INTEGER) + 1] AS caller_p50, a[CAST(round_even(0.9 * (calls - 1), 0) AS INTEGER) + 1] AS caller_p90,
    b[CAST(round_even(0.5 * (calls - 1), 0) AS INTEGER) + 1] AS callee_p50, b[CAST(round_even(0.9 * (calls - 1), 0) AS INTEGER) + 1] AS callee_p90,
    l[CAST(round_even(0.9 * (calls - 1), 0) AS INTEGER) + 1] AS lag_p90, f[CAST(round_even(0.5 * (calls - 1), 0) AS INTEGER) + 1] AS fraction_p50, k[CAST(round_even(0.5 * (calls - 1), 0) AS INTEGER) + 1] AS covered_p50
  FROM lists),
elev AS (SELECT case_id, dst AS entity, round(max(CASE WHEN caller_p90 <= 0 OR caller_p10 >= caller_p90 THEN 0 ELSE (caller_p90 - caller_p10) / CAST(caller_p90 AS DOUBLE) END), 9) AS score FROM latency GROUP BY ALL),
uni AS (SELECT DISTINCT case_id, service AS entity FROM spans),
elevrank AS (SELECT case_id, entity, coalesce(score, 0) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, 0) DESC, entity) AS INTEGER) AS rank FROM uni LEFT JOIN elev USING (case_id, entity))"""

ATTR = LATENCY + """,
own AS (SELECT case_id, src, median(covered_p50) AS cov FROM latency GROUP BY ALL),
parts AS (SELECT l.case_id, l.src, l.dst, CASE WHEN caller_p90 <= 0 OR caller_p10 >= caller_p90 THEN 0 ELSE (caller_p90 - caller_p10) / CAST(caller_p90 AS DOUBLE) END AS elevation,
    CASE WHEN sum(total_caller) OVER w <= 0 OR total_caller <= 0 THEN 0 ELSE total_caller / CAST(sum(total_caller) OVER w AS DOUBLE) END AS concentration, count(*) OVER w AS siblings,
    caller_p90 > 0 AND lag_p90 >= 0.5 * caller_p90 AS lag_dominant, cov FROM latency l LEFT JOIN own ON own.case_id = l.case_id AND own.src = l.dst WINDOW w AS (PARTITION BY l.case_id, l.src)),
attr AS (SELECT case_id, src, dst, round(elevation, 9) AS elevation, round(concentration, 9) AS concentration, siblings, round(CASE WHEN lag_dominant OR cov IS NULL THEN 1 ELSE greatest(0, least(1, 1 - cov)) END, 9) AS terminal, lag_dominant,
    round(elevation * concentration * CASE WHEN lag_dominant OR cov IS NULL THEN 1 ELSE greatest(0, least(1, 1 - cov)) END, 9) AS score FROM parts)"""

_SUMMARY = """SELECT case_id, metric, round(max(abs(score)), 6) AS peak_score, count(*) FILTER (status = 'warmup') AS warmup, count(*) FILTER (status = 'missing_observation') AS missing_observation,
  count(*) FILTER (status = 'insufficient_history') AS insufficient_history, count(*) FILTER (status = 'normal') AS normal, count(*) FILTER (status = 'anomaly') AS anomaly, min(ts) FILTER (is_anomaly) AS first_anomaly_ts FROM points"""

RCA = "WITH RECURSIVE " + STEPS.lstrip() + "," + SPANS + """,
base AS (SELECT case_id, entity, has_episode, CASE WHEN has_episode THEN first_ts END AS first_ts, CASE WHEN has_episode THEN CAST(peak_active AS DOUBLE) ELSE 0 END AS peak FROM evidence),
own AS (SELECT *, CASE WHEN NOT has_episode THEN 0 WHEN min(first_ts) OVER w = max(first_ts) OVER w THEN 1 ELSE 1 - (first_ts - min(first_ts) OVER w) / CAST(max(first_ts) OVER w - min(first_ts) OVER w AS DOUBLE) END AS r_early,
    CASE WHEN has_episode THEN coalesce(peak / nullif(max(peak) OVER w, 0), 0) ELSE 0 END AS r_strength FROM base WINDOW w AS (PARTITION BY case_id)),
near AS (SELECT o.case_id, o.entity, count(s.dst) AS n, count(*) FILTER (c.has_episode) AS hit, count(*) FILTER (c.has_episode AND c.first_ts >= o.first_ts) AS later
  FROM own o LEFT JOIN edges s ON s.case_id = o.case_id AND s.src = o.entity LEFT JOIN own c ON c.case_id = s.case_id AND c.entity = s.dst GROUP BY ALL),
rca0 AS (SELECT case_id, entity, round(r_strength, 9) AS r_strength, round(r_early, 9) AS r_early, round(CASE WHEN has_episode AND n > 0 THEN hit / CAST(n AS DOUBLE) ELSE 0 END, 9) AS r_coverage, round(CASE WHEN has_episode AND n > 0 THEN later / CAST(n AS DOUBLE) ELSE 0 END, 9) AS r_prop, first_ts, peak,
    r_strength AS s1, r_early AS s2, CASE WHEN has_episode AND n > 0 THEN hit / CAST(n AS DOUBLE) ELSE 0 END AS s3, CASE WHEN has_episode AND n > 0 THEN later / CAST(n AS DOUBLE) ELSE 0 END AS s4 FROM own JOIN near USING (case_id, entity)),
rca AS (SELECT * EXCLUDE (s1, s2, s3, s4), round({total}, 9) AS score FROM rca0)
SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, first_ts NULLS LAST, peak DESC, entity) AS INTEGER) AS rank FROM rca"""

REACH = "WITH RECURSIVE " + SPANS + """,
reach AS (SELECT case_id, src, dst FROM edges UNION SELECT r.case_id, r.src, s.dst FROM reach r JOIN edges s ON s.case_id = r.case_id AND s.src = r.dst)
SELECT * FROM reach WHERE src <> dst"""

COVERAGE = STEPS + "," + SPANS + """,
und AS (SELECT DISTINCT case_id, least(src, dst) AS u, greatest(src, dst) AS v FROM edges),
ori AS (SELECT und.case_id, CASE WHEN a.first_ts < b.first_ts THEN u ELSE v END AS src, CASE WHEN a.first_ts < b.first_ts THEN v ELSE u END AS dst
  FROM und JOIN evidence a ON a.case_id = und.case_id AND a.entity = u AND a.has_episode JOIN evidence b ON b.case_id = und.case_id AND b.entity = v AND b.has_episode WHERE a.first_ts <> b.first_ts),
reach AS (SELECT case_id, src, dst FROM ori UNION SELECT r.case_id, r.src, o.dst FROM reach r JOIN ori o ON o.case_id = r.case_id AND o.src = r.dst),
coverage AS (SELECT e.case_id, e.entity, count(r.dst) AS coverage FROM evidence e LEFT JOIN reach r ON r.case_id = e.case_id AND r.src = e.entity GROUP BY ALL)"""

ORDERS = """
parents AS (SELECT o_orderkey AS span_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS p0, CAST(60 AS BIGINT) AS duration FROM orders),
kids AS (SELECT l_orderkey AS parent_span_id, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS c0, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS c1 FROM lineitem)"""


def _union(source: str, key: str, a: str, b: str) -> str:
    return f"""SELECT {key}, min({a}) AS s, max({b}) AS e FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY {a}, {b} ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN {a} <= max({b}) OVER (PARTITION BY {key} ORDER BY {a}, {b} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source} WHERE {b} > {a})) GROUP BY {key}, g"""


ORACLES = {
    "metrics_long": f"WITH {METRICS} SELECT * FROM metrics",
    "zscore_points": f"WITH {POINTS} SELECT * REPLACE (round(score, 6) AS score) FROM points",
    "mad_points": f"WITH {MAD} SELECT * REPLACE (round(score, 6) AS score) FROM points",
    "truncate_as_of": f"WITH {POINTS} {_SUMMARY} WHERE ts <= {CUTOFF} GROUP BY ALL",
    "metric_summary": f"WITH {POINTS} {_SUMMARY} GROUP BY ALL",
    "case_summary": f"WITH {POINTS} SELECT case_id, count(DISTINCT metric) FILTER (is_anomaly) AS detected_metrics, min(ts) FILTER (is_anomaly) AS earliest_ts, count(*) FILTER (is_anomaly) AS anomalies, count(DISTINCT obs_idx) FILTER (is_anomaly) AS observations_with_anomaly FROM points GROUP BY ALL",
    "entity_evidence": f"WITH {POINTS}, st AS (SELECT case_id, entity, ts, count(*) FILTER (is_anomaly) AS active FROM points GROUP BY ALL), mm AS (SELECT case_id, entity, coalesce(string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (is_anomaly), '') AS anomalous_metrics FROM points GROUP BY ALL) SELECT case_id, entity, max(active) AS peak_active, min(ts) FILTER (active > 0) AS first_anomaly_ts, any_value(anomalous_metrics) AS anomalous_metrics FROM st JOIN mm USING (case_id, entity) GROUP BY ALL".replace("any_value(anomalous_metrics) AS anomalous_metrics", "anomalous_metrics"),
    "streaks": f"WITH {STREAKS} SELECT case_id, metric, max(streak) AS longest, count(*) FILTER (streak = 2) AS twos FROM streaks GROUP BY ALL",
    "case_alarms": f"WITH {STREAKS} SELECT case_id, ts, count(*) FILTER (streak >= {K}) AS active, count(*) FILTER (streak >= {K}) >= {M} AS alarm FROM streaks GROUP BY ALL",
    "case_alarms_k2_m2": f"WITH {STREAKS} SELECT case_id, ts, count(*) FILTER (streak >= 2) AS active, count(*) FILTER (streak >= 2) >= 2 AS alarm FROM streaks GROUP BY ALL",
    "entity_episodes": f"WITH {STEPS} SELECT * FROM episodes",
    "truncate_episodes": f"WITH {STEPS}, last AS (SELECT case_id, entity, max(ts) AS lts, max(obs_idx) AS lidx FROM steps WHERE ts <= {CUTOFF} GROUP BY ALL) SELECT case_id, entity, start_idx, least(end_idx, lidx) AS end_idx, start_ts, least(end_ts, lts) AS end_ts, peak_active, metrics, least(end_ts, lts) - start_ts AS duration_s FROM episodes JOIN last USING (case_id, entity) WHERE start_ts <= {CUTOFF}",
    "rank_s_comb": f"WITH {SCOMB} SELECT * FROM scomb",
    "rank_margin": f"WITH {SCOMB} SELECT case_id, round(coalesce(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 1), 9) AS margin FROM scomb GROUP BY ALL",
    "rank_softmax": f"WITH {SCOMB}, e AS (SELECT case_id, entity, exp(score - max(score) OVER (PARTITION BY case_id)) AS x FROM scomb) SELECT case_id, entity, round(x / sum(x) OVER (PARTITION BY case_id), 9) AS probability FROM e",
    "rank_random": f"WITH {SPANS}, u AS (SELECT DISTINCT case_id, service AS entity FROM spans), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY sha256(case_id || '|' || entity), entity) AS INTEGER) AS rank, count(*) OVER (PARTITION BY case_id) AS n FROM u) SELECT case_id, entity, rank, round((n - rank + 1) / CAST(n AS DOUBLE), 9) AS score FROM r",
    "rank_rca_a": RCA.format(total="s1"),
    "rank_rca_b": RCA.format(total="s1 + s2"),
    "rank_rca_c": RCA.format(total="s1 + s3"),
    "rank_rca_d": RCA.format(total="s1 + s2 + s4"),
    "span_edges": f"WITH {SPANS} SELECT * FROM edges",
    "span_relations": f"WITH {SPANS} SELECT * FROM calls",
    "edge_latency": f"WITH {LATENCY} SELECT * REPLACE (round(fraction_p50, 9) AS fraction_p50, round(covered_p50, 9) AS covered_p50) FROM latency",
    "edge_examples": f"WITH {SPANS}, r AS (SELECT case_id, src, dst, CAST(row_number() OVER (PARTITION BY case_id, src, dst ORDER BY caller_duration DESC, span_id) AS INTEGER) AS place, caller_span_id, span_id, caller_duration FROM calls) SELECT * FROM r WHERE place <= 5",
    "edge_attribution": f"WITH {ATTR} SELECT * FROM attr",
    "entity_trace": f"WITH {ATTR}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id, dst ORDER BY score DESC, src) AS r FROM attr) SELECT case_id, dst AS entity, score, src AS primary_src FROM r WHERE r = 1",
    "distribution_summary": f"WITH {SPANS}, l AS (SELECT case_id, service, count(*) AS n, list_sort(list(duration_us)) AS v, avg(duration_us) AS a FROM spans GROUP BY ALL) SELECT case_id, service, CAST(n AS BIGINT) AS n, v[1] AS min, " + ", ".join(f"v[CAST(round_even({p / 100} * (n - 1), 0) AS INTEGER) + 1] AS p{p}" for p in (10, 50, 90, 99)) + ", v[n] AS max, round(a, 6) AS mean FROM l",
    "interval_union": f'WITH {ORDERS} SELECT parent_span_id, s AS "start", e AS "end" FROM ({_union("kids", "parent_span_id", "c0", "c1")})',
    "span_decomposition": f"""WITH {ORDERS},
j AS (SELECT p.span_id, p.p0, p.duration, c0, c1 FROM parents p JOIN kids ON span_id = parent_span_id),
lap AS (SELECT span_id, c1 > c0 AND c0 < max(CASE WHEN c1 > c0 THEN c1 END) OVER (PARTITION BY span_id ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM j),
seen AS (SELECT span_id, count(*) AS children, coalesce(bool_or(l), false) AS overlap FROM lap GROUP BY ALL),
clip AS (SELECT span_id, greatest(c0, p0) AS a, least(c1, p0 + duration) AS b FROM j),
u AS ({_union("clip", "span_id", "a", "b")}),
cov AS (SELECT span_id, CAST(sum(e - s) AS BIGINT) AS covered FROM u GROUP BY ALL)
SELECT p.span_id, duration, coalesce(children, 0) AS children, coalesce(covered, 0) AS covered, duration - coalesce(covered, 0) AS self_time, round(coalesce(covered, 0) / CAST(duration AS DOUBLE), 9) AS covered_fraction,
  round((duration - coalesce(covered, 0)) / CAST(duration AS DOUBLE), 9) AS self_fraction, coalesce(overlap, false) AS overlap FROM parents p LEFT JOIN seen USING (span_id) LEFT JOIN cov USING (span_id)""",
    "completed_spans": f"WITH {SPANS} SELECT case_id, span_id FROM spans WHERE start_us + duration_us <= {CUTOFF}000000",
    "rank_trace_elevation": f"WITH {LATENCY} SELECT * FROM elevrank",
    "rank_fusion": f"WITH {SCOMB}, {LATENCY}, n1 AS (SELECT case_id, entity, coalesce(score / nullif(max(score) OVER (PARTITION BY case_id), 0), 0) AS s FROM scomb), n2 AS (SELECT case_id, entity, coalesce(score / nullif(max(score) OVER (PARTITION BY case_id), 0), 0) AS s FROM elevrank), f AS (SELECT case_id, entity, round(sum(s) / 2, 9) AS score FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, entity) AS INTEGER) AS rank FROM f",
    "rank_tiebreak": f"WITH {SCOMB}, {LATENCY}, t AS (SELECT s.case_id, s.entity, round(s.score, 1) AS score, first_ts, s.rank, coalesce(e.score, 0) AS e_elev FROM scomb s LEFT JOIN elev e USING (case_id, entity)), r AS (SELECT *, count(*) OVER (PARTITION BY case_id, score) > 1 AS tied, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, e_elev DESC, rank) AS INTEGER) AS new_rank FROM t) SELECT *, tied AND rank <> new_rank AS moved FROM r",
    "trace_p95_alerts": f"WITH {SPANS}, q AS (SELECT case_id, service, quantile_cont(CAST(duration_us AS DOUBLE), 0.95) FILTER (start_us < {CUTOFF}000000) AS normal_p95, quantile_cont(CAST(duration_us AS DOUBLE), 0.95) FILTER (start_us >= {CUTOFF}000000) AS incident_p95 FROM spans GROUP BY ALL) SELECT *, coalesce(normal_p95 > 0 AND incident_p95 >= 1.02 * normal_p95, false) AS alert FROM q",
    "uninstrumented": f"WITH {SPANS}, x AS (SELECT DISTINCT case_id, unnest(['click', 'view', 'search', 'logout']) AS entity FROM spans) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.case_id = x.case_id AND s.service = x.entity)",
    "reachability": REACH,
    "neighbourhood": f"WITH {SPANS}, b AS (SELECT DISTINCT * FROM (SELECT case_id, src, dst FROM edges UNION ALL SELECT case_id, dst, src FROM edges)), two AS (SELECT a.case_id, a.src, c.dst FROM b a JOIN b c ON a.case_id = c.case_id AND a.dst = c.src WHERE a.src <> c.dst) SELECT case_id, src, dst, min(hops) AS hops FROM (SELECT *, 1 AS hops FROM b UNION ALL SELECT *, 2 FROM two) GROUP BY ALL",
    "propagation_coverage": f"WITH RECURSIVE {COVERAGE} SELECT * FROM coverage",
    "rank_propagation": f"WITH RECURSIVE {COVERAGE}, {SCOMB[len(STEPS) + 1:].strip()} SELECT case_id, entity, coalesce(coverage, 0) AS coverage, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(coverage, 0) DESC, score DESC, rank) AS INTEGER) AS new_rank FROM scomb LEFT JOIN coverage USING (case_id, entity)",
    "tcec": f"""WITH {STEPS}, {SPANS},
cand AS (SELECT case_id, ts AS candidate_ts FROM (SELECT case_id, ts, count(*) FILTER (streak >= {K}) AS a FROM streaks GROUP BY ALL) WHERE a >= 3),
b AS (SELECT case_id, src, dst FROM edges UNION SELECT case_id, dst, src FROM edges),
pairs AS (SELECT i.case_id, i.start_ts AS ti, i.end_ts AS tei, j.start_ts AS tj FROM episodes i JOIN b ON b.case_id = i.case_id AND b.src = i.entity JOIN episodes j ON j.case_id = i.case_id AND j.entity = b.dst AND j.start_ts > i.start_ts)
SELECT c.case_id, c.candidate_ts, greatest(c.candidate_ts, min(tj)) AS confirmed_ts, min(tj) IS NOT NULL AS confirmed FROM cand c
LEFT JOIN pairs p ON p.case_id = c.case_id AND (ti >= candidate_ts OR (ti <= candidate_ts AND candidate_ts <= tei)) GROUP BY c.case_id, c.candidate_ts""".replace("greatest(c.candidate_ts, min(tj))", "CASE WHEN min(tj) IS NOT NULL THEN greatest(c.candidate_ts, min(tj)) END"),
    "edge_first_visible": f"WITH {METRICS}, {SPANS}, st AS (SELECT DISTINCT case_id, ts FROM metrics) SELECT st.case_id, st.ts, count(e.src) AS edges FROM st LEFT JOIN edges e ON e.case_id = st.case_id AND e.first_visible_us <= st.ts * 1000000 GROUP BY ALL",
    "incident_window_oracle": f"WITH {METRICS} SELECT case_id, CAST({CUTOFF} AS BIGINT) AS onset_ts, max(ts) AS end_ts, 'oracle' AS mode, true AS available FROM metrics GROUP BY case_id",
    "incident_window_detected": f"WITH {STEPS}, f AS (SELECT case_id, min(first_ts) AS onset_ts, FROM evidence GROUP BY ALL), l AS (SELECT case_id, max(ts) AS last_ts FROM metrics GROUP BY ALL) SELECT case_id, onset_ts, CASE WHEN onset_ts IS NOT NULL THEN last_ts END AS end_ts, 'detected' AS mode, onset_ts IS NOT NULL AS available FROM l LEFT JOIN f USING (case_id)",
}
