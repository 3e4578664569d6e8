"""Queries of residuals, change points, confirmation, fusion and streams, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import causal, evidence
from lantern.plans import telemetry_queries as tq
from lantern.sources.tables import table
from lantern.streaming import online


def profiles(s: SparkSession, d: str) -> DataFrame:
    cols = ["case_id", F.coalesce(F.nullif("entity", F.lit("")), F.nullif("service_id", F.lit(""))).alias("entity"), "ranker_score", "s_comb_score", "trace_elev_score", "causal_residual_z", "log_anomaly_score", "propagation_consistency", "scored_at"]
    m = table(s, d, "candidate_evidence_profile").groupBy("profile_id").agg(F.max(F.struct("ingested_at", *cols)).alias("m")).select("m.*")
    names = ["ranker_score", "s_comb_score", "trace_elev_score", "causal_residual_z", "log_anomaly_score", "propagation_consistency"]
    return m.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in names})


def fused(s: SparkSession, d: str) -> DataFrame:
    raw = profiles(s, d).select("case_id", "entity", F.col("s_comb_score").alias("metric"), F.col("trace_elev_score").alias("trace"), F.col("log_anomaly_score").alias("log"), F.lit(0.0).alias("topology"), F.lit(0.0).alias("change"), F.col("propagation_consistency").alias("consistency"), F.unix_seconds(F.col("scored_at").cast("timestamp")).alias("first_ts"))
    return evidence.fuse(raw)


def disambiguated(s: SparkSession, d: str) -> DataFrame:
    p = profiles(s, d).select("case_id", "entity", F.coalesce("ranker_score", F.lit(0.0)).alias("score"), F.col("trace_elev_score").alias("elevation"), F.col("causal_residual_z").alias("residual"))
    return evidence.disambiguate(p)


def rate(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events", ["event_id", "ts", "user_id"]).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return evidence.rate_limit(e, "user_id", "us", 86_400, 3).select("event_id", "recent", "allowed")


QUERIES = {
    "entity_signals": lambda s, d: causal.entity_signals(tq.metrics(s, d), tq.CUTOFF).withColumn("signal", F.round("signal", 6)),
    "ridge_residuals": lambda s, d: causal.ridge_residuals(tq.metrics(s, d), tq.edges(s, d), tq.CUTOFF),
    "crv_relief": lambda s, d: causal.counterfactual_relief(tq.metrics(s, d), tq.edges(s, d), tq.CUTOFF, "error"),
    "bocpd": lambda s, d: causal.bocpd_onsets(tq.metrics(s, d)),
    "sequential_tcec": lambda s, d: causal.sequential_confirmation(tq.steps(s, d), tq.edges(s, d), 7200),
    "evidence_fusion": fused,
    "disambiguate": disambiguated,
    "rate_limit": rate,
    **online.RUNS,
}

_SIGNALS = tq.METRICS + f""",
base AS (SELECT case_id, metric, avg(value) AS mu, CASE WHEN coalesce(stddev_pop(value), 0) < 1e-6 THEN 1 ELSE stddev_pop(value) END AS sd FROM metrics WHERE ts < {tq.CUTOFF} GROUP BY ALL),
std AS (SELECT m.case_id, m.entity, m.metric, m.ts, coalesce((value - mu) / sd, 0) AS y FROM metrics m LEFT JOIN base USING (case_id, metric)),
sig AS (SELECT case_id, ts, entity, avg(y) AS signal FROM std GROUP BY ALL)"""

_PROFILES = """
prof AS (SELECT case_id, coalesce(nullif(entity, ''), nullif(service_id, '')) AS entity, scored_at,
  """ + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in ("ranker_score", "s_comb_score", "trace_elev_score", "causal_residual_z", "log_anomaly_score", "propagation_consistency")) + """
  FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY ingested_at DESC) AS rn FROM candidate_evidence_profile) WHERE rn = 1)"""

_WINDOWED = "SELECT CAST(epoch({start}) AS BIGINT) AS start_ts, event_type, count(*) AS n, round(sum(value), 6) AS total FROM {source} GROUP BY ALL"

ORACLES = {
    "entity_signals": f"WITH {_SIGNALS} SELECT case_id, ts, entity, round(signal, 6) AS signal FROM sig",
    "ridge_residuals": f"""WITH {_SIGNALS}, {tq.SPANS},
par AS (SELECT s.case_id, e.dst AS entity, s.ts, avg(signal) AS x FROM sig s JOIN edges e ON e.case_id = s.case_id AND e.src = s.entity GROUP BY ALL),
xy AS (SELECT std.*, coalesce(x, 0) AS x FROM std LEFT JOIN par USING (case_id, entity, ts)),
sums AS (SELECT case_id, metric, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM xy WHERE ts < {tq.CUTOFF} GROUP BY ALL),
res AS (SELECT xy.*, y - (sy / n + (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) * (x - sx / n)) AS r FROM xy JOIN sums USING (case_id, metric)),
dev AS (SELECT case_id, metric, coalesce(stddev_pop(r), 0) AS s FROM res WHERE ts < {tq.CUTOFF} GROUP BY ALL),
z AS (SELECT res.*, abs(r) / (s + 1e-6) AS z, max(ts) OVER (PARTITION BY case_id) AS last FROM res JOIN dev USING (case_id, metric))
SELECT case_id, entity, round(avg(z), 6) AS mean_z, round(max(z), 6) AS max_z, round(coalesce(sum(CASE WHEN ts < {tq.CUTOFF} + (last - {tq.CUTOFF}) * 0.4 THEN z ELSE 0 END) / nullif(sum(z), 0), 0), 6) AS early_share FROM z WHERE ts >= {tq.CUTOFF} GROUP BY ALL""",
    "evidence_fusion": f"""WITH {_PROFILES},
v AS (SELECT case_id, entity, coalesce(s_comb_score, 0) AS m, coalesce(trace_elev_score, 0) AS t, ln(1 + coalesce(log_anomaly_score, 0)) AS l, coalesce(propagation_consistency, 1) AS cc, epoch(scored_at) AS ts FROM prof),
n AS (SELECT *, 0.30 * coalesce(CASE WHEN max(m) OVER w > 0 THEN m / max(m) OVER w END, 0) + 0.30 * coalesce(CASE WHEN max(t) OVER w > 0 THEN t / max(t) OVER w END, 0) + 0.10 * coalesce(CASE WHEN max(l) OVER w > 0 THEN l / max(l) OVER w END, 0)
   + 0.10 * coalesce(greatest(0, 1 - (CAST(floor(ts) AS BIGINT) - CAST(min(floor(ts)) OVER w AS BIGINT)) / 300.0), 0) AS ev FROM v WINDOW w AS (PARTITION BY case_id)),
c AS (SELECT case_id, entity, round(ev, 9) AS evidence, round(ev * (0.4 + 0.6 * greatest(0, least(1, cc))), 9) AS composite FROM n),
r AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, round(greatest(0, least(1, (composite - coalesce(lead(composite) OVER w, 0)) / greatest(composite, 1e-6))), 6) AS margin FROM c WINDOW w AS (PARTITION BY case_id ORDER BY composite DESC, entity))
SELECT *, round(least(0.99, greatest(0.05, composite * (0.75 + 0.25 * margin))), 6) AS confidence FROM r""",
    "disambiguate": f"""WITH {_PROFILES},
v AS (SELECT case_id, entity, coalesce(ranker_score, 0) AS s, round(0.4 * coalesce(ranker_score, 0) + 0.3 * least(1, coalesce(trace_elev_score, 0)) + 0.3 * least(1, coalesce(causal_residual_z, 0) / 5), 9) AS c FROM prof),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY s DESC, entity) AS k FROM v),
g AS (SELECT case_id, max(entity) FILTER (k = 1) AS e1, max(entity) FILTER (k = 2) AS e2, max(entity) FILTER (k = 3) AS e3, max(c) FILTER (k = 1) AS c1, max(c) FILTER (k = 2) AS c2, max(c) FILTER (k = 3) AS c3, max(s) FILTER (k = 1) AS s1, max(s) FILTER (k = 2) AS s2 FROM r GROUP BY ALL),
h AS (SELECT *, CASE WHEN c2 > c1 * 1.05 THEN e2 ELSE e1 END AS b2, CASE WHEN c2 > c1 * 1.05 THEN c2 ELSE c1 END AS bc, CASE WHEN e2 IS NULL THEN 1 ELSE s1 - s2 END AS margin FROM g),
i AS (SELECT *, CASE WHEN margin < 0.15 THEN CASE WHEN c3 > bc * 1.05 THEN e3 ELSE b2 END ELSE e1 END AS chosen FROM h)
SELECT case_id, e1 AS first, chosen, round(margin, 9) AS margin, chosen <> e1 AS switched FROM i""",
    "rate_limit": "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 3 AS allowed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)",
    # A window comes out when the watermark, two hours behind the last event, has passed its end.
    "stream_tumbling": "SELECT * FROM (" + _WINDOWED.format(start="date_trunc('hour', ts)", source="events") + ") WHERE start_ts + 3600 <= (SELECT epoch(max(ts)) - 7200 FROM events)",
    "stream_sliding": "SELECT * FROM (" + _WINDOWED.format(start="st", source="(SELECT *, date_trunc('hour', ts) - unnest([INTERVAL 0 HOUR, INTERVAL 1 HOUR]) AS st FROM events)") + ") WHERE start_ts + 7200 <= (SELECT epoch(max(ts)) - 14400 FROM events)",
    "stream_join": "SELECT o_orderkey AS key, count(*) AS n, CAST(epoch(max(l_shipdate)) AS BIGINT) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY ALL",
    "stream_session": "SELECT user_id, min(us) AS start_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS g FROM (SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, g",
    "stream_dedup": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_zscore": "SELECT event_type, event_id, round((value - mu) / (sd + 1e-6), 6) AS z FROM (SELECT *, avg(value) OVER w AS mu, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) WHERE n = 24",
}
