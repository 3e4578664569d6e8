"""Queries of consistency, shifts, snapshots and window recipes, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions import scalars
from lantern.operators import detect, ranking, scores
from lantern.plans import telemetry_queries as tq
from lantern.sources import telemetry
from lantern.sources.tables import table


def _mean(s, d, before: bool):  # noqa: ANN001, ANN202
    e = telemetry.spans(s, d)
    side = e.where((F.col("start_us") < tq.CUTOFF * 1_000_000) if before else (F.col("start_us") >= tq.CUTOFF * 1_000_000))
    return side.groupBy(F.concat_ws("/", "case_id", "service").alias("service")).agg(F.round(F.avg("duration_us") / 1e6, 3).alias("mean_s"))


def _onsets(s, d):  # noqa: ANN001, ANN202
    ev = detect.entity_evidence(tq.points(s, d))
    return ev.select("case_id", "entity", F.col("first_anomaly_ts").isNotNull().alias("has_episode"), F.col("first_anomaly_ts").alias("first_ts"))


def _rca(s, d, k):  # noqa: ANN001, ANN202
    return ranking.observational(tq.evidence(s, d), tq.edges(s, d), ranking.CONFIGURATIONS[k])


def _faults(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "rag2_query_split", ["scenario_family"]).groupBy(scalars.key_part(F.col("scenario_family"), 4).alias("fault")).agg(F.count("*").alias("n"))


def _hashes(s, d):  # noqa: ANN001, ANN202
    return table(s, d, "manifest_case", ["case_id"]).distinct().select("case_id", scalars.short_hash(F.col("case_id")).alias("h16"), scalars.short_hash(F.col("case_id"), 8).alias("h8"))


def _props(s, d):  # noqa: ANN001, ANN202
    k = scalars.json_number(scalars.reply_json(F.col("props")), "k")
    return table(s, d, "events", ["event_type", "props"]).groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k.isNull()).alias("missing"))


QUERIES = {
    "fault_categories": _faults,
    "short_hashes": _hashes,
    "json_numbers": _props,
    "earliness": lambda s, d: scores.earliness(tq.evidence(s, d)),
    "causal_consistency": lambda s, d: scores.consistency(_onsets(s, d), tq.edges(s, d), tq.elevation(s, d)),
    "rank_shifts": lambda s, d: scores.shifts(_rca(s, d, "a"), _rca(s, d, "d"), tq.edges(s, d)),
    "recovery_verdict": lambda s, d: scores.recovery(_mean(s, d, True), _mean(s, d, False), "service", "mean_s", 0.02),
    "sampled_series": lambda s, d: scores.sampled_series(tq.metrics(s, d)),
    "window_recipe": lambda s, d: scores.windows(tq.metrics(s, d), tq.CUTOFF, 100).groupBy("case_id", "metric", "side").agg(F.count("*").alias("rows"), F.count("value").alias("values"), F.round(F.sum("value"), 3).alias("total"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts")),
}

ORACLES = {
    "fault_categories": "SELECT nullif(lower(trim(split_part(scenario_family, '|', 4))), '') AS fault, count(*) AS n FROM rag2_query_split GROUP BY ALL",
    "short_hashes": "SELECT DISTINCT case_id, left(sha256(case_id), 16) AS h16, left(sha256(case_id), 8) AS h8 FROM manifest_case",
    "json_numbers": """SELECT event_type, sum(TRY_CAST(nullif(regexp_extract(props, '"k": *([0-9.]+)', 1), '') AS DOUBLE)) AS total, count(*) FILTER (nullif(regexp_extract(props, '"k": *([0-9.]+)', 1), '') IS NULL) AS missing FROM events GROUP BY ALL""",
    "earliness": f"WITH {tq.STEPS} SELECT case_id, entity, round(CASE WHEN first_ts IS NULL OR min(first_ts) OVER w = max(first_ts) OVER w THEN 0 ELSE 1 - (first_ts - min(first_ts) OVER w) / CAST(max(first_ts) OVER w - min(first_ts) OVER w AS DOUBLE) END, 9) AS earliness FROM evidence WINDOW w AS (PARTITION BY case_id)",
    "causal_consistency": f"""WITH {tq.POINTS}, {tq.LATENCY},
on1 AS (SELECT case_id, entity, min(ts) FILTER (is_anomaly) AS t FROM points GROUP BY ALL),
b AS (SELECT x.case_id, x.entity, x.t, min(o.t) AS t0, count(o.t) AS others FROM on1 x LEFT JOIN on1 o ON o.case_id = x.case_id AND o.entity <> x.entity GROUP BY ALL),
und AS (SELECT case_id, src, dst FROM edges UNION SELECT case_id, dst, src FROM edges),
near AS (SELECT case_id, src, dst FROM und UNION SELECT a.case_id, a.src, b.dst FROM und a JOIN und b ON a.case_id = b.case_id AND a.dst = b.src),
hit AS (SELECT DISTINCT n.case_id, n.src AS entity FROM near n JOIN on1 o ON o.case_id = n.case_id AND o.entity = n.dst AND o.t IS NOT NULL WHERE n.src <> n.dst),
slow AS (SELECT case_id, max(score) > 0.4 AS slow FROM elev GROUP BY ALL),
s AS (SELECT b.case_id, b.entity, CASE WHEN t IS NULL THEN 0.7 WHEN others = 0 THEN 0.9 WHEN t <= t0 THEN 1.0 WHEN t - t0 <= 15 THEN 0.85 ELSE 0.4 END::DOUBLE AS temporal,
  CASE WHEN others = 0 THEN 0.9 WHEN hit.entity IS NOT NULL THEN 1.0 ELSE 0.5 END::DOUBLE AS topology,
  CASE WHEN t IS NOT NULL AND coalesce(slow, false) THEN 1.0 WHEN t IS NOT NULL THEN 0.85 WHEN coalesce(slow, false) THEN 0.8 ELSE 0.5 END::DOUBLE AS propagation
  FROM b LEFT JOIN hit ON hit.case_id = b.case_id AND hit.entity = b.entity LEFT JOIN slow ON slow.case_id = b.case_id)
SELECT *, round(0.35 * temporal + 0.35 * topology + 0.30 * propagation, 9) AS score, round(0.35 * temporal + 0.35 * topology + 0.30 * propagation, 9) >= 0.65 AS passed FROM s""",
    "recovery_verdict": f"""WITH {tq.SPANS}, a AS (SELECT case_id || '/' || service AS service, round(avg(duration_us) / 1e6, 3) AS m FROM spans WHERE start_us < {tq.CUTOFF}000000 GROUP BY ALL), b AS (SELECT case_id || '/' || service AS service, round(avg(duration_us) / 1e6, 3) AS m FROM spans WHERE start_us >= {tq.CUTOFF}000000 GROUP BY ALL)
SELECT coalesce(a.service, b.service) AS service, a.m AS before, b.m AS after, CASE WHEN a.m IS NULL THEN 'appeared' WHEN b.m IS NULL THEN 'gone' WHEN b.m < a.m * 0.98 THEN 'recovered' WHEN b.m > a.m * 1.02 THEN 'worse' ELSE 'same' END AS verdict FROM a FULL OUTER JOIN b ON a.service = b.service""",
    "sampled_series": f"WITH {tq.METRICS} SELECT case_id, metric, obs_idx, value FROM metrics WHERE obs_idx % 15 = 0 AND obs_idx < 450",
    "window_recipe": f"""WITH {tq.METRICS}, f AS (SELECT case_id, metric, ts, obs_idx, last_value(value IGNORE NULLS) OVER (PARTITION BY case_id, metric ORDER BY obs_idx ROWS UNBOUNDED PRECEDING) AS value, CASE WHEN ts < {tq.CUTOFF} THEN 'normal' ELSE 'incident' END AS side FROM metrics),
n AS (SELECT *, CASE WHEN side = 'normal' THEN row_number() OVER (PARTITION BY case_id, metric, side ORDER BY obs_idx DESC) ELSE row_number() OVER (PARTITION BY case_id, metric, side ORDER BY obs_idx) END AS k FROM f)
SELECT case_id, metric, side, count(*) AS rows, count(value) AS "values", round(sum(value), 3) AS total, min(ts) AS from_ts, max(ts) AS to_ts FROM n WHERE k <= 100 GROUP BY ALL""",
}
_A, _D = tq.RCA.format(total="s1"), tq.RCA.format(total="s1 + s2 + s4")
ORACLES["rank_shifts"] = f"""SELECT a.case_id, a.entity, a.rank AS old_rank, b.rank AS new_rank, CASE WHEN b.rank < a.rank THEN 'promoted' WHEN b.rank > a.rank THEN 'demoted' ELSE 'same' END AS shift,
  EXISTS (SELECT 1 FROM (WITH {tq.SPANS} SELECT * FROM edges) s JOIN ({_D}) t ON t.case_id = s.case_id AND t.entity = s.src AND t.rank = 1 WHERE s.case_id = a.case_id AND s.dst = a.entity) AS downstream
FROM ({_A}) a JOIN ({_D}) b ON a.case_id = b.case_id AND a.entity = b.entity"""
