"""Queries of preparation, alerts, availability, splits, verification and query texts, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.operators import causal, evaluation, evidence, logs, prepare, ranking, retrieval, scores
from lantern.operators.graph import metric_name
from lantern.plans import causal_queries as cq
from lantern.plans import evaluation_queries as eq
from lantern.plans import retrieval_queries as rq
from lantern.plans import telemetry_queries as tq
from lantern.sources import telemetry
from lantern.sources.tables import table

WIDE = ["caller_p10", "caller_p90", "callee_p90", "return_lag_p90"]
ALIASES = {"frontendservice": "frontend", "hx-visit2-service": "hx-visit-service"}
MIDDLE = "2025-02-17"


def unpivoted(s: SparkSession, d: str) -> DataFrame:
    """Rows, values and their largest of each metric of the wide attribution table, named by entity and signal."""
    long = prepare.unpivot(table(s, d, "edge_attribution", ["attribution_id", *WIDE]), ["attribution_id"])
    entity, signal = metric_name(F.col("metric"))
    named = long.select(entity.alias("entity"), signal.alias("signal"), F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    return named.groupBy("entity", "signal").agg(F.count("*").alias("rows"), F.count("value").alias("values"), F.max("value").alias("largest"))


def aliases(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "edge_attribution", ["caller_service"]).groupBy(prepare.aliased(F.col("caller_service"), ALIASES).alias("service")).agg(F.count("*").alias("n"))


def datasets(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "manifest_case", ["suite", "dataset", "system"])
    of = lambda t: F.count_if(prepare.of_dataset(t, ["RX1", "RX2"], F.col("suite"), F.col("dataset"), F.col("system")))
    return m.groupBy("dataset").agg(of("RX1").alias("in_rx1"), of("RX1-HX").alias("in_rx1_hx"), of("rx1-fm").alias("in_rx1_fm"), of("other").alias("in_other"))


def event_logs(s: SparkSession, d: str) -> DataFrame:
    """(case_id, container, timestamp, message): every event as a line of the log of its type."""
    e = table(s, d, "events", ["ts", "user_id", "event_type", "props"])
    return e.select(telemetry.case_of(F.col("user_id")).alias("case_id"), F.col("event_type").alias("container"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"), F.concat_ws(" ", "event_type", "props").alias("message"))


def alerted(s: SparkSession, d: str) -> DataFrame:
    return ranking.alerts(tq.metrics(s, d), telemetry.spans(s, d), event_logs(s, d), tq.universe(s, d), tq.CUTOFF, tq.CUTOFF + 86_400, logs.ERROR)


def residual_rank(s: SparkSession, d: str) -> DataFrame:
    """Largest standardised residual given the callers, over the universe."""
    return ranking.by_score(tq.universe(s, d), causal.ridge_residuals(tq.metrics(s, d), tq.edges(s, d), tq.CUTOFF), "max_z")


def relief_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.rerank_head(tq.s_comb(s, d), causal.counterfactual_relief(tq.metrics(s, d), tq.edges(s, d), tq.CUTOFF, "error"), 3)


def asked(s: SparkSession, d: str) -> DataFrame:
    """The next query of every case, where the spans of the likely candidates were already asked for."""
    p = cq.profiles(s, d).select("case_id", F.col("entity").alias("service"), F.round(F.coalesce("ranker_score", F.lit(0.0)), 2).alias("priority")).where("service is not null")
    best = p.groupBy("case_id", "service").agg(F.max("priority").alias("priority"))
    tools = best.withColumn("tool", F.explode(F.array(*map(F.lit, ranking.COSTS))))
    spent = best.where("priority >= 0.9").select("case_id", "service", F.lit("traces").alias("tool"))
    return ranking.next_query(tools, spent, 8)


def results(s: SparkSession, d: str) -> DataFrame:
    """What the rankings tell of an intervention on the first entity: the places stand for queries and outcomes."""
    m = eq.metrics(s, d)
    return m.select("method", "top_1", F.when(F.col("first").isNull(), "FAILED").otherwise("SUCCESS").alias("status"), (F.col("first") > 8).alias("abstained"), (F.col("reciprocal_rank") >= 0.5).alias("authorized"), (F.col("first") == 1).alias("recovered"), (F.col("first") == 2).alias("regressed"), F.col("first").alias("queries"), F.col("reciprocal_rank").alias("runtime"))


def available(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(0).cast("bigint")
    of = lambda name, *cols: table(s, d, name, ["case_id"]).where("case_id is not null").groupBy("case_id").agg(*cols)
    n = F.count("*")
    m = of("candidate_evidence_profile", n.alias("n_metrics"), none.alias("n_logs"), none.alias("n_traces"))
    lo = of("documents", none.alias("n_metrics"), n.alias("n_logs"), none.alias("n_traces"))
    t = of("edge_attribution", none.alias("n_metrics"), none.alias("n_logs"), n.alias("n_traces"))
    every = m.unionByName(lo).unionByName(t).withColumns({"has_logs": F.lit(None).cast("boolean"), "has_traces": F.lit(None).cast("boolean")})
    return evaluation.availability(table(s, d, "manifest_case", ["case_id"]), every)


def compared(s: SparkSession, d: str) -> DataFrame:
    """The comparison of two methods; of its drawn figures only what holds for any draw."""
    c = evaluation.compare(eq.paired(s, d, "top_1"), eq.family(s, d))
    sound = (F.col("low") <= F.col("high")) & (F.col("p_value") > 0) & (F.col("p_value") <= 1)
    return c.withColumn("sound", sound).withColumn("difference", F.round("difference", 9)).drop("low", "high", "p_value")


def split(s: SparkSession, d: str) -> DataFrame:
    return evaluation.leak_free_split(eq.cases(s, d), ["suite", "system", "entity", "fault"])


def floors(s: SparkSession, d: str) -> DataFrame:
    r = eq.rankings(s, d).select("method", "score")
    at = lambda q: evaluation.floor_percentile(r, ["method"], "score", q).withColumn("q", F.lit(q))
    return at(0.95).unionByName(at(0.5))


def snapshot(s: SparkSession, d: str, before: bool) -> DataFrame:
    e = table(s, d, "edge_attribution", ["case_id", "caller_service", "elevation", "caller_p90", "is_return_lag_dominant", "observed_at"])
    e = e.where((F.col("observed_at") < F.lit(MIDDLE).cast("timestamp_ntz")) if before else (F.col("observed_at") >= F.lit(MIDDLE).cast("timestamp_ntz")))
    ok = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")), F.col(c))
    return e.groupBy("case_id", F.col("caller_service").alias("service")).agg(F.round(F.avg(ok("elevation")), 4).alias("anomaly_score"), F.round(F.max(ok("caller_p90")), 4).alias("latency_p90"), F.count_if("is_return_lag_dominant").cast("double").alias("error_rate"))


def verified(s: SparkSession, d: str) -> DataFrame:
    return scores.verify_recovery(snapshot(s, d, True), snapshot(s, d, False), eq.cases(s, d).select("case_id", F.col("entity").alias("target")))


def incidents(s: SparkSession, d: str) -> DataFrame:
    """The three texts of every profile that has a name."""
    cols = ["entity", "anomalous_metrics", "novel_log_templates"]
    p = table(s, d, "candidate_evidence_profile", ["profile_id", *cols]).where("coalesce(entity, '') <> ''").distinct()
    once = prepare.ordered_unique(p, ["profile_id"], cols)
    named = once.select(F.col("profile_id").alias("case_id"), F.lit(None).cast("string").alias("system"), F.array("entity").alias("services"), F.col("anomalous_metrics").alias("metrics"), F.array().cast("array<string>").alias("calls"), F.col("novel_log_templates").alias("logs"))
    return retrieval.incident_queries(named).withColumnRenamed("case_id", "profile_id")


def prefixes(s: SparkSession, d: str) -> DataFrame:
    p = tq.points(s, d).select("case_id", "metric", "obs_idx", "ts", "is_anomaly").join(tq.metrics(s, d).select("case_id", "metric", "obs_idx", "value"), ["case_id", "metric", "obs_idx"])
    return prepare.leak_free(retrieval.prefix_queries(p, event_logs(s, d), telemetry.spans(s, d), retrieval.PREFIX_ERROR), "query")


def sample(s: SparkSession, d: str) -> DataFrame:
    q = rq.docs(s, d).where("doc % 100 = 0").select(F.col("doc").alias("query"), F.col("category").alias("stratum"))
    # All documents are ranked, but only for the queries that are drawn.
    asked = rq.queries(s, d).join(evaluation.first_of_stratum(q, "stratum").select("query"), "query", "left_semi")
    return evaluation.annotation_sample(q, retrieval.bm25(rq.docs(s, d), asked), "stratum")


def regraded(s: SparkSession, d: str) -> DataFrame:
    """The relevance table under names of an annotation pool, each document twice, and back."""
    rel = rq.relevance(s, d).select("query", "doc", "grade")
    pool = F.inline(F.array(F.struct(F.concat(F.lit("a"), "doc").alias("pool_doc"), F.col("grade").alias("g")), F.struct(F.concat(F.lit("b"), "doc").alias("pool_doc"), (F.col("grade") - 1).alias("g"))))
    notes = rel.select(F.concat(F.lit("q"), "query").alias("pool_query"), pool).withColumnRenamed("g", "grade")
    names = rel.select(F.concat(F.lit("q"), "query").alias("pool_query"), "query").distinct()
    own = rel.select("doc").distinct().select(F.explode(F.array(F.concat(F.lit("a"), "doc"), F.concat(F.lit("b"), "doc"))).alias("pool_doc"), "doc")
    return evaluation.graded(notes, names, own)


def observed(s: SparkSession, d: str) -> DataFrame:
    """The place of every order among those of its customer, by day and number."""
    o = table(s, d, "orders", ["o_custkey", "o_orderdate", "o_orderkey"])
    return prepare.ordered_index(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "obs_idx")


def texts(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "candidate_evidence_profile", ["profile_id", "entity", "anomalous_metrics", "novel_log_templates"])
    return prepare.query_text(p, "profile_id", ["entity", "anomalous_metrics", "novel_log_templates"]).distinct()


def told(s: SparkSession, d: str) -> DataFrame:
    return evidence.tool_evidence(tq.universe(s, d), tq.evidence(s, d), tq.elevation(s, d), event_logs(s, d), tq.edges(s, d), logs.ERROR)


def leaks(s: SparkSession, d: str) -> DataFrame:
    """Scenario families whose cases are listed in more than one partition."""
    cols = ["dataset", "system", "fault", "root_cause_service", "suite", "partition"]
    m = table(s, d, "manifest_case", ["case_id", "listed_at", *cols]).groupBy("case_id").agg(F.max(F.struct("listed_at", *cols)).alias("m")).select("case_id", eq.label(F.col("m.partition")).alias("partition"))
    family = eq.cases(s, d).where("entity is not null").select("case_id", "family")
    return evaluation.leaked(m.join(family, "case_id"), "family", "partition").withColumn("partitions", F.array_join("partitions", ","))


QUERIES = {
    "tool_evidence": told,
    "family_leakage": leaks,
    "metrics_unpivot": unpivoted,
    "service_alias": aliases,
    "dataset_filter": datasets,
    "change_lines": lambda s, d: telemetry.logs(s, d).groupBy("container").agg(F.count_if(prepare.is_change(F.col("message"))).alias("changes")),
    "first_listing": lambda s, d: prepare.ordered_unique(table(s, d, "manifest_case", ["case_id", "listed_at", "dataset", "system"]), ["case_id"], ["listed_at", "dataset", "system"]),
    "prohibited_tokens": lambda s, d: table(s, d, "documents", ["text"]).select(F.explode(prepare.violations(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
    "query_text": texts,
    "observation_index": observed,
    "rank_simple_rca": alerted,
    "rank_hypothesis": residual_rank,
    "rank_crv": relief_rank,
    "next_query": asked,
    "outcome_rates": lambda s, d: evaluation.outcome_rates(results(s, d)),
    "modality_availability": available,
    "paired_comparison": compared,
    "leak_free_split": split,
    "floor_percentiles": floors,
    "recovery_verified": verified,
    "incident_queries": incidents,
    "prefix_queries": prefixes,
    "annotation_sample": sample,
    "annotation_grades": regraded,
}

_LOGS = """
lines AS (SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS case_id, event_type AS container, CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS t, event_type || ' ' || props AS message FROM events)"""

_CATEGORY = "CASE WHEN contains({x}, 'cpu') THEN 'cpu' WHEN regexp_matches({x}, 'mem|memory|oom') THEN 'memory' WHEN regexp_matches({x}, 'disk|storage') THEN 'disk' WHEN regexp_matches({x}, 'delay|latency|timeout|loss|socket') THEN 'networking' WHEN regexp_matches({x}, 'grpc|status') THEN 'grpc' ELSE 'service-health' END"

_ONCE = "(SELECT DISTINCT ON (profile_id) profile_id, entity, anomalous_metrics AS ms, novel_log_templates AS ls FROM candidate_evidence_profile WHERE coalesce(entity, '') <> '' ORDER BY profile_id, entity, anomalous_metrics NULLS FIRST, novel_log_templates NULLS FIRST)"


def _snap(op: str) -> str:
    ok = lambda c: f"CASE WHEN {c} >= 0 AND isfinite({c}) THEN {c} END"
    return f"SELECT case_id, caller_service AS service, coalesce(round(avg({ok('elevation')}), 4), 0) AS a, coalesce(round(max({ok('caller_p90')}), 4), 0) AS l, CAST(count(*) FILTER (is_return_lag_dominant) AS DOUBLE) AS e, round(avg({ok('elevation')}), 4) IS NOT NULL AS seen FROM edge_attribution WHERE observed_at {op} TIMESTAMP '{MIDDLE}' GROUP BY ALL"


ORACLES = {
    "metrics_unpivot": "SELECT split_part(metric, '_', 1) AS entity, regexp_extract(metric, '^[^_]*_(.*)$', 1) AS signal, count(*) AS rows, count(v) AS \"values\", max(v) AS largest FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS metric, CASE WHEN NOT isnan({c}) THEN {c} END AS v FROM edge_attribution" for c in WIDE) + ") GROUP BY ALL",
    "service_alias": "SELECT CASE caller_service " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE caller_service END AS service, count(*) AS n FROM edge_attribution GROUP BY ALL",
    "dataset_filter": "SELECT dataset, count(*) FILTER (suite = 'RX1' OR starts_with(dataset, 'RX1')) AS in_rx1, count(*) FILTER (dataset = 'RX1-HX' OR (suite = 'RX1' AND lower(system) = 'hx')) AS in_rx1_hx, count(*) FILTER (dataset = 'RX1-FM' OR (suite = 'RX1' AND lower(system) = 'fm')) AS in_rx1_fm, count(*) FILTER (upper(dataset) = 'OTHER') AS in_other FROM manifest_case GROUP BY ALL",
    "change_lines": "SELECT lower(trim(source)) AS container, count(*) FILTER (regexp_matches(lower(text), 'deploy|restarting|configuration changed|started container')) AS changes FROM documents GROUP BY ALL",
    "first_listing": "SELECT case_id, listed_at, dataset, system FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY listed_at NULLS FIRST, dataset NULLS FIRST, system NULLS FIRST) AS r FROM manifest_case) WHERE r = 1",
    "prohibited_tokens": "SELECT token, count(*) AS n FROM documents, (SELECT unnest([" + ", ".join(f"'{t}'" for t in prepare.PROHIBITED) + "]) AS token) WHERE contains(lower(text), token) GROUP BY ALL",
    "query_text": "SELECT DISTINCT profile_id, array_to_string(list_filter(list_concat([entity], anomalous_metrics, novel_log_templates), lambda x: trim(coalesce(x, '')) <> ''), ' ') AS query FROM candidate_evidence_profile",
    "observation_index": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS obs_idx FROM orders",
    "rank_simple_rca": f"""WITH {tq.METRICS}, {tq.SPANS}, {_LOGS},
per AS (SELECT case_id, entity, metric, avg(value) FILTER (ts < {tq.CUTOFF}) AS mu, stddev_pop(value) FILTER (ts < {tq.CUTOFF}) AS sd, max(value) FILTER (ts BETWEEN {tq.CUTOFF} AND {tq.CUTOFF + 86400}) AS top FROM metrics GROUP BY ALL),
p AS (SELECT case_id, service AS entity, quantile_cont(CAST(duration_us AS DOUBLE), 0.95) FILTER (start_us < {tq.CUTOFF}000000) AS a, quantile_cont(CAST(duration_us AS DOUBLE), 0.95) FILTER (start_us BETWEEN {tq.CUTOFF}000000 AND {tq.CUTOFF + 86400}000000) AS b FROM spans GROUP BY ALL),
al AS (SELECT case_id, entity, count(*) AS n FROM per WHERE top > mu + 3 * greatest(sd, 1e-6) GROUP BY ALL
  UNION ALL SELECT case_id, entity, 1 FROM p WHERE b > 0 AND b >= 3 * greatest(coalesce(a, 0), 1e-3)
  UNION ALL SELECT case_id, container, count(*) FROM lines WHERE t BETWEEN {tq.CUTOFF} AND {tq.CUTOFF + 86400} AND regexp_matches(message, '(?i)\\b(error|exception|fail|failed|failure|fatal|timeout|refused|oom|panic|50[0-9]|unavailable)\\b') GROUP BY ALL),
t AS (SELECT case_id, entity, CAST(sum(n) AS DOUBLE) AS score FROM al GROUP BY ALL), u AS (SELECT DISTINCT case_id, service AS entity FROM spans)
SELECT case_id, entity, coalesce(score, 0) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY coalesce(score, 0) DESC, entity) AS INTEGER) AS rank FROM u LEFT JOIN t USING (case_id, entity)""",
    "tool_evidence": f"""WITH {tq.STEPS}, {tq.LATENCY}, {_LOGS},
said AS (SELECT case_id, container AS entity, count(*) FILTER (regexp_matches(message, '(?i)\\b(error|exception|fail|failed|failure|fatal|timeout|refused|oom|panic|50[0-9]|unavailable)\\b')) AS l, count(*) FILTER (regexp_matches(lower(message), 'deploy|restarting|configuration changed|started container')) AS c FROM lines GROUP BY ALL),
near AS (SELECT case_id, e AS entity, count(DISTINCT o) AS n FROM (SELECT case_id, src AS e, dst AS o FROM edges UNION ALL SELECT case_id, dst, src FROM edges) WHERE e <> o GROUP BY ALL),
f AS (SELECT u.case_id, u.entity, coalesce(peak_active, 0) AS m, coalesce(score, 0) AS t, coalesce(l, 0) AS l, coalesce(n, 0) AS n, coalesce(has_episode, false)::INT AS h, coalesce(c, 0) AS c FROM uni u LEFT JOIN evidence USING (case_id, entity) LEFT JOIN elev USING (case_id, entity) LEFT JOIN said USING (case_id, entity) LEFT JOIN near USING (case_id, entity))
SELECT case_id, entity, unnest(['metrics', 'traces', 'logs', 'neighbours', 'health', 'change']) AS tool, unnest([1, 3, 2, 1, 1, 2]) AS cost, unnest([m::DOUBLE, t::DOUBLE, l::DOUBLE, n::DOUBLE, h::DOUBLE, c::DOUBLE]) AS value FROM f""",
    "family_leakage": f"""WITH {eq.EVAL}, p AS (SELECT case_id, nullif(regexp_replace(regexp_replace(lower(partition), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '') AS part FROM listed)
SELECT family, string_agg(DISTINCT part, ',' ORDER BY part) AS partitions, count(*) AS cases FROM p JOIN cases USING (case_id) WHERE entity IS NOT NULL AND part IS NOT NULL GROUP BY family HAVING count(DISTINCT part) > 1""",
    "rank_hypothesis": f"SELECT case_id, entity, score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY score DESC, entity) AS INTEGER) AS rank FROM (SELECT u.case_id, u.entity, coalesce(z.max_z, 0) AS score FROM (WITH {tq.SPANS} SELECT DISTINCT case_id, service AS entity FROM spans) u LEFT JOIN ({cq.ORACLES['ridge_residuals']}) z USING (case_id, entity))",
    "next_query": f"""WITH {cq._PROFILES}, best AS (SELECT case_id, entity AS service, max(round(coalesce(ranker_score, 0), 2)) AS priority FROM prof WHERE entity IS NOT NULL GROUP BY ALL),
tools AS (SELECT unnest(['metrics', 'traces', 'logs', 'neighbours', 'health', 'change']) AS tool, unnest([1, 3, 2, 1, 1, 2]) AS cost),
paid AS (SELECT case_id, 3 * count(*) AS paid FROM best WHERE priority >= 0.9 GROUP BY ALL),
c AS (SELECT case_id, service, tool, priority, cost FROM best CROSS JOIN tools LEFT JOIN paid USING (case_id) WHERE NOT (tool = 'traces' AND priority >= 0.9) AND cost <= 8 - coalesce(paid, 0))
SELECT case_id, service, tool, priority, cost FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, cost DESC, service, tool) AS r FROM c) WHERE r = 1""",
    "outcome_rates": f"""WITH {eq.EVAL}, r AS (SELECT *, first IS NOT NULL AS ok, reciprocal_rank >= 0.5 AS auth FROM metrics)
SELECT method, count(*) AS cases, count(*) FILTER (ok) AS evaluated, round(count(*) FILTER (NOT ok OR coalesce(first > 8, false)) / CAST(count(*) AS DOUBLE), 9) AS abstention_rate,
  round(count(*) FILTER (auth AND top_1 = 0) / CAST(nullif(count(*) FILTER (auth), 0) AS DOUBLE), 9) AS false_remediation_rate, round(count(*) FILTER (auth AND first = 1) / CAST(nullif(count(*) FILTER (auth), 0) AS DOUBLE), 9) AS recovery_rate,
  round(count(*) FILTER (auth AND first = 2) / CAST(nullif(count(*) FILTER (auth), 0) AS DOUBLE), 9) AS regression_rate, round(count(*) FILTER (ok AND top_1 = 1) / CAST(nullif(sum(coalesce(first, 0)), 0) AS DOUBLE), 9) AS query_efficiency, round(avg(CASE WHEN ok THEN reciprocal_rank END), 9) AS mean_runtime FROM r GROUP BY ALL""",
    "modality_availability": """WITH c AS (SELECT DISTINCT case_id FROM manifest_case), f AS (SELECT coalesce(case_id IN (SELECT case_id FROM candidate_evidence_profile WHERE case_id IS NOT NULL), false) AS m, coalesce(case_id IN (SELECT case_id FROM documents WHERE case_id IS NOT NULL), false) AS l, coalesce(case_id IN (SELECT case_id FROM edge_attribution WHERE case_id IS NOT NULL), false) AS t FROM c)
SELECT count(*) AS cases, count(*) FILTER (m) AS metrics, count(*) FILTER (l) AS logs, count(*) FILTER (t) AS traces, count(*) FILTER (m AND l AND t) AS all_three, count(*) FILTER (NOT m) AS no_metrics, count(*) FILTER (NOT l) AS no_logs, count(*) FILTER (NOT t) AS no_traces FROM f""",
    "paired_comparison": f"""WITH {eq.EVAL}, z AS (SELECT family, count(*) AS n FROM paired JOIN cases USING (case_id) GROUP BY ALL), y AS (SELECT CAST(sum(n) AS BIGINT) AS executions, count(*) AS families, min(n) AS least_repetitions, max(n) AS most_repetitions, round(avg(n), 4) AS mean_repetitions FROM z),
x AS (SELECT round(avg(ta - tb), 9) AS difference, round(avg(ta), 6) AS a_mean, round(avg(tb), 6) AS b_mean, count(*) FILTER (ta = 1 AND tb = 0) AS n10, count(*) FILTER (ta = 0 AND tb = 1) AS n01, count(*) FILTER (ta = 1 AND tb = 1) AS n11, count(*) FILTER (ta = 0 AND tb = 0) AS n00,
  {', '.join(f"round(quantile_cont(CAST(t{c} AS DOUBLE), 0.25), 9) AS {c}_q1, round(quantile_cont(CAST(t{c} AS DOUBLE), 0.5), 9) AS {c}_median, round(quantile_cont(CAST(t{c} AS DOUBLE), 0.75), 9) AS {c}_q3, round(quantile_cont(CAST(t{c} AS DOUBLE), 0.75) - quantile_cont(CAST(t{c} AS DOUBLE), 0.25), 9) AS {c}_iqr" for c in 'ab')} FROM paired)
SELECT *, true AS sound FROM y, x""",
    "leak_free_split": f"""WITH {eq.EVAL}, f AS (SELECT case_id, concat_ws('|', coalesce(suite, ''), coalesce(system, ''), coalesce(entity, ''), coalesce(fault, '')) AS k FROM cases0), g AS (SELECT k, row_number() OVER (ORDER BY md5('42:' || k), k) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT k FROM f))
SELECT case_id, CASE WHEN i <= round_even(n * 0.5, 0) THEN 'dev' WHEN i <= round_even(n * 0.5, 0) + round_even(n * 0.25, 0) THEN 'val' ELSE 'held_out' END AS partition FROM f JOIN g USING (k)""",
    "floor_percentiles": f"WITH {eq.EVAL}, o AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score) AS i, count(*) OVER (PARTITION BY method) AS n FROM rankings), q AS (SELECT unnest([0.95::DOUBLE, 0.5::DOUBLE]) AS q) SELECT method, n, score, q FROM o, q WHERE i = least(floor(n * q) + 1, n)",
    "recovery_verified": f"""WITH {eq.EVAL}, b AS ({_snap('<')}), a AS ({_snap('>=')}),
j AS (SELECT coalesce(b.case_id, a.case_id) AS case_id, coalesce(b.service, a.service) AS service, coalesce(b.a, 0) AS b0, coalesce(b.l, 0) AS b1, coalesce(b.e, 0) AS b2, coalesce(a.a, 0) AS a0, coalesce(a.l, 0) AS a1, coalesce(a.e, 0) AS a2, coalesce(b.seen, false) AS seen FROM b FULL OUTER JOIN a ON b.case_id = a.case_id AND b.service = a.service),
k AS (SELECT j.*, coalesce(c.entity, '') AS target, b0 > 0.2 AND (a0 <= 0.2 OR (b0 - a0) / b0 >= 0.65) AS healed FROM j LEFT JOIN cases0 c USING (case_id)),
e AS (SELECT *, healed::INT + (b1 > 100 AND a1 <= 100)::INT + (b2 > 0 AND a2 = 0)::INT AS rec, (b0 > 0.2 AND NOT healed)::INT + (b1 > 100 AND a1 > 100)::INT AS lft, (b0 <= 0.2 AND a0 > 0.4)::INT + (a2 > b2 AND a2 > 5)::INT AS worse, target <> '' AND contains(service, target) AS own FROM k),
g AS (SELECT case_id, sum(rec)::BIGINT AS recovered, sum(lft)::BIGINT AS unresolved, sum(worse)::BIGINT AS regressions, coalesce(sum(rec) FILTER (own), 0) AS own_rec, coalesce(sum(rec) FILTER (NOT own), 0) AS far_rec, coalesce(sum(lft) FILTER (NOT own), 0) AS far_left, bool_or((b0 > 0.2 OR b1 > 100 OR b2 > 0) AND service <> target) AS far_sick, bool_or(seen) AS seen, max(target) AS target FROM e GROUP BY ALL),
s AS (SELECT *, CASE WHEN regressions > 0 OR (unresolved > 0 AND target <> '' AND own_rec = 0) THEN 'NOT_RESOLVED' WHEN unresolved > 0 THEN 'UNCERTAIN' WHEN recovered > 0 OR NOT seen THEN 'RESOLVED' ELSE 'UNCERTAIN' END AS status FROM g)
SELECT case_id, recovered, unresolved, regressions, status, CASE WHEN regressions > 0 OR (status = 'NOT_RESOLVED' AND own_rec = 0) THEN 'CONTRADICTS' WHEN status = 'RESOLVED' AND ((far_left = 0 AND (NOT far_sick OR far_rec > 0 OR status = 'RESOLVED')) OR NOT far_sick) THEN 'SUPPORTS' ELSE 'INCONCLUSIVE' END AS support FROM s""",
    "incident_queries": f"""WITH o AS {_ONCE}, t AS (SELECT profile_id, entity, coalesce(ms, []) AS ms, coalesce(ls, []) AS ls FROM o),
x AS (SELECT *, {_CATEGORY.format(x="lower(concat_ws(' ', array_to_string(ms, ' '), array_to_string(ls, ' ')))")} AS category, concat_ws('; ', CASE WHEN len(ms) > 0 THEN 'anomalous metrics: ' || array_to_string(ms[1:4], ', ') END, CASE WHEN len(ls) > 0 THEN 'error logs: ' || array_to_string(ls[1:2], ', ') END) AS seen FROM t)
SELECT profile_id, category, 'Microservice incident in microservices on ' || entity || ' (' || entity || '). Observed condition: ' || CASE WHEN seen = '' THEN 'degraded performance' ELSE seen END || '. Troubleshooting procedures, diagnostic commands, and failure triage.' AS "primary",
  'Remediation, restart, scaling, or rollback runbook for ' || entity || ' ' || category || ' degradation. Verification steps and safety prerequisites.' AS remediation, 'Kubernetes and Prometheus operations for ' || category || ' saturation on ' || entity || '. Resource limits, health checks, and service dependencies.' AS metric FROM x""",
    "prefix_queries": f"""WITH {tq.POINTS}, {tq.SPANS}, {_LOGS},
f AS (SELECT case_id, min(ts) AS boundary FROM points WHERE is_anomaly GROUP BY ALL),
v AS (SELECT *, avg(value) OVER (PARTITION BY case_id, metric ORDER BY obs_idx ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS mu FROM metrics),
m0 AS (SELECT v.case_id, v.metric, translate(v.metric, '_-', '  ') || ' ' || CASE WHEN mu IS NULL OR value IS NULL THEN 'changed' WHEN value > mu THEN 'increased' ELSE 'decreased' END AS p FROM v JOIN f ON f.case_id = v.case_id AND f.boundary = v.ts JOIN points q ON q.case_id = v.case_id AND q.metric = v.metric AND q.ts = v.ts AND q.is_anomaly),
m AS (SELECT case_id, string_agg(p, '; ' ORDER BY metric) AS m, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY metric) AS r FROM m0) WHERE r <= 6 GROUP BY case_id),
l0 AS (SELECT case_id, container || ' logs report ' || left(trim(regexp_replace(regexp_replace(regexp_replace(message, '(?i)\\b[0-9a-f]{{8,}}\\b', '<id>', 'g'), '\\b[0-9]+\\b', '<n>', 'g'), '[ \t\n\r]+', ' ', 'g')), 120) AS p, t, container, message FROM lines JOIN f USING (case_id) WHERE t <= boundary AND regexp_matches(message, '(?i)\\b(error|exception|timeout|timed out|failed|failure|unavailable|refused)\\b')),
l1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, p ORDER BY t, container, message) AS r FROM l0) WHERE r = 1),
l AS (SELECT case_id, string_agg(p, '; ' ORDER BY i) AS l, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t, container, message, p) AS i FROM l1) WHERE i <= 3 GROUP BY case_id),
s AS (SELECT case_id, 'traces include services ' || string_agg(service, ', ' ORDER BY service) AS s FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY service) AS r FROM (SELECT DISTINCT case_id, service FROM spans JOIN f USING (case_id) WHERE start_us <= boundary * 1000000)) WHERE r <= 6 GROUP BY case_id)
SELECT case_id, boundary, 'Observed service telemetry shows ' || concat_ws('; ', m, l, CASE WHEN coalesce(m.k, 0) + coalesce(l.k, 0) < 8 THEN s END) || '. What operational guidance is relevant to investigating this condition?' AS query FROM f LEFT JOIN m USING (case_id) LEFT JOIN l USING (case_id) LEFT JOIN s USING (case_id)""",
    "annotation_sample": f"WITH {rq.BM25}, q2 AS (SELECT query, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY query) AS r FROM (SELECT query, category AS stratum FROM queries)) WHERE r <= 2) SELECT query, stratum, rank, doc FROM q2 JOIN bm25 USING (query) WHERE rank <= 3",
    "annotation_grades": f"WITH {rq.DOCS} SELECT q.query, d.doc, CASE WHEN d.category = q.category THEN 2 ELSE 1 END AS grade FROM docs d JOIN queries q ON d.service = q.service WHERE q.service <> ''",
}
