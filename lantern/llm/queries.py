"""The p-queries: each takes (spark, folder) and covers its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.lineage import cut
from lantern.llm import bpe, crosssplit, mixture, quantiles, rankwalk, readinglevel, related, topn

SCORES = ["s_comb_score", "trace_elev_score", "causal_residual_z", "log_anomaly_score"]


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_order(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of every case in one order."""
    rows = _t(spark, folder, "candidate_evidence_profile").select("case_id", "profile_id", "entity", "service_id", *SCORES, "scored_at", "ingested_at")
    walked = rankwalk.rank_walk(rows, "case_id", "service", SCORES, prepare=lambda x: rankwalk.valid_profiles(x, SCORES))
    return walked.withColumnRenamed("service", "entity")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_order(spark, folder).where("place = 1").select("case_id", "entity")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.found(_t(spark, folder, "rag2_query_split"))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation records that are also in train, per split and source."""
    table = _t(spark, folder, "rag2_query_split")
    hit = crosssplit.overlaps(table).groupBy("evaluation_id").agg(F.count("*").alias("partners"))
    rows = table.select("record_id", crosssplit.clean_split(F.col("split")).alias("split"), "source").where("split <> 'train'").distinct()
    joined = rows.join(hit, F.col("record_id") == F.col("evaluation_id"), "left")
    return joined.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("partners").alias("also_in_train"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"))


MEASURES = ["caller_p10", "caller_p90", "call_count"]


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """(caller, callee, observed_at, measure, _v): each attribution once; null, NaN and negative values and null names don't count."""
    cols = ["caller_service", "callee_service", "observed_at", *MEASURES]
    rows = _t(spark, folder, "edge_attribution").where("attribution_id is not null and callee_service is not null and caller_service is not null")
    latest = topn.latest(rows.select("attribution_id", "arrived_at", *cols), ["attribution_id"], "arrived_at", cols).drop("attribution_id")
    # Mapped once and written, since both passes of the selection read the values.
    once = cut(quantiles.with_ordered(latest, MEASURES))
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("_v")) for m in MEASURES])
    return once.select("caller_service", "callee_service", "observed_at", F.inline(each)).where("_v >= 0")


EDGE = ["caller_service", "callee_service", "measure"]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _measured(spark, folder).where("observed_at is not null").withColumn("after", F.col("observed_at") >= F.lit("2025-03-01").cast("timestamp_ntz"))
    medians = quantiles.exact(rows, [*EDGE, "after"], [0.5])
    side = medians.groupBy(*EDGE).agg(*[F.max(F.when(F.col("after") == a, F.col(c))).alias(f"{c}_{a}".lower()) for a in (True, False) for c in ("n", "value")])
    return side.where("n_true >= 20 and n_false >= 20 and value_true >= 2 * value_false").select(*EDGE)


def p3_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Exact 10th, 50th and 90th percentile of every edge, measure and day."""
    rows = _measured(spark, folder).withColumn("day", F.col("observed_at").cast("date"))
    q = quantiles.exact(rows, [*EDGE, "day"], [0.1, 0.5, 0.9])
    return q.select(*EDGE, "day", "n", "q", F.round("value", 6).alias("value"))


def p3_union(spark: SparkSession, folder: str) -> DataFrame:
    """10th, 50th and 90th percentile of every edge, measure and month, from the digests of its days alone, with the bounds of the true value."""
    rows = _measured(spark, folder).withColumn("day", F.col("observed_at").cast("date")).where("day is not null")
    daily = cut(quantiles.digest(rows, [*EDGE, "day"]))
    months = quantiles.merge(daily.withColumn("month", F.date_format("day", "yyyy-MM")), [*EDGE, "month"])
    return quantiles.bounds(cut(months), [*EDGE, "month"], [0.1, 0.5, 0.9]).select(*EDGE, "month", "q", "n", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _t(spark, folder, "ranked_entity").select("case_id", "method", "entity", "score", "computed_at")
    valid = lambda x: topn.latest(x, ["case_id", "method", "entity"], "computed_at", ["score"])
    best = topn.top_n(rows, ["case_id", "method"], "score", "entity", 3, prepare=valid)
    return best.select("case_id", "method", "entity", F.col("place").cast("int").alias("place"))


def p4_held(spark: SparkSession, folder: str) -> DataFrame:
    """The three best of each case and method, and whether the stored rank of the valid row is their place."""
    keys = ["case_id", "method", "entity"]
    stored = topn.latest(_t(spark, folder, "ranked_entity").select(*keys, "computed_at", "score", "rank"), keys, "computed_at", ["score", "rank"]).select(*keys, F.col("rank").alias("stored_rank"))
    held = p4_found(spark, folder).join(stored, keys, "left")
    return held.select(*keys, "place", "stored_rank", F.coalesce(F.col("stored_rank") == F.col("place"), F.lit(False)).alias("agrees"))


def p4_reported(spark: SparkSession, folder: str) -> DataFrame:
    """Every reported list of candidates beside the three best by method 'pairwise'."""
    place = F.struct("place", "entity")
    best = p4_found(spark, folder).where("method = 'pairwise'").groupBy("case_id").agg(F.sort_array(F.collect_list(place)).alias("b"))
    computed = best.select("case_id", F.array_join(F.transform("b", lambda x: x["entity"]), ",").alias("computed"))
    told = _t(spark, folder, "canonical_locked_test_results").select("case_id", F.array_join("top_candidates", ",").alias("reported")).distinct()
    return told.join(computed, "case_id", "left").select("case_id", "reported", "computed", F.coalesce(F.col("reported") == F.col("computed"), F.lit(False)).alias("same"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    cases = cut(related.valid_cases(_t(spark, folder, "manifest_case")))
    unit_of = related.units(cases.where("family is not null"), "case_id", ["family"])
    return related.breaches(unit_of, cases.where("partition in ('dev', 'val', 'held_out')"), "case_id", "partition").select("case_id")


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A leak-free partition of every case: half dev, a quarter each val and held_out, whole families."""
    cases = cut(related.valid_cases(_t(spark, folder, "manifest_case")))
    unit_of = related.units(cases, "case_id", ["family"])
    return related.deal(unit_of, "case_id", {"dev": 0.5, "val": 0.25, "held_out": 0.25})


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """What each split of that partition has: cases, families, and families that lie in another split as well (none)."""
    dealt = cut(p5_splits(spark, folder))
    per = dealt.groupBy("unit").agg(F.count_distinct("split").alias("n"))
    both = dealt.join(per.withColumnRenamed("unit", "_u"), F.col("unit") == F.col("_u"))
    return both.groupBy("split").agg(F.count("*").alias("cases"), F.count_distinct("unit").alias("units"), F.count_if(F.col("n") > 1).alias("breaches"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = bpe.spread(_t(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", bpe.encode(F.col("text"), kept=bpe.frequent_words(docs, "text")).alias("ids"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sources, _ = mixture.plan(mixture.leaf_sizes(_t(spark, folder, "documents")), _t(spark, folder, "mix_target"))
    return sources.where("short").select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mix of the size of all documents: what every source was to give and really gives."""
    return mixture.report(mixture.token_sizes(_t(spark, folder, "documents")), _t(spark, folder, "mix_target"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    """How often each document is used in that mix."""
    sizes = cut(mixture.token_sizes(_t(spark, folder, "documents")))
    return mixture.select(sizes, mixture.plan(sizes, _t(spark, folder, "mix_target"))[1])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return readinglevel.college(bpe.spread(_t(spark, folder, "documents").select("doc_id", "text")))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Words of prose, language flag and expected grade of every document."""
    levels = readinglevel.reading_levels(_t(spark, folder, "documents"))
    return levels.select("doc_id", "words", "sentences", "english", F.round("grade", 3).alias("grade"), F.round("college", 4).alias("college"))


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by source and grade: English documents with at least 50 words of prose."""
    docs = _t(spark, folder, "documents")
    levels = readinglevel.reading_levels(docs).where("words >= 50 and english")
    named = levels.join(docs.select(F.col("doc_id").alias("_d"), mixture.clean_source(F.col("source")).alias("source")), F.col("doc_id") == F.col("_d"))
    return named.groupBy("source", F.floor("grade").cast("int").alias("grade")).agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


QUERIES = {
    "p4_held": p4_held,
    "p4_reported": p4_reported,
    "p5_shares": p5_shares,
    "p8_profile": p8_profile,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_mix": p7_mix,
    "p7_selection": p7_selection,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p1_found": p1_found,
    "p1_order": p1_order,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p3_found": p3_found,
    "p3_daily": p3_daily,
    "p3_union": p3_union,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p4_found": p4_found,
}

_MEASURED = """
WITH once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attribution_id ORDER BY arrived_at DESC NULLS LAST) AS rn FROM edge_attribution
                 WHERE callee_service IS NOT NULL AND caller_service IS NOT NULL AND attribution_id IS NOT NULL) WHERE rn = 1),
long AS (
  SELECT caller_service, callee_service, observed_at, measure, x FROM (
    SELECT caller_service, callee_service, observed_at, 'caller_p10' AS measure, caller_p10 AS x FROM once
    UNION ALL SELECT caller_service, callee_service, observed_at, 'caller_p90', caller_p90 FROM once
    UNION ALL SELECT caller_service, callee_service, observed_at, 'call_count', CAST(call_count AS DOUBLE) FROM once)
  WHERE x >= 0 AND NOT isnan(x))"""

_PLACED = """
WITH valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, method, entity ORDER BY computed_at DESC NULLS LAST, score DESC NULLS LAST, rank DESC NULLS LAST) AS rn FROM ranked_entity) WHERE rn = 1),
placed AS (SELECT case_id, method, entity, rank AS stored_rank, CAST(row_number() OVER (PARTITION BY case_id, method ORDER BY score DESC, entity COLLATE "C" ASC NULLS LAST) AS INTEGER) AS place FROM valid WHERE score IS NOT NULL AND isfinite(score))"""

ORACLES = {
    "p4_held": _PLACED + " SELECT *, coalesce(stored_rank = place, false) AS agrees FROM placed WHERE place <= 3",
    "p4_reported": _PLACED + """, best AS (SELECT case_id, string_agg(entity, ',' ORDER BY place) AS computed FROM placed WHERE place <= 3 AND method = 'pairwise' GROUP BY ALL),
told AS (SELECT DISTINCT case_id, array_to_string(top_candidates, ',') AS reported FROM canonical_locked_test_results)
SELECT case_id, reported, computed, coalesce(reported = computed, false) AS same FROM told LEFT JOIN best USING (case_id)""",
    "p3_found": _MEASURED + """
SELECT caller_service, callee_service, measure FROM long GROUP BY ALL
HAVING count(*) FILTER (observed_at >= TIMESTAMP '2025-03-01') >= 20 AND count(*) FILTER (observed_at < TIMESTAMP '2025-03-01') >= 20
   AND median(x) FILTER (observed_at >= TIMESTAMP '2025-03-01') >= 2 * median(x) FILTER (observed_at < TIMESTAMP '2025-03-01')""",
    "p3_daily": _MEASURED + """
, each AS (SELECT caller_service, callee_service, measure, CAST(observed_at AS DATE) AS day, count(*) AS n,
                  quantile_cont(x, 0.1) AS a, quantile_cont(x, 0.5) AS b, quantile_cont(x, 0.9) AS c FROM long GROUP BY ALL)
SELECT caller_service, callee_service, measure, day, n, CAST(0.1 AS DOUBLE) AS q, round(a, 6) AS value FROM each
UNION ALL SELECT caller_service, callee_service, measure, day, n, CAST(0.5 AS DOUBLE), round(b, 6) FROM each
UNION ALL SELECT caller_service, callee_service, measure, day, n, CAST(0.9 AS DOUBLE), round(c, 6) FROM each""",
    # The digit of a positive value x: 256 steps within its power of two.
    "p3_union": _MEASURED + """
, m AS (SELECT caller_service, callee_service, measure, strftime(observed_at, '%Y-%m') AS month, x,
               row_number() OVER (PARTITION BY caller_service, callee_service, measure, strftime(observed_at, '%Y-%m') ORDER BY x) AS r,
               count(*) OVER (PARTITION BY caller_service, callee_service, measure, strftime(observed_at, '%Y-%m')) AS n FROM long WHERE observed_at IS NOT NULL),
hit AS (SELECT caller_service, callee_service, measure, month, q, n, x, pow(2, floor(log2(nullif(x, 0))) - 8) AS step
       FROM m, (SELECT unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS q) WHERE r = greatest(1, ceil(n * q)))
SELECT caller_service, callee_service, measure, month, q, n, round(coalesce(floor(x / step) * step, 0.0), 9) AS low,
       round(coalesce((floor(x / step) + 1) * step, 0.0), 9) AS high FROM hit""",
    # Every pair that shares a trigram, without any filter.
    "p2_found": r"""
WITH lab AS (SELECT DISTINCT record_id, regexp_replace(regexp_replace(lower(split), '[^\p{L}\p{N}]+', '_', 'g'), '^_|_$', '', 'g') AS s,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(case_id), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g'), '(^|[^0-9])0+([0-9]+)$', '\1\2'), '') AS c, query FROM rag2_query_split WHERE record_id IS NOT NULL),
r AS (SELECT record_id AS id, CASE WHEN s IN ('train', 'training') THEN 't' WHEN s IN ('val', 'validation', 'dev', 'test', 'final_test') THEN 'e' END AS side, c,
    list_transform(regexp_extract_all(lower(query), '[0-9]+(?:[.,][0-9]+)*|\p{L}[\p{L}\p{N}]*'), lambda w: CASE WHEN regexp_matches(w, '^[0-9]') THEN regexp_replace(regexp_replace(w, '[.,][0-9]{1,2}$|[.][0-9]+$', ''), '[.,]', '', 'g') ELSE w END) AS w FROM lab),
g AS (SELECT id, side, list_sort(w) AS bag, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM r WHERE len(w) > 0 AND side IS NOT NULL),
u AS (SELECT id, side, len(g) AS n, unnest(g) AS x FROM g),
near AS (SELECT a.id AS t, b.id AS e FROM u a JOIN u b ON a.x = b.x AND a.side = 't' AND b.side = 'e' GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * least(a.n, b.n) AND least(a.n, b.n) >= 0.5 * greatest(a.n, b.n)),
all_ AS (SELECT t, e FROM near UNION SELECT a.id, b.id FROM g a JOIN g b ON a.bag = b.bag AND a.side = 't' AND b.side = 'e' UNION SELECT a.id, b.id FROM r a JOIN r b ON a.c = b.c AND a.side = 't' AND b.side = 'e')
SELECT DISTINCT least(t, e) AS record_id_a, greatest(t, e) AS record_id_b FROM all_""",
    "p5_found": """
WITH valid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY listed_at DESC) AS rn FROM manifest_case) WHERE rn = 1),
clean AS (
  SELECT case_id,
    regexp_replace(regexp_replace(lower(coalesce(nullif(trim(suite), ''), split_part(dataset, '-', 1))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS suite,
    regexp_replace(regexp_replace(lower(system), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS system,
    nullif(regexp_replace(regexp_replace(lower(root_cause_service), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), '') AS service,
    regexp_replace(regexp_replace(lower(fault), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS fault,
    regexp_replace(regexp_replace(lower(partition), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS part FROM valid),
counted AS (SELECT * FROM clean WHERE service IS NOT NULL AND part IN ('dev', 'val', 'held_out')),
bad AS (SELECT suite, system, service, fault FROM counted GROUP BY ALL HAVING count(DISTINCT part) > 1)
SELECT case_id FROM counted JOIN bad USING (suite, system, service, fault)""",
    "p4_found": """
WITH valid AS (
  SELECT case_id, method, entity, score FROM (
    SELECT *, row_number() OVER (PARTITION BY case_id, method, entity ORDER BY computed_at DESC NULLS LAST, score DESC NULLS LAST) AS rn
    FROM ranked_entity) WHERE rn = 1),
placed AS (
  SELECT case_id, method, entity,
         row_number() OVER (PARTITION BY case_id, method ORDER BY score DESC, entity COLLATE "C" ASC NULLS LAST) AS place
  FROM valid WHERE score IS NOT NULL AND isfinite(score))
SELECT case_id, method, entity, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 3""",
}
