"""Small literal cases of the core operators."""

import math

import pytest
from pyspark.sql import functions as F

from lantern.blocks import running
from lantern.functions import scalars
from lantern.operators import causal, detect, episodes, evaluation, evidence, graph, logs, ranking, retrieval, traces
from lantern.sources import tables

METRIC = "case_id string, entity string, metric string, ts bigint, obs_idx int, value double"


def series(spark, values, metric="a_cpu"):
    return spark.createDataFrame([("c", metric.split("_")[0], metric, 10 * i, i, v) for i, v in enumerate(values)], METRIC)


def test_all_statuses(spark):
    values = [1.0] * 6 + [float("nan")] + [1.0] * 4 + [100.0] + [1.0] * 3
    got = {r.obs_idx: r.status for r in detect.zscore_points(series(spark, values), 5, 3.0, 5, 3).collect()}
    assert [got[i] for i in range(5)] == ["warmup"] * 5
    assert got[6] == "missing_observation" and got[11] == "anomaly" and got[5] == "normal"


def test_too_little_history(spark):
    values = [1.0] + [None] * 4 + [1.0]
    got = {r.obs_idx: r.status for r in detect.zscore_points(series(spark, values), 5, 3.0, 5, 3).collect()}
    assert got[5] == "insufficient_history"


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        detect.zscore_points(series(spark, [1.0]), 5, 3.0, 5, 9)


def test_mad_is_robust(spark):
    values = [1.0, 2.0, 3.0, 2.0, 1000.0, 2.0, 50.0]
    got = {r.obs_idx: r for r in detect.mad_points(series(spark, values), 5, 3.0, 5, 3).collect()}
    assert got[5].status == "normal" and got[6].status == "anomaly"


def test_prefix_invariance(spark, rows):
    """What was known at a time doesn't change with what comes later."""
    values = [math.sin(i) * 3 + (40 if i in (17, 18, 30) else 0) for i in range(40)]
    whole = detect.as_of(detect.zscore_points(series(spark, values), 8), 200)
    part = detect.zscore_points(detect.as_of(series(spark, values), 200), 8)
    assert rows(whole) == rows(part)


def test_duplicate_steps_and_streaks(spark):
    flags = [False, True, True, False, True, True, True]
    df = spark.createDataFrame([("c", "a", "a_x", i, i, f) for i, f in enumerate(flags)], "case_id string, entity string, metric string, ts bigint, obs_idx int, is_anomaly boolean")
    got = {r.obs_idx: r.streak for r in detect.streaks(df).collect()}
    assert [got[i] for i in range(7)] == [0, 1, 2, 0, 1, 2, 3]


def test_episodes(spark, rows):
    flags = {"a_x": [0, 1, 1, 1, 0, 0, 1], "a_y": [0, 1, 1, 0, 0, 0, 1]}
    df = spark.createDataFrame([("c", "a", m, 10 * i, i, bool(f)) for m, fs in flags.items() for i, f in enumerate(fs)], "case_id string, entity string, metric string, ts bigint, obs_idx int, is_anomaly boolean")
    steps = episodes.entity_steps(df, 1, 2)
    assert rows(episodes.entity_episodes(steps), "start_idx", "end_idx", "duration_s", "peak_active") == [(1, 2, 10, 2), (6, 6, 0, 2)]
    cut = episodes.truncate(episodes.entity_episodes(steps), steps, 10)
    assert rows(cut, "start_idx", "end_idx") == [(1, 1)]
    assert rows(episodes.evidence(steps), "has_episode", "first_ts", "peak_active") == [(True, 10, 2)]


@pytest.mark.parametrize(
    ("intervals", "expected"),
    [
        ([(10, 25), (15, 30), (5, 12)], [(5, 30)]),
        ([(10, 20), (20, 30)], [(10, 30)]),
        ([(10, 10), (20, 15)], []),
        ([(1, 9), (2, 3), (4, 5), (12, 13)], [(1, 9), (12, 13)]),
    ],
)
def test_interval_union(spark, rows, intervals, expected):
    df = spark.createDataFrame([("k", a, b) for a, b in intervals], "k string, start bigint, end bigint")
    assert rows(traces.interval_union(df, ["k"]), "start", "end") == expected


def span(i, parent, service, start, duration):
    return ("c", i, parent, service, start, duration)


SPAN = "case_id string, span_id bigint, parent_span_id bigint, service string, start_us bigint, duration_us bigint"


def test_three_spans(spark):
    df = spark.createDataFrame([span(1, None, "front", 1000, 1000), span(2, 1, "front", 1100, 400), span(3, 2, "money", 1150, 200)], SPAN)
    call = traces.relations(df).collect()
    assert [(r.src, r.dst, r.caller_duration, r.callee_duration, r.return_lag) for r in call] == [("front", "money", 400, 200, 150)]
    edge = traces.edge_latency(traces.relations(df)).first()
    assert (edge.calls, edge.caller_p50, edge.callee_p50, edge.lag_p90) == (1, 400, 200, 150)
    expected = spark.createDataFrame([("c", "front"), ("c", "ads")], "case_id string, entity string")
    assert [r.entity for r in traces.uninstrumented(expected, df).collect()] == ["ads"]


def test_repeated_spans(spark):
    key, content = ["case_id", "span_id"], ["parent_span_id", "service", "start_us", "duration_us"]
    same = spark.createDataFrame([span(1, 0, "a", 1, 1)] * 2, SPAN)
    assert traces.distinct_spans(same, key, content).count() == 1
    other = spark.createDataFrame([span(1, 0, "a", 1, 1), span(1, 0, "b", 1, 1)], SPAN)
    with pytest.raises(Exception, match="conflict"):
        traces.distinct_spans(other, key, content).collect()


def test_edges_become_visible(spark, rows):
    df = spark.createDataFrame([span(1, None, "A", 100, 20), span(2, 1, "B", 105, 10), span(3, None, "B", 130, 30), span(4, 3, "C", 135, 15), span(5, None, "A", 180, 10), span(6, 5, "D", 182, 20)], SPAN)
    assert rows(traces.edges(traces.relations(df)), "src", "dst", "first_visible_us") == [("A", "B", 120), ("A", "D", 202), ("B", "C", 160)]


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 3, 4, 5, 6)], "k string, v int")
    got = traces.distribution(df, ["k"], "v", (0.1, 0.5, 0.9)).first()
    assert (got.p10, got.p50, got.p90, got.n) == (1, 3, 5, 6)  # 0.5 -> 0, 2.5 -> 2, 4.5 -> 4


def test_decomposition(spark):
    p = spark.createDataFrame([(1, 0, 100), (2, 0, 10)], "span_id bigint, start bigint, duration bigint")
    c = spark.createDataFrame([(1, 10, 30), (1, 20, 40), (1, 90, 50)], "parent_span_id bigint, start bigint, duration bigint")
    got = {r.span_id: (r.covered, r.self_time, r.overlap, r.children) for r in traces.decompose(p, c).collect()}
    assert got == {1: (60, 40, True, 3), 2: (0, 10, False, 0)}


def test_metric_names(spark):
    df = spark.createDataFrame([("checkout_cpu",), ("pay_latency-90",), ("a_b_c",)], "m string")
    e, s = graph.metric_name(F.col("m"))
    assert sorted(map(tuple, df.select(e, s).collect())) == [("a", "b_c"), ("checkout", "cpu"), ("pay", "latency-90")]
    with pytest.raises(Exception, match="entity"):
        spark.createDataFrame([("_x",)], "m string").select(graph.metric_name(F.col("m"))[0]).collect()


def test_reach_with_cycle(spark, rows):
    e = spark.createDataFrame([("c", "a", "b"), ("c", "b", "a"), ("c", "b", "d"), ("c", "x", "x")], "case_id string, src string, dst string")
    assert rows(graph.reach(e), "src", "dst") == [("a", "b"), ("a", "d"), ("b", "a"), ("b", "d")]


def test_propagation_counts_rising_onsets(spark, rows):
    ev = spark.createDataFrame([("c", "a", True, 1), ("c", "b", True, 5), ("c", "d", True, 9), ("c", "e", False, None)], "case_id string, entity string, has_episode boolean, first_ts bigint")
    e = spark.createDataFrame([("c", "b", "a"), ("c", "b", "d"), ("c", "d", "e")], "case_id string, src string, dst string")
    assert rows(graph.propagation_coverage(ev, e), "entity", "coverage") == [("a", 2), ("b", 1), ("d", 0), ("e", 0)]


def test_window_never_falls_back_to_truth(spark):
    truth = spark.createDataFrame([("c", 5, 9)], "case_id string, inject_ts bigint, last_ts bigint")
    none = spark.createDataFrame([("c", None)], "case_id string, first_ts bigint")
    got = graph.incident_window(truth, none, "detected").first()
    assert got.onset_ts is None and got.available is False
    with pytest.raises(ValueError):
        graph.incident_window(truth, none, "custom")


def test_tiebreak_moves_exact_ties_only(spark, rows):
    r = spark.createDataFrame([("c", "a", 0.5, 1), ("c", "b", 0.5, 2), ("c", "d", 0.4, 3)], "case_id string, entity string, score double, rank int")
    e = spark.createDataFrame([("c", "b", 0.9), ("c", "d", 1.0)], "case_id string, entity string, score double")
    assert rows(ranking.tiebreak(r, e), "entity", "new_rank", "moved") == [("a", 2, True), ("b", 1, True), ("d", 3, False)]


def test_margin_of_one_candidate(spark):
    r = spark.createDataFrame([("c", "a", 0.5, 1)], "case_id string, entity string, score double, rank int")
    assert ranking.margins(r).first().margin == 1.0


def test_ranking_quality(spark):
    ranks = spark.createDataFrame([(1, d, d) for d in range(1, 6)], "query bigint, doc bigint, rank int")
    rel = spark.createDataFrame([(1, 1, 1), (1, 7, 1), (1, 8, 1), (1, 9, 1), (1, 10, 1)], "query bigint, doc bigint, grade int")
    got = retrieval.quality(ranks, rel).first()
    assert (got.hit_1, got.mrr) == (1, 1.0) and abs(got.ndcg_exp_5 - 1 / 2.9484591188793923) < 1e-8 and got.recall_20 == got.precision_5 == 0.2
    assert got.ndcg_5 is None  # linear gain needs a grade above 1


def test_bm25_prefers_the_rare_word(spark):
    docs = spark.createDataFrame([(1, "disk full disk"), (2, "disk ok"), (3, ""), (4, None), (5, "queue full")], "doc bigint, text string")
    q = spark.createDataFrame([(9, "queue disk")], "query bigint, text string")
    got = [r.doc for r in retrieval.bm25(docs, q).orderBy("rank").collect()]
    assert got[0] == 5 and set(got) == {1, 2, 5}


def test_dense_skips_zero_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "doc bigint, vec array<double>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query bigint, vec array<double>")
    assert [(r.doc, r.score) for r in retrieval.dense(v, q, 5, block=1).orderBy("rank").collect()] == [(1, 1.0), (3, 0.707107)]


def test_chunks_keep_everything(spark):
    text = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(12))
    got = retrieval.chunks(spark.createDataFrame([(1, text), (2, None), (3, " ")], "doc bigint, text string")).collect()
    assert all(f"Paragraph {i} " in " ".join(r.chunk for r in got) for i in range(12)) and {r.doc for r in got} == {1}


def test_citations(spark):
    a = spark.createDataFrame([("x", "see [Ref: d1#2] and [d9] and [2]"), ("y", "nothing")], "answer string, text string")
    r = spark.createDataFrame([("x", "d1#2", 1), ("x", "d3", 2)], "answer string, doc string, rank int")
    got = {g.answer: (g.claimed, g.valid, g.rate) for g in retrieval.citations(a, r).collect()}
    assert got["x"][:2] == (3, 2) and got["y"] == (0, 0, 1.0)


def test_pool_has_background(spark):
    docs = spark.createDataFrame([(i,) for i in range(40)], "doc bigint")
    r = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "query bigint, doc bigint, rank int")
    got = retrieval.pool([r], docs).collect()
    assert sum(g.source == "background" for g in got) == 5 and len({g.doc for g in got}) == 10


def test_log_novelty(spark):
    calm = [("s", i, "Normal heartbeat request OK") for i in range(20)]
    hot = [("s", 100 + i, "ERROR: Connection refused to database port 5432") for i in range(10)]
    got = logs.score(spark.createDataFrame(calm + hot + [("s", 3, None)], "container string, timestamp bigint, message string"), 50).first()
    assert got.novel == 10 and got.errors == 10 and got.score > 0.5


def test_case_metrics_and_holm(spark):
    r = spark.createDataFrame([("c1", "m", "a", 1), ("c1", "m", "b", 2), ("c2", "m", "a", 1)], "case_id string, method string, entity string, rank int")
    t = spark.createDataFrame([("c1", "b"), ("c2", "z")], "case_id string, entity string")
    got = {g.case_id: (g.first, g.top_1, g.top_3, g.reciprocal_rank) for g in evaluation.case_metrics(r, t).collect()}
    assert got == {"c1": (2, 0, 1, 0.5), "c2": (None, 0, 0, 0.0)}
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    assert {g.name: round(g.p_holm, 6) for g in evaluation.holm(p).collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}


def test_unpaired_cases_are_an_error(spark):
    m = spark.createDataFrame([("c", "a", 1.0)], "case_id string, method string, v double")
    with pytest.raises(Exception, match="not paired"):
        evaluation.pairs(m, "a", "b", "v").collect()


def test_resampling(spark):
    p = spark.createDataFrame([(f"c{i}", 1.0, 0.0) for i in range(12)], "case_id string, a double, b double")
    f = spark.createDataFrame([(f"c{i}", f"f{i % 6}") for i in range(12)], "case_id string, family string")
    got = evaluation.randomization_test(p, f, 400).first()
    assert got.difference == 1.0 and 0 < got.p_value < 0.1
    ci = evaluation.cluster_bootstrap(p, f, replicates=100).first()
    assert ci.low <= ci.difference <= ci.high


def test_pairwise_learns_the_sign(spark):
    c = spark.createDataFrame([(f"c{i}", e, x, 0.0) for i in range(6) for e, x in (("root", 1.0), ("other", 0.2))], "case_id string, entity string, x double, y double")
    t = spark.createDataFrame([(f"c{i}", "root") for i in range(6)], "case_id string, entity string")
    ex = evaluation.pairwise_examples(c, t, ["x", "y"])
    assert ex.count() == 12
    w = evaluation.fit_pairwise(ex, ["x", "y"])
    assert w["x"] > 0 and {r.entity for r in evaluation.rank_pairwise(c, w).where("rank = 1").collect()} == {"root"}


def test_bocpd_finds_the_step():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x[120:] += 6
    best, short = causal.bocpd(x, warmup=60)
    assert best[119] > 90 and best[135] < 25 and short[120:124].max() > 0.5
    again, _ = causal.bocpd(x[:120], warmup=60)
    assert (best[:120] == again).all()  # the future doesn't change the past


def test_residual_points_at_the_break(spark):
    n, onset = 60, 50
    data = [("c", e, f"{e}_cpu", i, i, v) for i in range(n) for e, v in (("a", 10 + i % 3 + (90 if i >= onset else 0)), ("b", 5 + i % 2 + 0.0))]
    m = spark.createDataFrame([(*d[:5], float(d[5])) for d in data], METRIC)
    e = spark.createDataFrame([("c", "b", "a")], "case_id string, src string, dst string")
    got = {r.entity: r.max_z for r in causal.ridge_residuals(m, e, onset).collect()}
    assert got["a"] > got["b"] and got["a"] > 10
    relief = {r.entity: r.relief for r in causal.counterfactual_relief(m, e, onset, "a").collect()}
    assert relief["a"] > relief["b"]


def test_topological_order():
    assert causal.topological(["b", "a", "c"], {"a": ["b"], "c": ["a"]}) == ["b", "a", "c"]
    assert causal.topological(["x", "y"], {"x": ["y"], "y": ["x"]}) == ["x", "y"]


def test_sequential_confirmation(spark):
    steps = spark.createDataFrame([("c", t, e, True) for t, e in ((0, "a"), (60, "a"), (60, "b"), (120, "a"), (120, "d"), (180, "a"))], "case_id string, ts bigint, entity string, in_episode boolean")
    e = spark.createDataFrame([("c", "a", "b", 0), ("c", "b", "d", 0)], "case_id string, src string, dst string, first_visible_us bigint")
    got = causal.sequential_confirmation(steps, e, 60, 3).first()
    assert (got.suspect_ts, got.confirmed_ts, got.entities) == (0, 180, "a,b,d")
    late = e.withColumn("first_visible_us", F.lit(10**12))
    assert causal.sequential_confirmation(steps, late, 60, 3).first().confirmed_ts is None


def test_disambiguation_and_fusion(spark):
    p = spark.createDataFrame([("c", "a", 0.50, 0.0, 0.0), ("c", "b", 0.45, 1.0, 5.0), ("d", "a", 0.9, 0.0, 0.0), ("d", "b", 0.1, 1.0, 9.0)], "case_id string, entity string, score double, elevation double, residual double")
    got = {r.case_id: (r.chosen, r.switched) for r in evidence.disambiguate(p).collect()}
    assert got == {"c": ("b", True), "d": ("a", False)}
    raw = spark.createDataFrame([("c", "a", 2.0, None, 0.0, 0.0, 0.0, 1.0, 0), ("c", "b", 1.0, 0.0, 0.0, 0.0, 0.0, None, 600)], "case_id string, entity string, metric double, trace double, log double, topology double, change double, consistency double, first_ts bigint")
    assert [r.entity for r in evidence.fuse(raw).orderBy("rank").collect()] == ["a", "b"]


def test_running_sums_by_block(spark):
    df = spark.createDataFrame([("g", i, 1.0) for i in range(500)] + [("h", 1, 5.0), (None, 3, None)], "k string, v int, w double")
    got = {(r.k, r.v): (r._pos, r._sum) for r in running(df, ["k"], [F.col("v")], "w", 7).collect()}
    assert got["g", 499] == (500, 500.0) and got["h", 1] == (1, 5.0) and got[None, 3] == (1, 0.0) and len(got) == 502


def test_sources(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('{"documents": [{"id": "1", "content": "x"}, {"document_id": "2", "text": "y", "title": "t"}]}')
    (tmp_path / "b.json").write_text('[{"id": "3", "text": "z"}]')
    (tmp_path / "c.jsonl").write_text('{"id": "4", "text": "w"}\n')
    assert rows(tables.corpus(spark, str(tmp_path / "*.json")), "document_id", "text") == [("1", "x"), ("2", "y"), ("3", "z")]
    assert rows(tables.corpus(spark, str(tmp_path / "c.jsonl"), lines=True), "document_id", "text") == [("4", "w")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tables.write_tsv(df, str(tmp_path / "t"))
    assert rows(tables.read_tsv(spark, str(tmp_path / "t"), "k int, v string")) == [(1, "a"), (2, "b")]
    assert tables.optional(spark, str(tmp_path / "none"), df.schema).count() == 0
    assert tables.exactly_one(df, F.col("k") == 1, "k").first().v == "a"
    with pytest.raises(Exception, match="rows found: 0"):
        tables.exactly_one(df, F.col("k") == 9, "k").collect()
    with pytest.raises(Exception, match="more than once"):
        tables.assert_unique(df.unionAll(df), ["k"]).collect()
    tables.write_report(df, str(tmp_path / "r"), "1")
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    assert tables.feature_cache(df, str(tmp_path / "f"), "k").where("k = 2").first().v == "b"
    assert tables.embedding_key(df, "k").first().cache_key == tables.embedding_key(df.orderBy(F.desc("k")), "k").first().cache_key


def test_scalars(spark):
    df = spark.createDataFrame([("<think>{x}</think>\n```json\n{\"k\": 3}\n```", "A| b |c| Disk "), ("no object", None)], "t string, f string")
    got = df.select(scalars.json_number(scalars.reply_json(F.col("t")), "k").alias("k"), scalars.key_part(F.col("f"), 4).alias("p")).collect()
    assert [tuple(r) for r in got] == [(3.0, "disk"), (None, None)]
    one = spark.createDataFrame([(float("nan"), 2.5, 0.0)], "a double, b double, c double")
    r = one.select(scalars.nan_to_null(F.col("a")).alias("a"), scalars.round_half_even(F.col("b")).alias("b"), scalars.safe_divide(F.col("b"), F.col("c")).alias("c")).first()
    assert (r.a, r.b, r.c) == (None, 2.0, None)
    assert len(one.select(scalars.short_hash(F.lit("x"), 8).alias("h")).first().h) == 8


def test_scores(spark, rows):
    from lantern.operators import scores

    ev = spark.createDataFrame([("c", "a", True, 0), ("c", "b", True, 10), ("c", "d", True, 100), ("c", "e", False, None)], "case_id string, entity string, has_episode boolean, first_ts bigint")
    e = spark.createDataFrame([("c", "a", "b"), ("c", "d", "a")], "case_id string, src string, dst string")
    # From the rules: onset against the first of the others, two edges at most, and latency above .4 anywhere in the case.
    ev = ev.unionAll(spark.createDataFrame([("d", "a", True, 5), ("d", "b", False, None), ("f", "a", True, 5), ("f", "b", False, None), ("f", "x", True, 7)], ev.schema))
    e = e.unionAll(spark.createDataFrame([("f", "a", "b"), ("f", "b", "x")], e.schema))
    slow = spark.createDataFrame([("d", "b", 0.41), ("c", "a", 0.4)], "case_id string, entity string, score double")
    got = {(r.case_id, r.entity): (r.temporal, r.topology, r.propagation) for r in scores.consistency(ev, e, slow).collect()}
    assert got == {
        ("c", "a"): (1.0, 1.0, 0.85), ("c", "b"): (0.85, 1.0, 0.85), ("c", "d"): (0.4, 1.0, 0.85), ("c", "e"): (0.7, 0.5, 0.5),
        ("d", "a"): (0.9, 0.9, 1.0), ("d", "b"): (0.7, 0.5, 0.8), ("f", "a"): (1.0, 1.0, 0.85), ("f", "b"): (0.7, 1.0, 0.5), ("f", "x"): (0.85, 1.0, 0.85),
    }
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 2.0), ("z", 1.0)], "k string, v double")
    assert rows(scores.recovery(a, b, "k", "v"), "k", "verdict") == [("x", "worse"), ("y", "gone"), ("z", "appeared")]


def test_rate_limit(spark):
    df = spark.createDataFrame([("u", t * 1_000_000) for t in (0, 10, 20, 30, 90)], "u string, us bigint")
    assert [r.recent for r in evidence.rate_limit(df, "u", "us", 60, 3).orderBy("us").collect()] == [1, 2, 3, 4, 2]


def test_streams_match_their_batches(spark, tmp_path, rows):
    """A late row is dropped; all else is as in the batch."""
    from lantern.streaming import online

    spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", i % 2, "view", 1.0, "{}") for i in range(6)], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = online.drain(online.tumbling(online.events(spark, str(tmp_path))), "complete")
    assert sum(r.n for r in got.collect()) == 6 and got.count() == 3
    assert online.drain(online.deduplicated(online.events(spark, str(tmp_path)), "user_id").select("user_id")).count() == 2
