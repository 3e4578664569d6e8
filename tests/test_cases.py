"""Preparation, alerts, verification, rates and query texts: expectations are written from the rules, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lantern.operators import evaluation, graph, prepare, ranking, retrieval, scores


def test_unpivot_keeps_nulls_and_takes_numbers_only(spark, rows):
    wide = spark.createDataFrame([(1, 1.0, None, "x", 7), (2, None, 4.0, "y", 8)], "time bigint, a_cpu double, b_latency double, note string, a_mem int")
    got = rows(prepare.unpivot(wide, ["time"]))
    assert got == [(1, "a_cpu", 1.0), (1, "a_mem", 7.0), (1, "b_latency", None), (2, "a_cpu", None), (2, "a_mem", 8.0), (2, "b_latency", 4.0)]
    assert prepare.unpivot(wide.limit(0), ["time"]).count() == 0


def test_aliases_are_exact(spark, rows):
    df = spark.createDataFrame([("frontendservice",), ("frontend",), ("Frontendservice",), (None,)], "s string")
    assert sorted(map(str, (r.n for r in df.select(prepare.aliased(F.col("s"), {"frontendservice": "frontend"}).alias("n")).collect()))) == ["Frontendservice", "None", "frontend", "frontend"]
    assert df.select(prepare.aliased(F.col("s"), {}).alias("n")).count() == 4


def test_changes_and_data_sets(spark):
    df = spark.createDataFrame([("Deployment done",), ("RESTARTING now",), ("Configuration Changed",), ("started container x",), ("restarted",), (None,)], "m string")
    assert [r.c for r in df.select(prepare.is_change(F.col("m")).alias("c")).collect()] == [True, True, True, True, False, False]
    cases = spark.createDataFrame([("RX2", "x", "OB"), (None, "RX2-OB", None), (None, "RX2-SS", "ss"), ("RX1", "RX1-OB", "ob"), (None, None, None)], "suite string, dataset string, system string")
    hits = lambda t: [r.h for r in cases.select(prepare.of_dataset(t, ["RX2"], F.col("suite"), F.col("dataset"), F.col("system")).alias("h")).collect()]
    assert hits("rx2") == [True, True, True, False, False]
    assert hits("RX2-OB") == [True, True, False, False, False]
    assert hits("rx1-ob") == [False, False, False, True, False]


def test_ordered_unique_and_query_text(spark, rows):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None), ("a", 1, "early")], "k string, at int, v string")
    assert rows(prepare.ordered_unique(df, ["k"], ["at"]), "k", "at", "v") == [("a", 1, "early"), ("b", 5, None)]
    q = spark.createDataFrame([(1, "svc", ["m1", None, " "], "secret"), (2, None, None, "secret")], "id int, s string, m array<string>, root_cause string")
    assert rows(prepare.query_text(q, "id", ["s", "m"])) == [(1, "svc m1"), (2, "")]


def test_prohibited_tokens_stop_a_query(spark):
    df = spark.createDataFrame([("what is the Root_Cause_Service here",), ("all is well",), (None,)], "q string")
    assert [r.v for r in df.select(prepare.violations(F.col("q")).alias("v")).collect()] == [["root_cause_service"], [], []]
    assert prepare.leak_free(df.where("q like 'all%' or q is null"), "q").count() == 2
    with pytest.raises(Exception, match="prohibited: root_cause_service"):
        prepare.leak_free(df, "q").collect()


def test_scalar_files_are_checked_against_the_index(spark, tmp_path, rows):
    for name, t in (("c1", " 10\n"), ("c2", "20")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "inject_time.txt").write_text(t)
    files = prepare.scalar_files(spark, f"{tmp_path}/*/inject_time.txt")
    assert rows(files) == [("c1", 10), ("c2", 20)]
    index = spark.createDataFrame([("c1", 10), ("c2", 20), ("c3", 30)], "case_id string, inject_time bigint")
    assert prepare.cross_checked(index, files, "inject_time").count() == 3
    bad = spark.createDataFrame([("c2", 21)], "case_id string, inject_time bigint")
    with pytest.raises(Exception, match="differs from its file: c2"):
        prepare.cross_checked(bad, files, "inject_time").collect()


def test_alerts_are_summed(spark):
    """normal 10 x 10, a spike of 50 in the window from 10 to 15: one alert for a, none for b and c."""
    metrics = [("k", "a", "a_cpu", t, 50.0 if t == 12 else 10.0) for t in range(16)] + [("k", "b", "b_cpu", t, 10.0) for t in range(16)] + [("k", "c", "c_cpu", t, 50.0 if t == 20 else 10.0) for t in range(21)]
    m = spark.createDataFrame(metrics, "case_id string, entity string, metric string, ts bigint, value double")
    u = spark.createDataFrame([("k", x) for x in "abc"], "case_id string, entity string")
    none_s = spark.createDataFrame([], "case_id string, service string, start_us bigint, duration_us bigint")
    none_l = spark.createDataFrame([], "case_id string, container string, timestamp bigint, message string")
    got = {r.entity: (r.score, r.rank) for r in ranking.alerts(m, none_s, none_l, u, 10, 15, "error").collect()}
    assert got == {"a": (1.0, 1), "b": (0.0, 2), "c": (0.0, 3)}
    spans = spark.createDataFrame([("k", "b", 1_000_000, 10), ("k", "b", 11_000_000, 30), ("k", "c", 1_000_000, 10), ("k", "c", 11_000_000, 29)], none_s.schema)
    said = spark.createDataFrame([("k", "c", 11, "an error"), ("k", "c", 12, "error again"), ("k", "c", 9, "error"), ("k", "b", 11, None)], none_l.schema)
    got = {r.entity: r.score for r in ranking.alerts(m, spans, said, u, 10, 15, "error").collect()}
    assert got == {"a": 1.0, "b": 1.0, "c": 2.0}


def test_rerank_and_next_query(spark, rows):
    r = spark.createDataFrame([("k", x, i + 1) for i, x in enumerate("abcde")], "case_id string, entity string, rank int")
    relief = spark.createDataFrame([("k", "b", 0.5), ("k", "c", 0.5), ("k", "a", -1.0), ("k", "e", 9.0)], "case_id string, entity string, relief double")
    got = sorted(ranking.rerank_head(r, relief, 3).collect(), key=lambda x: x.new_rank)
    assert [x.entity for x in got] == ["b", "c", "a", "d", "e"]
    c = spark.createDataFrame([("k", "s", "traces", 0.9), ("k", "s", "logs", 0.9), ("k", "a", "logs", 0.9), ("k", "a", "metrics", 0.95)], "case_id string, service string, tool string, priority double")
    none = spark.createDataFrame([], "case_id string, service string, tool string")
    assert rows(ranking.next_query(c, none, 9), "service", "tool", "cost") == [("a", "metrics", 1)]
    asked = spark.createDataFrame([("k", "a", "metrics")], none.schema)
    assert rows(ranking.next_query(c, asked, 9), "service", "tool", "cost") == [("s", "traces", 3)]
    assert rows(ranking.next_query(c, asked, 3), "service", "tool", "cost") == [("a", "logs", 2)]
    assert ranking.next_query(c, asked, 1).count() == 0


def test_rates_without_a_denominator_are_null(spark):
    s = "method string, status string, abstained boolean, authorized boolean, top_1 int, recovered boolean, regressed boolean, queries int, runtime double"
    data = [("m", "SUCCESS", False, True, 1, True, False, 2, 1.0), ("m", "SUCCESS", True, True, 0, False, True, 2, 3.0), ("m", "FAILED", None, None, None, None, None, None, 9.0), ("n", "SUCCESS", None, None, 1, None, None, None, None)]
    got = {r.method: r for r in evaluation.outcome_rates(spark.createDataFrame(data, s)).collect()}
    m, n = got["m"], got["n"]
    assert (m.cases, m.evaluated, m.abstention_rate, m.false_remediation_rate, m.recovery_rate, m.regression_rate, m.query_efficiency, m.mean_runtime) == (3, 2, pytest.approx(2 / 3), 0.5, 0.5, 0.5, 0.25, 2.0)
    assert (n.abstention_rate, n.false_remediation_rate, n.recovery_rate, n.query_efficiency, n.mean_runtime) == (0.0, None, None, None, None)


def test_availability(spark):
    chosen = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "case_id string")
    index = spark.createDataFrame([("a", 3, True, 0, None, 5), ("b", 0, None, 2, False, None)], "case_id string, n_metrics int, has_logs boolean, n_logs int, has_traces boolean, n_traces int")
    assert tuple(evaluation.availability(chosen, index).first()) == (3, 1, 2, 1, 1, 2, 1, 2)


def test_leak_free_split(spark):
    df = spark.createDataFrame([(f"c{i}", f"f{i // 3}", None, "x") for i in range(60)], "case_id string, fault string, system string, partition string")
    got = evaluation.leak_free_split(df, ["fault", "system"]).collect()
    of = {r.case_id: r.partition for r in got}
    assert all(len({of[f"c{i}"] for i in range(3 * f, 3 * f + 3)}) == 1 for f in range(20))
    assert {p: sum(r.partition == p for r in got) for p in ("dev", "val", "held_out")} == {"dev": 30, "val": 15, "held_out": 15}
    with pytest.raises(Exception, match="listed twice: c0"):
        evaluation.leak_free_split(df.unionAll(df.limit(1)), ["fault"]).collect()
    with pytest.raises(ValueError):
        evaluation.leak_free_split(df, ["fault"], 0.8, 0.3)


def test_floor_percentile_and_graded(spark, rows):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("b", 1.0), ("a", None)], "g string, v double")
    assert rows(evaluation.floor_percentile(df, ["g"], "v", 0.95)) == [("a", 20, 19.0), ("b", 1, 1.0)]
    assert rows(evaluation.floor_percentile(df, ["g"], "v", 0.5)) == [("a", 20, 10.0), ("b", 1, 1.0)]
    notes = spark.createDataFrame([("q1", "x1", 1), ("q1", "x2", 2), ("q1", "x3", 0), ("q2", "x1", 0), ("q9", "x1", 2), ("q1", "x9", 2)], "pool_query string, pool_doc string, grade int")
    qs = spark.createDataFrame([("q1", "A"), ("q2", "B")], "pool_query string, query string")
    ds = spark.createDataFrame([("x1", "d"), ("x2", "d"), ("x3", "e")], "pool_doc string, doc string")
    assert rows(evaluation.graded(notes, qs, ds), "query", "doc", "grade") == [("A", "d", 2), ("A", "e", 0)]


def test_sign_flips_are_those_of_all_families(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.3, 1, 40)
    paired = spark.createDataFrame([(f"c{i}", float(x), 0.0) for i, x in enumerate(d)], "case_id string, a double, b double")
    fam = spark.createDataFrame([(f"c{i}", f"f{i // 2}") for i in range(40)], "case_id string, family string")
    one = evaluation.randomization_test(paired, fam, 4000).first()
    two = evaluation.randomization_test(paired.repartition(7), fam.repartition(3), 4000).first()
    sums = d.reshape(20, 2).sum(1)
    want = np.mean([abs((sums * rng.choice([-1, 1], 20)).sum()) >= abs(d.sum()) - 1e-12 for _ in range(20000)])
    assert one.p_value == two.p_value == pytest.approx(want, abs=0.03) and one.difference == pytest.approx(d.mean())


def test_verdict_of_an_intervention(spark):
    s = "case_id string, service string, anomaly_score double, latency_p90 double, error_rate double"
    before = [("ok", "a", 0.9, 150.0, 3.0), ("ok", "b", 0.1, 50.0, 0.0), ("part", "a", 0.9, 0.0, 0.0), ("part", "b", 0.8, 0.0, 0.0), ("none", "a", 0.9, 0.0, 0.0), ("worse", "a", 0.9, 0.0, 0.0), ("worse", "b", 0.1, 0.0, 0.0), ("fell", "a", 1.0, 0.0, 0.0)]
    after = [("ok", "a", 0.1, 90.0, 0.0), ("ok", "b", 0.1, 50.0, 0.0), ("part", "a", 0.1, 0.0, 0.0), ("part", "b", 0.7, 0.0, 0.0), ("none", "a", 0.9, 0.0, 0.0), ("worse", "a", 0.1, 0.0, 0.0), ("worse", "b", 0.5, 0.0, 0.0), ("fell", "a", 0.35, 0.0, 0.0), ("new", "z", 0.1, 0.0, 0.0)]
    t = spark.createDataFrame([(c, "a") for c in ("ok", "part", "none", "worse", "fell", "new")], "case_id string, target string")
    got = {r.case_id: (r.recovered, r.unresolved, r.regressions, r.status, r.support) for r in scores.verify_recovery(spark.createDataFrame(before, s), spark.createDataFrame(after, s), t).collect()}
    assert got == {
        "ok": (3, 0, 0, "RESOLVED", "SUPPORTS"), "part": (1, 1, 0, "UNCERTAIN", "INCONCLUSIVE"), "none": (0, 1, 0, "NOT_RESOLVED", "CONTRADICTS"),
        "worse": (1, 0, 1, "NOT_RESOLVED", "CONTRADICTS"), "fell": (1, 0, 0, "RESOLVED", "SUPPORTS"), "new": (0, 0, 0, "RESOLVED", "SUPPORTS"),
    }


def test_incident_texts(spark):
    df = spark.createDataFrame([("k", "shop", ["cart", "pay"], ["cart cpu"], ["a -> b"], None), ("e", None, None, None, None, ["grpc status 13"])], "case_id string, system string, services array<string>, metrics array<string>, calls array<string>, logs array<string>")
    got = {r.case_id: r for r in retrieval.incident_queries(df).collect()}
    assert got["k"].category == "cpu" and got["k"].primary == "Microservice incident in shop on cart (cart, pay). Observed condition: anomalous metrics: cart cpu; degraded calls: a -> b. Troubleshooting procedures, diagnostic commands, and failure triage."
    assert got["e"].category == "grpc" and "in microservices on service ()" in got["e"].primary


def test_prefix_queries_see_nothing_later(spark):
    p = [("k", "a_cpu", i, 100 + i, 1.0 if i < 5 else 9.0, i >= 5) for i in range(8)] + [("k", "b-x_mem", i, 100 + i, 5.0 if i < 5 else 1.0, i in (5,)) for i in range(8)] + [("q", "a_cpu", 0, 100, 1.0, False)]
    logs = [("k", 101, "a", "error 500 at deadbeef99"), ("k", 102, "a", "error 501 at deadbeef11"), ("k", 106, "a", "failed late"), ("k", 103, "b", "fine")]
    spans = [("k", "a", 104_000_000), ("k", "z", 106_000_000)]
    got = retrieval.prefix_queries(
        spark.createDataFrame(p, "case_id string, metric string, obs_idx int, ts bigint, value double, is_anomaly boolean"),
        spark.createDataFrame(logs, "case_id string, timestamp bigint, container string, message string"),
        spark.createDataFrame(spans, "case_id string, service string, start_us bigint"), retrieval.PREFIX_ERROR,
    ).collect()
    assert [tuple(r) for r in got] == [("k", 105, "Observed service telemetry shows a cpu increased; b x mem decreased; a logs report error <n> at <id>; traces include services a. What operational guidance is relevant to investigating this condition?")]


def test_search_is_exact_over_blocks_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[5] = v[6]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "doc bigint, vec array<double>")
    q = df.where("doc < 40").select(F.col("doc").alias("query"), "vec")
    got = {}
    for block in (7, 1000):
        got[block] = sorted((r.query, r["rank"], r.doc, r.score) for r in retrieval.dense(df, q, 5, block).collect())
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = []
    for i in range(40):
        s = np.round(u @ u[i], 6)
        want += [(i, k + 1, int(j), float(s[j])) for k, j in enumerate(np.lexsort((np.arange(300), -s))[:5])]
    assert got[7] == got[1000] == [pytest.approx(x) for x in want]
    assert retrieval.dense(df, q.limit(0), 5).count() == 0


def test_closure_of_a_long_chain_is_whole(spark):
    chain = spark.createDataFrame([("k", f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)], "case_id string, src string, dst string")
    assert graph.reach(chain).count() == 45


def test_late_rows_are_dropped_and_windows_close(spark, tmp_path):
    from lantern.streaming import online

    cols = "event_id bigint, ts string, user_id bigint, event_type string, value double, props string"
    folder = tmp_path / "in"
    for i, times in enumerate((["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 09:00:00"], ["2024-01-01 00:20:00", "2024-01-01 20:00:00"])):
        df = spark.createDataFrame([(i, t, 1, "view", 1.0, "{}") for t in times], cols).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(online.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.start_ts: r.n for r in online.drain(online.tumbling(stream)).collect()}
    hour = lambda h: 1704067200 + 3600 * h
    # The row of 00:20 comes a batch after the watermark has passed 03:00; the window of 20:00 isn't closed yet.
    assert got == {hour(0): 1, hour(5): 1, hour(9): 1}


def test_sections_and_commands(spark):
    long = "words " * 20
    text = long + "\n## The `first` *one*  \n" + long + "\n#no heading\n### Short\nx\n```bash\n ls \n```\n```\n\n```\n```sh\na\nb\n```"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc int, text string")
    assert [(r.doc, r.ordinal, r.heading) for r in retrieval.sections(df).collect()] == [(1, 0, "Document overview"), (1, 1, "The first one")]
    got = {r.doc: (r.command_blocks, r.commands) for r in retrieval.flags(df).collect()}
    assert got == {1: (3, ["ls", "a\nb"]), 2: (0, []), 3: (0, [])}
    assert retrieval.chunks(spark.createDataFrame([(1, "too short")], "doc int, text string")).count() == 0


def test_linear_gain_needs_a_high_grade(spark):
    ranks = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 7, 1)], "query int, doc int, rank int")
    rel = spark.createDataFrame([(1, 8, 2), (1, 9, 1), (2, 7, 1)], "query int, doc int, grade int")
    got = {r.query: r for r in retrieval.quality(ranks, rel).collect()}
    d = 1 / np.log2(3)
    assert got[1].ndcg_5 == pytest.approx(2 * d / (2 + d), abs=1e-8) and got[1].ndcg_exp_5 == pytest.approx(3 * d / (1 + d), abs=1e-8) and got[1].precision_5 == 0.2
    assert got[2].ndcg_5 is None and got[2].ndcg_exp_5 == 1.0


def test_vector_cache_and_reports(spark, tmp_path):
    from lantern.sources import tables

    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 1.0)], "id int, v double")
    keys = {tables.embedding_key(x, "id").first().cache_key for x in (df, df.where("id = 2"), df.limit(0), df.where("id = 1"))}
    assert len(keys) == 4  # equal ids don't cancel out
    a = tables.cached_vectors(df, "id", str(tmp_path / "c"))
    other = df.withColumn("v", F.col("v") + 1)
    assert a.count() == 3 and sorted(r.v for r in tables.cached_vectors(other, "id", str(tmp_path / "c")).collect()) == [0.5, 0.5, 1.0]
    tables.write_report(df, str(tmp_path / "r"), "2")
    assert tables.read_report(spark, str(tmp_path / "r"), "2").count() == 3
    with pytest.raises(Exception, match="report of version 2"):
        tables.read_report(spark, str(tmp_path / "r"), "3").collect()


def test_index_ratio_and_keys(spark, rows):
    from lantern.functions import scalars

    df = spark.createDataFrame([("a", 5, 2), ("a", 5, 1), ("a", None, 3), ("b", 1, 1)], "k string, t int, o int")
    assert rows(prepare.ordered_index(df, ["k"], "t", "o"), "k", "o", "obs_idx") == [("a", 1, 1), ("a", 2, 2), ("a", 3, 0), ("b", 1, 0)]
    pairs = spark.createDataFrame([("x", 4.0, 1.0), ("y", 1.0, 1.0), ("z", 0.0, 1.0)], "case_id string, a double, b double")
    assert tuple(evaluation.geometric_ratio(pairs).first())[::2] == (2, 2.0)
    m = spark.createDataFrame([({"b": "2"},), ({"a": "1", "b": "2"},), (None,)], "m map<string,string>")
    assert [r.v for r in m.select(scalars.first_of(F.col("m"), "a", "b").alias("v")).collect()] == ["2", "1", None]


def test_tool_evidence_and_leaks(spark, rows):
    from lantern.operators import evidence

    u = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "a")], "case_id string, entity string")
    ev = spark.createDataFrame([("k", "a", 3, True)], "case_id string, entity string, peak_active int, has_episode boolean")
    el = spark.createDataFrame([("k", "b", 0.25)], "case_id string, entity string, score double")
    lo = spark.createDataFrame([("k", "a", "an error"), ("k", "a", "deploy done"), ("k", "a", None)], "case_id string, container string, message string")
    ed = spark.createDataFrame([("k", "a", "b"), ("k", "b", "a"), ("k", "a", "a")], "case_id string, src string, dst string")
    got = {(r.entity, r.tool): (r.cost, r.value) for r in evidence.tool_evidence(u, ev, el, lo, ed, "error").collect()}
    assert got == {
        ("a", "metrics"): (1, 3.0), ("a", "traces"): (3, 0.0), ("a", "logs"): (2, 1.0), ("a", "neighbours"): (1, 1.0), ("a", "health"): (1, 1.0), ("a", "change"): (2, 1.0),
        ("b", "metrics"): (1, 0.0), ("b", "traces"): (3, 0.25), ("b", "logs"): (2, 0.0), ("b", "neighbours"): (1, 1.0), ("b", "health"): (1, 0.0), ("b", "change"): (2, 0.0),
    }
    c = spark.createDataFrame([("f", "dev"), ("f", "val"), ("f", "dev"), ("g", "dev"), (None, "dev"), (None, "val"), ("g", None)], "fam string, part string")
    assert rows(evaluation.leaked(c, "fam", "part")) == [("f", ["dev", "val"], 3)]
