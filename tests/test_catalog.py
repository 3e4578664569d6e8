"""The registered queries against their SQL twins, on the smallest tables; the driver compares all of them on larger ones."""

import pytest
from oracle import compare

from lantern.plans import catalog

FOLDER = "/root/testdata/sf0.001"
SOME = ["zscore_points", "entity_episodes", "rank_s_comb", "rank_rca_d", "edge_attribution", "span_decomposition", "interval_union", "distribution_summary", "case_metrics", "method_aggregate", "detection_rollup", "bm25_topk", "tfidf_topk", "dense_topk", "ridge_residuals", "evidence_fusion", "stream_tumbling", "stream_zscore"]


def test_every_twin_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and set(SOME) <= set(catalog.ORACLES)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    assert compare(spark, name, FOLDER)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_the_rest_does_without_the_subpackage():
    """Nothing outside the subpackage for training data imports it, but for the guarded import of the entry."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "lantern"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "lantern.llm" in p.read_text()]


@pytest.mark.parametrize("name, operator", [("randomization_p", "randomization_test"), ("bootstrap_ci", "cluster_bootstrap")])
def test_all_replicates_are_drawn(spark, monkeypatch, name, operator):
    import inspect

    from lantern.operators import evaluation

    told, asked = inspect.signature(getattr(evaluation, operator)), []
    monkeypatch.setattr(evaluation, operator, lambda *x, **y: asked.append(told.bind(*x, **y)))
    catalog.QUERIES[name](spark, FOLDER)
    asked[0].apply_defaults()
    assert asked[0].arguments["replicates"] == 10_000
