import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lantern.llm import rankwalk

NAN, INF = float("nan"), float("inf")
S = "g string, item string, a double, b double, _group string, stationarity double"


def brute(items, steps=300, damping=0.85):
    """The chain as a matrix of pairs."""
    names = sorted(items)
    n = len(names)
    p = np.zeros((n, n))
    for k in range(2):
        v = [-1e308 * 10 if False else items[x][k] for x in names]
        none = [x is None or x != x for x in v]
        for i in range(n):
            up = [j for j in range(n) if not none[j] and (none[i] or v[j] > v[i])] + [i]
            for j in up:
                p[i, j] += 0.5 / len(up)
    q = np.full(n, 1 / n)
    for _ in range(steps):
        q = (1 - damping) / n + damping * q @ p
    return dict(zip(names, q, strict=True))


def walk(spark, groups, **kw):
    rows = [(g, x, *v, "c", 0.0) for g, items in groups.items() for x, v in items.items()]
    return {(r.g, r.item): r for r in rankwalk.rank_walk(spark.createDataFrame(rows, S), "g", "item", ["a", "b"], **kw).collect()}


GROUPS = {
    "x": {"p": (1.0, 1e9), "q": (0.9, 5e8), "r": (0.1, 1.0), "s": (None, NAN)},
    "ties": {"p": (1.0, 1.0), "q": (1.0, 1.0), "r": (1.0, None)},
    "none": {"b": (None, None), "a": (NAN, None)},
    "inf": {"a": (INF, -INF), "b": (1.0, 0.0), "c": (-INF, INF)},
    "one": {"z": (None, 3.0)},
}


def test_against_the_matrix(spark):
    got = walk(spark, GROUPS)
    for g, items in GROUPS.items():
        for x, p in brute(items).items():
            assert got[g, x].stationarity == pytest.approx(p, abs=2e-9)
    assert got["x", "p"].place == 1 and got["none", "a"].place == 1 and got["ties", "p"].place == 1


def test_heavy_groups_walk_the_same(spark):
    groups = {"big": {f"i{i}": (float(i % 5), float((i * 7) % 11) if i % 4 else None) for i in range(30)}}
    light, heavy = walk(spark, groups, steps=6), walk(spark, groups, steps=6, heavy_rows=10)
    want = brute(groups["big"], 6)
    for k in light:
        assert light[k].stationarity == pytest.approx(want[k[1]], abs=2e-9) == heavy[k].stationarity
        assert light[k].place == heavy[k].place


@pytest.mark.parametrize("heavy_rows", [50_000, 10])
def test_large_groups_are_ordered_by_their_scores(spark, heavy_rows):
    n, rng = 4000, np.random.default_rng(8)
    a, b = (rng.permutation(n).astype(float).tolist() for _ in range(2))
    p = rankwalk._stationary(np.zeros(n, int), np.array([n]), [np.array(a), np.array(b)], 0.85, 4, 0.0)
    got = walk(spark, {"big": {f"i{i:04d}": (a[i], b[i]) for i in range(n)}}, steps=4, heavy_rows=heavy_rows)
    laid = [p[int(k[1][1:])] * n for k, _ in sorted(got.items(), key=lambda x: x[1].place)]
    assert np.diff(laid).max() < 2e-9


def test_range_of_a_score_is_irrelevant(spark):
    a = walk(spark, GROUPS)
    b = walk(spark, {g: {x: (v[0], None if v[1] is None else v[1] * 1000 if v[1] > 0 else v[1]) for x, v in i.items()} for g, i in GROUPS.items()})
    assert {k: r.place for k, r in a.items()} == {k: r.place for k, r in b.items()}


def test_empty_and_null_keys(spark):
    assert rankwalk.rank_walk(spark.createDataFrame([], S), "g", "item", ["a", "b"]).count() == 0
    df = spark.createDataFrame([(None, "x", 1.0, 1.0, "", 0.0), (None, None, 2.0, 2.0, "", 0.0), (None, "x", 1.0, 1.0, "", 0.0)], S)
    assert {(r.g, r.item, r.place) for r in rankwalk.rank_walk(df, "g", "item", ["a", "b"]).collect()} == {(None, None, 1), (None, "x", 2)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 4))), min_size=1, max_size=7), min_size=1, max_size=4))
def test_prefix_sums_equal_pairs(groups):
    sizes = np.array([len(g) for g in groups])
    ids = np.repeat(np.arange(len(groups)), sizes)
    cols = [np.array([np.nan if v[k] is None else float(v[k]) for g in groups for v in g]) for k in range(2)]
    p = rankwalk._stationary(ids, sizes, cols, 0.85, 200, 0.0)
    assert p.sum() == pytest.approx(len(groups))
    at = 0
    for g in groups:
        want = brute({f"{i:02d}": v for i, v in enumerate(g)}, 200)
        assert p[at : at + len(g)] == pytest.approx([want[k] for k in sorted(want)], abs=1e-9)
        at += len(g)


def test_profiles(spark):
    cols = "profile_id bigint, case_id string, entity string, service_id string, a double, b double, scored_at int, ingested_at int, extra string"
    df = spark.createDataFrame([(1, "c", "", "s", 1.0, 1.0, 1, 1, ""), (1, "c", "", "s", 2.0, 1.0, 1, 5, ""), (2, "c", "t", None, 3.0, None, 1, 1, ""), (3, "c", None, "", 9.0, 9.0, 1, 1, "")], cols)
    assert sorted((r.service, r.a) for r in rankwalk.valid_profiles(df, ["a", "b"]).collect()) == [("s", 2.0), ("t", 3.0)]


def test_a_group_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(12)
    sizes = np.array([5, 900, 16, 17, 1, 16, 40])
    cols = [np.where(rng.random(sizes.sum()) < 0.1, np.nan, rng.integers(0, 9, sizes.sum()).astype(float)) for _ in range(3)]
    together = rankwalk._stationary(np.repeat(np.arange(len(sizes)), sizes), sizes, cols, 0.85, 300, 1e-12)
    at = 0
    for n in sizes:
        alone = rankwalk._stationary(np.zeros(n, int), np.array([n]), [c[at : at + n] for c in cols], 0.85, 300, 1e-12)
        assert (alone == together[at : at + n]).all()
        at += n


def test_a_group_of_100_000_items_walks_as_the_arrays_do(spark):
    """Beyond ``heavy_rows`` the same chain runs as DataFrames; its order is that of the arrays to the last place."""
    n, rng = 100_000, np.random.default_rng(21)
    a, b = rng.permutation(n).astype(float), np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 40_000, n).astype(float))
    p = np.round(rankwalk._stationary(np.zeros(n, int), np.array([n]), [a, b], 0.85, 2, 0.0) * n, rankwalk.DIGITS)
    df = spark.createDataFrame(pd.DataFrame({"g": "big", "item": [f"i{i:06d}" for i in range(n)], "a": a, "b": b})).repartition(8)
    got = rankwalk.rank_walk(df, "g", "item", ["a", "b"], steps=2).toPandas().sort_values("place")
    assert len(got) == n and (got["place"].to_numpy() == np.arange(1, n + 1)).all()
    want = np.lexsort((np.arange(n), -p))
    mine = got["item"].str[1:].astype(int).to_numpy()
    assert np.abs(p[mine] - p[want]).max() < 2e-9
    assert (mine == want).mean() > 0.999
