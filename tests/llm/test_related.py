import random
from collections import defaultdict

import pytest

from lantern.llm import related

S = "id string, a string, b string, unit string, node string"


def components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, b in rows:
        find(("r", i))
        for k, v in (("a", a), ("b", b)):
            if v is not None:
                parent[find(("r", i))] = find((k, v))
    out = defaultdict(set)
    for i, *_ in rows:
        out[find(("r", i))].add(i)
    return {frozenset(v) for v in out.values()}


def test_units_and_forest(spark):
    rng = random.Random(5)
    rows = [(f"n{i}", rng.choice([None, f"a{rng.randrange(40)}"]), rng.choice([None, None, f"b{rng.randrange(50)}"])) for i in range(120)]
    rows += [(f"hot{i}", "hub", None) for i in range(60)] + rows[:3]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], S)
    got = defaultdict(set)
    for r in related.units(df, "id", ["a", "b"]).collect():
        got[r.unit].add(r.id)
    assert {frozenset(v) for v in got.values()} == components(rows)
    edges = related.link_edges(df, "id", ["a", "b"])
    forest, roots = related.spanning_forest(edges)
    nodes = roots.count()
    assert forest.count() == nodes - roots.select("root").distinct().count()  # a tree for each root


def test_splits_keep_units_and_follow_shares(spark):
    df = spark.createDataFrame([(f"n{i}", f"a{i // 3}", None, "", "") for i in range(600)], S)
    unit_of = related.units(df, "id", ["a"])
    rows = related.deal(unit_of, "id", {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    by = defaultdict(set)
    for r in rows:
        by[r.unit].add(r.split)
    assert all(len(s) == 1 for s in by.values()) and len(rows) == 600
    n = {s: sum(r.split == s for r in rows) for s in ("train", "val", "test")}
    assert abs(n["train"] - 480) <= 9 and abs(n["val"] - 60) <= 9
    again = related.deal(unit_of, "id", {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_breaches(spark, rows):
    u = spark.createDataFrame([("1", "u"), ("2", "u"), ("3", "w")], "id string, unit string")
    now = spark.createDataFrame([("1", "train"), ("2", "val"), ("3", None)], "id string, s string")
    assert rows(related.breaches(u, now, "id", "s"), "id", "splits") == [("1", ["train", "val"]), ("2", ["train", "val"])]


def test_no_links_and_empty(spark):
    df = spark.createDataFrame([("1", None, None, "", ""), ("1", None, None, "", ""), (None, "a", "b", "", "")], S)
    assert related.units(df, "id", ["a", "b"]).count() == 1
    empty = related.units(spark.createDataFrame([], S), "id", ["a", "b"])
    assert empty.count() == 0 and related.deal(empty, "id", {"x": 1.0}).count() == 0


def test_valid_cases(spark):
    cols = "case_id string, dataset string, system string, fault string, root_cause_service string, repetition int, partition string, suite string, listed_at int"
    df = spark.createDataFrame([("c", "RX1-HX", " HX", "Disk ", "hx_bed store", 1, "Held Out", "", 1), ("c", "RX1-HX", "hx", "disk", "HX-Bed-Store", 1, " held-out", None, 2), ("d", "RX1-HX", "hx", "disk", None, 1, None, "rx1", 1)], cols)
    got = {r.case_id: (r.family, r.partition) for r in related.valid_cases(df).collect()}
    assert got == {"c": ("rx1|hx|hx-bed-store|disk", "held_out"), "d": (None, None)}


@pytest.mark.parametrize(
    ("sizes", "shares"),
    [
        ([1024, 576, *[1] * 400], {"train": 0.8, "val": 0.1, "test": 0.1}),
        ([2**i for i in range(11)], {"dev": 0.5, "val": 0.25, "held_out": 0.25}),
        ([700, 90, 60, 33, 31, 20, 9, 8, 8, 7, 5, 4, 3, 3, 2, 2, 1, 1, 1], {"a": 0.4, "b": 0.3, "c": 0.3, "none": 0.0}),
    ],
)
def test_no_split_misses_its_share_by_more_than_the_largest_unit(spark, sizes, shares):
    rows = [(f"{u}-{i}", f"u{u}") for u, n in enumerate(sizes) for i in range(n)]
    got = related.deal(spark.createDataFrame(rows, "id string, unit string"), "id", shares).collect()
    assert len(got) == len(rows) and len({(r.unit, r.split) for r in got}) == len(sizes)
    for s, v in shares.items():
        assert abs(sum(r.split == s for r in got) - v * len(rows)) <= max(sizes)


def test_lone_large_units_leave_the_shares_whole_where_they_can(spark):
    rows = [(f"{u}-{i}", f"u{u}") for u, n in enumerate([1024, 576, *[1] * 400]) for i in range(n)]
    got = related.deal(spark.createDataFrame(rows, "id string, unit string"), "id", {"train": 0.8, "val": 0.1, "test": 0.1}).collect()
    assert {s: sum(r.split == s for r in got) for s in ("train", "val", "test")} == {"train": 1600, "val": 200, "test": 200}
