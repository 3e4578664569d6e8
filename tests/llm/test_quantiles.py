import math
import random
import struct

import numpy as np
from pyspark.sql import functions as F

from lantern.llm import quantiles as q

EDGE = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-300, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 2.0, 4.0, 3.9999999999999996, 8.000000000000002, 1e15, 1e22, 0.3333333333333333]


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -n if x < 0 else n


def test_map_is_the_bit_pattern_and_inverts(spark):
    rng = random.Random(1)
    values = EDGE + [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(3000)] + [2.0**k * (1 + s * 2.0**-52) for k in range(-1000, 1000, 37) for s in (0, 1)] + [math.nextafter(2.0**k, 0) for k in range(-1000, 1000, 41)]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("v", q.to_ordered(F.col("x"))).withColumn("y", q.from_ordered(F.col("v")))
    for r in df.collect():
        assert r.v == bits(r.x) and r.y == r.x
    assert spark.createDataFrame([(None,), (float("nan"),)], "x double").where(q.to_ordered(F.col("x")).isNotNull()).count() == 0


def test_exact_equals_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.lognormal(3, 4, 3001), "b": np.round(rng.normal(0, 5, 500), 1), "c": np.array([7.0]), "d": np.array([1.0] * 50 + [9.0] * 51), None: np.array([1.0, 2.0])}
    rows = [(g, float(v), "x") for g, vs in groups.items() for v in vs] + [("a", None, "x"), ("a", float("nan"), "x"), ("e", None, "x")]
    df = spark.createDataFrame(rows, "k string, x double, digit string").withColumn("_v", q.to_ordered(F.col("x")))
    got = {(r.k, r.q): (r.n, r.value) for r in q.exact(df, ["k"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert len(got) == 25
    for (k, p), (n, v) in got.items():
        assert n == len(groups[k]) and math.isclose(v, np.quantile(groups[k], p), rel_tol=1e-12, abs_tol=1e-300)


def test_digests_add_up_and_are_bounded(spark):
    rng = np.random.default_rng(3)
    rows = [("k", day, float(v)) for day in range(5) for v in rng.lognormal(0, 2, 400)]
    df = spark.createDataFrame(rows, "k string, day int, x double").withColumn("_v", q.to_ordered(F.col("x")))
    days = q.digest(df, ["k", "day"])
    some = q.merge(days.where("day in (1, 3)"), ["k"])
    r = q.bounded(some, ["k"], 0.5).first()
    part = sorted(x for _, d, x in rows if d in (1, 3))
    true = part[math.ceil(len(part) * 0.5) - 1]
    assert r.n == 800 and r.low <= true < r.high and (r.high - r.low) / r.low <= 2**-7
    whole = q.exact(df.where("day in (1, 3)"), ["k"], [0.5], digests=days.where("day in (1, 3)").drop("day")).first()
    assert math.isclose(whole.value, float(np.median(part)), rel_tol=1e-12)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, _v bigint")
    assert q.exact(df, ["k"], [0.5]).count() == 0


def test_the_map_in_steps_is_the_map(spark):
    rng = random.Random(9)
    values = [*EDGE, None, float("nan"), *[rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(500)]]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(values)], "i int, x double, y double")
    got = {r.i: (r.x, r.y) for r in q.with_ordered(df, ["x", "y"]).collect()}
    for i, v in enumerate(values):
        want = None if v is None or v != v else bits(v)
        assert got[i] == (want, want)
