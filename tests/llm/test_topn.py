from pyspark.sql import functions as F

from lantern.llm import topn

S = "g string, item string, score double, _h0 string, place int, _rows int"


def brute(data, n):
    best = {}
    for g in {r[0] for r in data}:
        ok = sorted((r for r in data if r[0] == g and r[2] is not None and r[2] == r[2] and abs(r[2]) != float("inf")), key=lambda r: (-r[2], r[1]))
        best |= {(g, i + 1): r[1] for i, r in enumerate(ok[:n])}
    return best


def test_hot_and_cold_agree(spark):
    data = [("hot", f"i{i:03d}", float(i % 7)) for i in range(300)] + [(f"g{i}", f"x{j}", float(j)) for i in range(20) for j in range(4)]
    data += [(None, "n", 1.0), ("bad", "a", float("nan")), ("bad", "b", None), ("bad", "c", float("inf")), ("bad", "d", -1.0)]
    df = spark.createDataFrame([(*r, "z", 9, 9) for r in data], S)
    for heavy in (10, 10_000):
        got = {(r.g, r.place): r.item for r in topn.top_n(df, ["g"], "score", "item", 3, heavy).collect()}
        assert got == brute(data, 3)


def test_ties_go_by_name_and_repeats_take_a_place(spark):
    df = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "a", 1.0)], "g string, item string, score double")
    assert [(r.item, r.place) for r in topn.top_n(df, ["g"], "score", "item", 2).orderBy("place").collect()] == [("a", 1), ("a", 2)]


def test_latest_revision_counts(spark):
    df = spark.createDataFrame([("g", "a", 9.0, 1), ("g", "a", None, 2), ("g", "b", 1.0, 1), ("g", "b", 1.0, 1), ("g", "c", 0.5, None)], "g string, item string, score double, at int")
    prepare = lambda x: topn.latest(x, ["g", "item"], "at", ["score"])
    got = topn.top_n(df, ["g"], "score", "item", 3, prepare=prepare).orderBy("place").collect()
    assert [r.item for r in got] == ["b", "c"]


def test_empty(spark):
    df = spark.createDataFrame([], "g string, item string, score double")
    assert topn.top_n(df, ["g"], "score", "item", 3).count() == 0


def test_number_of_heavy_groups_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(topn, "MOST_HEAVY", 2)
    df = spark.range(40).select((F.col("id") % 4).cast("string").alias("g"), F.col("id").cast("string").alias("item"), F.col("id").cast("double").alias("score"))
    got = topn.top_n(df, ["g"], "score", "item", 1, 3)
    assert sorted(r.item for r in got.collect()) == ["36", "37", "38", "39"]


def test_more_heavy_groups_than_are_broadcast_are_all_heavy(spark, monkeypatch):
    monkeypatch.setattr(topn, "MOST_HEAVY", 2)
    df = spark.range(400).select((F.col("id") % 9).cast("string").alias("g"), F.col("id").alias("item"))
    light, heavy = topn.split_heavy(df, ["g"], 10)
    assert light.count() == 0 and heavy.count() == 400
