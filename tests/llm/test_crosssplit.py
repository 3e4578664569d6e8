import random

from pyspark.sql import functions as F

from lantern.llm import crosssplit

S = "record_id bigint, split string, case_id string, query string, side string, _cls string"


def text(rng, k):
    svc = [f"svc-{rng.randrange(60)}-store" for _ in range(4)]
    kinds = [
        lambda: f"queue depth on {rng.choice(svc)} crossed {rng.randrange(900)}.{rng.randrange(99)} deviations at step {rng.randrange(90)} and stayed there",
        lambda: f"callers of {rng.choice(svc)} wait {rng.randrange(900)} ms at the tail while {rng.choice(svc)} stays near {rng.randrange(99)} ms",
        lambda: f"{rng.randrange(999)} spans of {rng.choice(svc)} calling {rng.choice(svc)} ended with status {rng.choice([13, 429, 500])}",
    ]
    return [rng.choice(kinds)() for _ in range(k)]


def make():
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(150):
        rows.append((i, "train", f"t_{i}", "Seen so far: " + "; ".join(text(rng, 6)) + ". What now?"))
    for i in range(40):
        src = rows[i][3]
        obs = src.removeprefix("Seen so far: ").removesuffix(". What now?").split("; ")
        kind = i % 4
        if kind == 0:
            obs = obs[1:] if i % 8 else obs
        elif kind == 1:
            rng.shuffle(obs)
        elif kind == 2:
            obs = [o.replace("crossed", "passed").replace("wait", "hold") for o in obs]
        q = ". ".join(obs).upper() if kind == 3 else "; ".join(obs)
        q = __import__("re").sub(r"(\d+)\.\d+", r"\1", q)
        rows.append((1000 + i, ["val", "dev", "final_test"][i % 3], f"e_{i}", "Known: " + q + " Next?"))
        want.add((i, 1000 + i))
    for i in range(60):
        rows.append((2000 + i, "val", f"o_{i}", "Seen so far: " + "; ".join(text(rng, 6)) + ". What now?"))
    return rows, want


def test_changed_copies_are_found_and_nothing_else(spark):
    data, want = make()
    df = spark.createDataFrame([(*r, None, "x") for r in data], S)
    got = {tuple(r) for r in crosssplit.overlaps(df.unionAll(df)).collect()}
    assert got == want


def test_a_family_of_a_third_of_all_texts(spark):
    """All words that the family shares are frequent; its pairs are found nonetheless."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(78)]
    rows = [(i, "train" if i % 2 else "val", None, " ".join(f"x{rng.randrange(10**6)}" for _ in range(78))) for i in range(240)]
    for i in range(1000, 1120):
        ws = list(base)
        for at in rng.sample(range(78), 3):
            ws[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, "train" if i % 2 else "val", None, " ".join(ws)))
    got = {tuple(r) for r in crosssplit.overlaps(spark.createDataFrame([(*r, None, "x") for r in rows], S)).collect()}
    assert got == {(a, b) for a in range(1001, 1120, 2) for b in range(1000, 1120, 2)}


def test_frequent_shared_and_rare_unshared_grams(spark):
    """70 of 112 trigrams are shared, by all of training; the other 42 occur once."""
    base = [f"b{i}" for i in range(72)]
    rows = [(i, "train" if i < 300 else "dev", None, " ".join(base + [f"u{i}x{k}" for k in range(40)])) for i in range(305)]
    got = {tuple(r) for r in crosssplit.overlaps(spark.createDataFrame([(*r, None, "x") for r in rows], S)).collect()}
    assert got == {(a, b) for a in range(300) for b in range(300, 305)}


def test_candidates_miss_no_pair(spark):
    rng = random.Random(6)
    sets = []
    for _ in range(120):
        sets.append({int(60 * rng.random() ** 2) * 0x9E3779B97F4A7C15 % 2**63 for _ in range(rng.randrange(1, 25))})
        near = set(rng.sample(sorted(sets[-1]), max(1, len(sets[-1]) * 3 // 4)))
        sets.append(near | {rng.randrange(2**40) for _ in range(rng.randrange(4))})
    rows = [(i, rng.random() < 0.6, rng.random() < 0.6, sorted(x)) for i, x in enumerate(sets)]
    got = {tuple(r) for r in crosssplit.candidates(spark.createDataFrame(rows, "_cls bigint, _t boolean, _e boolean, _h array<bigint>")).collect()}
    for a, t, _, x in rows:
        for b, _, e, y in rows:
            less, more = sorted((len(x), len(y)))
            if t and e and a != b and less >= 0.5 * more and len(set(x) & set(y)) >= 0.6 * less:
                assert (a, b) in got


def test_cases(spark):
    data = [(1, "Train ", "rx1hx_hx-bed-store_disk_4", "a"), (2, "VAL", "RX1HX/hx bed store/Disk/04", None), (3, "test", "rx1hx_hx-bed-store_disk_40", "b"), (4, None, "rx1hx_hx-bed-store_disk_4", "c"), (5, "dev", None, ""), (6, "training", None, ""), (7, "train", "", "  ")]
    got = {tuple(r) for r in crosssplit.overlaps(spark.createDataFrame([(*r, None, "x") for r in data], S)).collect()}
    assert got == {(1, 2)}


def test_equal_texts_in_large_classes(spark):
    rows = [(i, "train", None, "one two three four five six") for i in range(30)] + [(100 + i, "val", None, "One, two; three four FIVE six!") for i in range(20)] + [(200, "dev", None, "six five four three two one")]
    got = crosssplit.overlaps(spark.createDataFrame([(*r, None, "x") for r in rows], S))
    assert got.count() == 30 * 21  # the reversed text has the same words


def test_empty_table(spark):
    assert crosssplit.overlaps(spark.createDataFrame([], S)).count() == 0


def test_long_and_short_texts(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, "train", None, long, None, ""), (2, "val", None, long + " extra", None, ""), (3, "val", None, "w1 w2", None, ""), (4, "train", None, "w1 w2", None, "")], S)
    assert {tuple(r) for r in crosssplit.overlaps(df).collect()} == {(1, 2), (4, 3)}


def test_words(spark):
    df = spark.createDataFrame([("A 15.43 b, 3015ms 1,435 x2 — 0.5 Ж",)], "t string")
    assert df.select(crosssplit.words(F.col("t"))).first()[0] == ["a", "15", "b", "3015", "ms", "1435", "x2", "0", "ж"]


def test_the_smaller_id_comes_first(spark):
    data = [(1, "train", None, "a b c d e"), (2, "val", None, "a b c d e"), (4, "train", None, "w x y z"), (3, "val", None, "w x y z")]
    df = spark.createDataFrame([(*r, None, "x") for r in data], S)
    assert {tuple(r) for r in crosssplit.found(df).collect()} == {(1, 2), (3, 4)}
    assert {tuple(r) for r in crosssplit.overlaps(df).collect()} == {(1, 2), (4, 3)}


def test_a_gram_of_many_rows_is_spread_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(crosssplit, "CELL", 7)
    rows = [(i, "train" if i < 60 else "val", None, "one two three four five six seven u%d" % i) for i in range(100)]
    got = {tuple(r) for r in crosssplit.overlaps(spark.createDataFrame([(*r, None, "x") for r in rows], S)).collect()}
    assert got == {(a, b) for a in range(60) for b in range(60, 100)}


def test_disk_follows_the_input(spark, tmp_path):
    """Stock phrases of thousands of texts: what lies on disk at once stays within some times the table."""
    import threading
    from pathlib import Path

    rng = random.Random(9)
    rows = [(i, "val" if i % 3 == 0 else "train", f"c_{i}", "Known: " + "; ".join(text(rng, 8)), None, "x") for i in range(6000)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, S).write.option("compression", "zstd").parquet(folder)
    given = sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    own = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    own.append(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def there():
        sizes = {}
        for d in own:
            for p in Path(d).rglob("*"):
                try:
                    if p.name.startswith(("shuffle_", "part-")):
                        sizes[str(p)] = p.stat().st_size
                except OSError:  # gone meanwhile
                    pass
        return sizes

    before, most, over = there(), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.is_set():
            most = max(most, sum(n for p, n in there().items() if p not in before))
            over.wait(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        crosssplit.overlaps(spark.read.parquet(folder)).count()
    finally:
        over.set()
        watcher.join()
    assert 0 < most <= 6 * given
