import pytest

from lantern.llm import mixture

DOC = "doc_id bigint, source string, lang string, text string, tokens string, _s string"
TARGET = "source string, target_share double, max_repeats int"


def test_fill():
    assert mixture.fill(10, [1, 1], [9, 9]) == [5, 5]
    assert mixture.fill(10, [1, 1], [2, 9]) == [2, 8]
    assert mixture.fill(10, [1, 1, 2], [1, 1, 1]) == [1, 1, 1]
    assert mixture.fill(12, [1, 1, 2], [1, 100, 100]) == pytest.approx([1, 11 / 3, 22 / 3])
    assert mixture.fill(5, [0, 1], [9, 3]) == [0, 3] and mixture.fill(5, [], []) == []


def docs(spark, extra=()):
    rows = [(i, "Big Source", "en" if i % 2 else "DE-xx", "alpha beta gamma " * 20, "", "") for i in range(60)]
    rows += [(100 + i, " small_source", None, "delta epsilon " * 5, "", "") for i in range(4)] + [(200, None, "en", "zeta", "", ""), (201, "small-source", "en", "", "", ""), (202, "small-source", "en", None, "", "")]
    return spark.createDataFrame([*rows, *extra], DOC)


def test_shortage_and_selection(spark):
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.4, 2), ("absent", 0.1, 3), ("zero", 0.0, 1), ("none", None, None)], TARGET)
    sizes = mixture.token_sizes(docs(spark))
    sources, leaves = mixture.plan(sizes, targets)
    got = {r.source: r for r in sources.collect()}
    total = sum(r.tokens for r in sizes.collect())
    assert {s for s, r in got.items() if r.short} == {"small_source", "absent"}
    assert got["small_source"].given == got["small_source"].capacity and got["big_source"].given == min(total - got["small_source"].given, got["big_source"].capacity)
    used = {r.doc_id: r.times for r in mixture.select(sizes, leaves).collect()}
    assert all(used[100 + i] == 2 for i in range(4)) and max(v for k, v in used.items() if k < 100) == 1
    assert 200 not in used and 201 not in used


def test_prefix_is_close_to_the_budget(spark):
    targets = spark.createDataFrame([("big_source", 0.25, 3), ("small_source", 0.0, 1)], TARGET)
    sizes = mixture.token_sizes(docs(spark))
    _, leaves = mixture.plan(sizes, targets, size=1500)
    used = mixture.select(sizes, leaves).collect()
    budget = sum(r.budget for r in leaves.collect())
    spent = sum(r.tokens * r.times for r in used)
    assert budget - 2 * 80 <= spent <= budget
    assert sorted(map(tuple, used)) == sorted(map(tuple, mixture.select(sizes, leaves).collect()))


def test_report_and_empty(spark):
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("absent", 0.5, 1)], TARGET)
    got = {r.source: r for r in mixture.report(mixture.token_sizes(docs(spark)), targets).collect()}
    assert got["absent"].tokens == 0 and got["absent"].short and got["big_source"].reached_share == 1.0
    none = mixture.report(mixture.token_sizes(spark.createDataFrame([], DOC)), targets).collect()
    assert {(r.source, r.tokens, r.reached_share) for r in none} == {("big_source", 0, 0.0), ("absent", 0, 0.0)}


def test_shortages_go_to_siblings_before_ancestors():
    weights = {("a",): 1.0, ("b",): 1.0, ("a", "x"): 1.0, ("a", "y"): 1.0, ("b", "z"): 1.0}
    # x is short by 20: y takes it, b gets nothing of it.
    got = mixture.budgets(100, weights, {("a", "x"): 5, ("a", "y"): 500, ("b", "z"): 500})
    assert got[("a", "x")] == 5 and got[("a", "y")] == 45 and got[("b",)] == 50
    # a as a whole is short: only what x and y can't hold goes up and to b.
    got = mixture.budgets(100, weights, {("a", "x"): 5, ("a", "y"): 30, ("b", "z"): 500})
    assert got[("a",)] == 35 and got[("a", "y")] == 30 and got[("b", "z")] == 65
    # Nothing can be held beyond all limits; a tree without leaves holds nothing.
    assert mixture.budgets(100, weights, {("a", "x"): 5, ("a", "y"): 5, ("b", "z"): 5})[()] == 15
    assert mixture.budgets(100, {}, {}) == {(): 0.0}
    deep = {("r",): 1.0, ("r", "a"): 1.0, ("r", "b"): 3.0, ("r", "a", "1"): 1.0, ("r", "a", "2"): 1.0, ("r", "b", "1"): 1.0}
    got = mixture.budgets(80, deep, {("r", "a", "1"): 2, ("r", "a", "2"): 100, ("r", "b", "1"): 50})
    assert (got[("r", "a")], got[("r", "a", "2")], got[("r", "b", "1")]) == (30, 28, 50)


def test_a_small_language_that_runs_full_is_made_up_by_its_siblings(spark):
    rows = [(i, "s", "en", "alpha beta gamma " * 40, "", "") for i in range(50)] + [(100, "s", "fr", "delta", "", ""), (200, "t", "en", "zeta eta " * 900, "", "")]
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 4)], TARGET)
    sizes = mixture.token_sizes(spark.createDataFrame(rows, DOC))
    sources, leaves = mixture.plan(sizes, targets, size=2000)
    by = {(r.source, r.lang): r for r in leaves.collect()}
    assert by["s", "fr"].budget == by["s", "fr"].leaf_tokens and by["s", "en"].budget == pytest.approx(1000 - by["s", "fr"].budget)
    assert not any(r.short for r in sources.collect()) and by["t", "en"].budget == pytest.approx(1000)


def test_levels_above_the_source(spark):
    targets = spark.createDataFrame([("big_source", 0.2, 1, "d"), ("small_source", 0.4, 1, "d"), ("other", 0.4, 1, None)], TARGET + ", domain string")
    sizes = spark.createDataFrame([(1, "big_source", "en", 900), (2, "small_source", "en", 10), (3, "other", "en", 900)], "doc_id bigint, source string, lang string, tokens bigint")
    got = {r.source: r.given for r in mixture.plan(sizes, targets, 1000, levels=["domain"])[0].collect()}
    assert got == pytest.approx({"big_source": 590, "small_source": 10, "other": 400})


def test_leaves_by_distinct_words_are_the_sums_of_the_documents(spark):
    odd = [(300 + i, "odd", "fr", t, "", "") for i, t in enumerate(["a   b\n\n c  ", "don't we'LL 'tx", "AbstractRetryInterceptorFactoryBean " * 9, "日本語 \u3000 x", "   ", "\t\n", "12345 %. <|endoftext|>"])]
    d = docs(spark, [*odd, (400, "none", "en", None, "", "")])
    want = {(r.source, r.lang): r.t for r in mixture.token_sizes(d).groupBy("source", "lang").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    assert {(r.source, r.lang): r.tokens for r in mixture.leaf_sizes(d).collect()} == want
    assert mixture.leaf_sizes(spark.createDataFrame([], DOC)).count() == 0
