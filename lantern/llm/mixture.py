"""Mixing sources to target weights, in tokens of a public tokenizer.

Budgets go down a tree of any depth, here source and language, optionally with further levels above the source.  At every
node an amount is shared among the children by their weights; what a child can't hold, with all repeats, goes to its
siblings, and only what a whole node can't hold goes to the siblings of the node.  Each leaf then takes whole seeded
epochs and a token prefix of one more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.blocks import running
from lantern.lineage import cut
from lantern.llm import bpe


#: Target tables of up to so many rows are broadcast.
MOST_TARGETS = 100_000


def clean_source(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one '_'; empty becomes null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_|_$", ""), F.lit(""))


def clean_language(c: Column) -> Column:
    """The language before any region, lower case; null, empty and unknown become 'und'."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^\p{L}+", 0), F.lit("")), F.lit("und"))


def fill(amount: float, weights: Sequence[float], limits: Sequence[float]) -> list[float]:
    """Shares of ``amount`` in proportion to ``weights``, none above its limit; what one can't hold goes to the others."""
    given, open_, left = [0.0] * len(weights), {i for i, w in enumerate(weights) if w > 0}, float(amount)
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if limits[i] - given[i] <= left * weights[i] / total}
        if not full:
            for i in open_:
                given[i] += left * weights[i] / total
            return given
        # Only the nodes that fill up are settled in this pass; the others share what is then left anew.
        for i in full:
            left -= limits[i] - given[i]
            given[i] = limits[i]
        open_ -= full
    return given


def budgets(amount: float, weights: Mapping[tuple, float], limits: Mapping[tuple, float]) -> dict[tuple, float]:
    """What every node of a tree contributes to ``amount``, by path; the root is ().

    ``weights`` has every node but the root, ``limits`` every leaf.  Shortages go to siblings before they go to ancestors:
    a node asks for no more than its leaves hold, so what is short below it is first shared out below it.
    """
    below: dict[tuple, list[tuple]] = defaultdict(list)
    for path in sorted(weights):
        below[path[:-1]].append(path)
    hold: dict[tuple, float] = {}
    for path in sorted({(), *weights}, key=len, reverse=True):
        hold[path] = sum(hold[c] for c in below[path]) if below[path] else float(limits.get(path, 0.0))
    given = {(): min(float(amount), hold[()])}
    for path in sorted({(), *weights}, key=len):
        kids = below[path]
        for kid, part in zip(kids, fill(given[path], [weights[k] for k in kids], [hold[k] for k in kids]), strict=True):
            given[kid] = part
    return given


def token_sizes(documents: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, source, lang, tokens) of every row; source is clean and may be null, empty and null texts have 0 tokens."""
    rows = bpe.spread(documents.select("doc_id", "source", "lang", "text"))
    return rows.select("doc_id", clean_source(F.col("source")).alias("source"), clean_language(F.col("lang")).alias("lang"), bpe.count(F.col("text"), path).alias("tokens"))


def leaf_sizes(documents: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(source, lang, tokens) of every leaf: the sums of :func:`token_sizes`, from the distinct words of the corpus.

    Words are counted per leaf on the map side before anything moves, and each distinct word is encoded once.
    """
    rows = bpe.spread(documents.select("source", "lang", "text"))
    leaf = rows.select(clean_source(F.col("source")).alias("source"), clean_language(F.col("lang")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # The outer explode keeps leaves without any word.
    words = cut(leaf.select("source", "lang", F.explode_outer(bpe.cut_words(F.col("text"))).alias("word")).groupBy("source", "lang", "word").agg(F.count("*").alias("n")))
    told = bpe.word_lengths(words.where("word is not null"), path)
    return words.join(told, "word", "left").groupBy("source", "lang").agg(F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0)).alias("tokens"))


def plan(sizes: DataFrame, targets: DataFrame, size: int | None = None, levels: Sequence[str] = (), evenness: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(sources, leaves): what every source and every leaf (source, lang) contributes.

    sources: source (as spelled in the targets), target_share, wanted, capacity, given, short;
    leaves: source (clean), lang, leaf_tokens, budget.  ``size`` is the mix's size in tokens, by default all tokens there are.
    ``levels`` names columns of the targets that group sources, outermost first; a group weighs what its sources weigh.
    A language of a source weighs tokens ** (1 - ``evenness``), so small languages are asked for more than their part, and what they
    can't hold goes to the other languages of the source.  A source is short if it contributes less than it was to.
    One without documents is short, unless its share is 0.  A null share or repeat counts as 0.  Driver memory: one number per
    target row and language, never one per document.
    """
    spark = sizes.sparkSession
    # Sources that no target names only count in the total.
    named = F.broadcast(targets.select(clean_source(F.col("source")).alias("_k")).where("_k is not null").distinct()) if targets.count() <= MOST_TARGETS else targets.select(clean_source(F.col("source")).alias("_k")).where("_k is not null").distinct()
    summed = sizes.groupBy("source", "lang").agg(F.sum("tokens").alias("t")).join(named, F.col("source") == F.col("_k"), "left")
    have: dict[str | None, dict[str, int]] = {}
    for r in summed.groupBy(F.col("_k"), F.when(F.col("_k").isNotNull(), F.col("lang")).otherwise("").alias("lang")).agg(F.sum("t").alias("t")).collect():
        have.setdefault(r["_k"], {})[r["lang"]] = int(r["t"] or 0)
    total = size if size is not None else sum(t for d in have.values() for t in d.values())
    rows = targets.select("source", clean_source(F.col("source")).alias("key"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats"), *[F.col(c).cast("string").alias(f"_l{i}") for i, c in enumerate(levels)]).collect()
    weights: dict[tuple, float] = defaultdict(float)
    limits: dict[tuple, float] = {}
    tree = []
    for i, r in enumerate(rows):
        # Every level of a path starts with a mark, so that null and any text are different names.
        path = tuple(f"+{r[f'_l{k}']}" if r[f"_l{k}"] is not None else "-" for k in range(len(levels)))
        for k in range(len(path)):
            weights[path[: k + 1]] += float(r["share"])
        path = (*path, f"{i:09d}")
        weights[path] = float(r["share"])
        own = have.get(r["key"], {}) if r["key"] is not None else {}
        limits[path] = 0.0
        for lang, t in own.items():
            weights[*path, lang] = float(t) ** (1 - evenness)
            limits[*path, lang] = float(r["repeats"] * t)
        tree.append((r, path, own))
    given = budgets(total, weights, limits)
    sources, leaves = [], []
    for r, path, own in tree:
        wanted, capacity = float(r["share"] * total), float(r["repeats"] * sum(own.values()))
        # Redistribution only adds to what a source was to give, so less than that means that it ran full.
        sources.append((r["source"], float(r["share"]), wanted, capacity, given[path], given[path] < wanted * (1 - 1e-12)))
        leaves += [(r["key"], lang, t, given[*path, lang]) for lang, t in sorted(own.items())]
    return spark.createDataFrame(sources, "source string, target_share double, wanted double, capacity double, given double, short boolean"), spark.createDataFrame(leaves, "source string, lang string, leaf_tokens bigint, budget double")


def select(sizes: DataFrame, leaves: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, lang, tokens, times): how often each document is used; documents used never are left out.

    Whole epochs take every document of the leaf; the last one is the prefix, in a seeded order, that fits the rest of
    the budget.  The prefix is a running sum by blocks, so a leaf of any size is spread over tasks.
    """
    leaf = leaves.select(F.col("source").alias("_s"), F.col("lang").alias("_l"), "leaf_tokens", "budget")
    there = sizes.join(F.broadcast(leaf) if leaf.count() <= MOST_TARGETS else leaf, (F.col("source") == F.col("_s")) & (F.col("lang") == F.col("_l"))).drop("_s", "_l").where("tokens > 0")
    epochs = F.floor(F.col("budget") / F.col("leaf_tokens") + 1e-12)
    laid = there.withColumn("_e", epochs).withColumn("_rest", F.col("budget") - epochs * F.col("leaf_tokens")).withColumn("_h", F.xxhash64(F.lit(seed), "_e", "doc_id"))
    run = running(laid, ["source", "lang"], [F.col("_h"), F.col("doc_id")], "tokens")
    times = (F.col("_e") + (F.col("_sum") <= F.col("_rest")).cast("int")).cast("int")
    return run.withColumn("times", times).where("times > 0").select("doc_id", "source", "lang", "tokens", "times")


def report(sizes: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(source, target_share, short, documents, tokens, reached_share): the mix as it really comes out."""
    sizes = cut(sizes)
    sources, leaves = plan(sizes, targets)
    used = select(sizes, leaves, seed).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("times")).alias("tokens"))
    joined = sources.join(used.withColumnRenamed("source", "_k"), clean_source(F.col("source")) == F.col("_k"), "left")
    all_tokens = used.agg(F.sum("tokens").alias("_all"))
    return joined.crossJoin(F.broadcast(all_tokens)).select("source", "target_share", "short", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.col("tokens"), F.col("_all")), F.lit(0.0)).alias("reached_share"))
