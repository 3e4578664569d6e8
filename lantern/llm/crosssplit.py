"""The same or nearly the same record on both sides of a train / evaluation split.

Texts become words: lower case, punctuation and spacing gone, numbers cut to their whole part.  Copies that are equal then
form one class.  Word trigrams over all words, however frequent, are the
blocking keys: hashes of the evaluation side are partitioned, the training side is scanned for hits, and every pair with a hit
is verified by the containment of the smaller record's trigrams in the other.  What is probed follows from that containment
alone, so no pair that it holds for is missed at any size.  Trigrams instead of five words, and 0.6 instead of 0.8: an
order of observations that changes, words that change and an observation that is left out are all still the same record here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.lineage import cut, drop, lean
from lantern.llm import gramjoin

GRAM = 3
CONTAINED = 0.6
#: The smaller record has at least this part of the larger one's trigrams.
LEAST_SIZE = 0.5
#: Classes of the evaluation side that a task holds at once, at MEAN grams each; files of the index have no more, and not under LEAST_CELL.
CELL, LEAST_CELL, MEAN = 65_536, 1000, 128
#: Classes whose grams are counted for the order of all, and buckets that they are counted in (a power of 2).
SAMPLE, BUCKETS = 100_000, 1 << 20

WORD = r"[0-9]+|\p{Nd}+|\p{L}[\p{L}\p{N}]*"
#: The last group of a number's digits, where it is a fraction, and what groups digits otherwise.
FRACTION = r"(?<=[0-9])(?:[.,][0-9]{1,2}|\.[0-9]+)(?![.,]?[0-9])"
GROUPED = r"(?<=[0-9])[.,](?=[0-9])"


def words(text: Column) -> Column:
    """The words of a text; a number keeps its whole part only, so a rounded or cut one is the same word."""
    whole = F.regexp_replace(F.regexp_replace(F.lower(text), FRACTION, ""), GROUPED, "")
    return F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))


def grams(hashes: Column) -> Column:
    """Distinct 64-bit hashes of the word trigrams, from the words' hashes; a shorter text has one gram of all its words, an empty one none."""
    # Bound as a variable: an expression that a lambda captures would be computed again for every word.
    each = lambda hs: F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + 1), F.get(hs, i + 2)))
    return F.get(F.transform(F.array(hashes), lambda hs: F.array_distinct(F.slice(each(hs), 1, F.greatest(F.size(hs) - GRAM + 1, F.lit(1))))), 0)


def clean_case(c: Column) -> Column:
    """Case id apart from letter case, white space, separators and leading zeros of the repetition."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")
    return F.nullif(F.regexp_replace(spaced, r"(?<![0-9])0+([0-9]+)$", "$1"), F.lit(""))


def clean_split(c: Column) -> Column:
    """train, val, dev, final_test, or null."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "validation"), "val").when(s.isin("final_test", "test"), "final_test").when(s == "dev", "dev")


def candidates(grammed: DataFrame) -> DataFrame:
    """(_a, _b): pairs of a training and an evaluation class that can share CONTAINED of the smaller one's grams; none that does is missing.

    The grams of each class are written once, four bytes each, in files of at most CELL classes.  A task reads a block of the
    evaluation side and its part of the training side (:mod:`lantern.llm.gramjoin`), so nothing is shuffled or copied for a frequent gram.
    """
    spark = grammed.sparkSession
    count, cores = grammed.count(), spark.sparkContext.defaultParallelism
    some = grammed.where(F.pmod(F.xxhash64("_cls"), F.lit(-(-max(count, 1) // SAMPLE))) == 0).select("_t", "_e", F.explode("_h").alias("_g"))
    # How rare a bucket of grams is only decides where they stand in the one order, so a sample will do; what is found doesn't depend on it.
    seen = some.groupBy(F.col("_g").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("_k")).agg(F.count_if("_t").alias("_ft"), F.count_if("_e").alias("_fe"), F.count("*").alias("_f")).toArrow()
    k, ft, fe, f = (seen.column(c).to_numpy().astype(np.int64) for c in seen.column_names)
    rank = np.zeros(BUCKETS, np.uint8)
    rank[k] = np.minimum(255, 4 * np.log2(1.0 + ft * fe))
    mean = f.sum() / max(1, min(count, SAMPLE))
    held = spark.sparkContext.broadcast(rank)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("_h")
            at = h.offsets.to_numpy().astype(np.int64)
            codes = gramjoin.ordered(at - at[0], h.values.to_numpy()[at[0] : at[-1]], held.value)
            each = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), pa.py_buffer(codes)])
            for name, side in (("_t", "t"), ("_e", "e")):
                own = pa.table([batch.column("_cls"), each, pa.array([side] * len(h))], ["_cls", "_codes", "_side"]).filter(batch.column(name))
                yield from own.to_batches()

    # Files are small enough for some tasks per core, and for what a task may hold.
    rows = max(1, min(CELL, max(LEAST_CELL, -(-count // (4 * cores))), int(CELL * MEAN / max(MEAN, mean))))
    index = cut(grammed.where("size(_h) > 0").select("_cls", "_t", "_e", "_h").mapInArrow(ordered, "_cls bigint, _codes binary, _side string"), "_side", maxRecordsPerFile=rows)
    files = index.groupBy(F.input_file_name().alias("file"), "_side").agg(F.count("*").alias("n")).collect()

    def packed(side: str, most: int) -> list[list[str]]:
        """The side's files in groups of at most ``most`` classes, but for a file that has more."""
        groups, size = [], most + 1
        for r in sorted((r for r in files if r["_side"] == side), key=lambda r: r["file"]):
            if size + r["n"] > most:
                groups, size = [*groups, []], 0
            groups[-1].append(r["file"])
            size += r["n"]
        return groups

    blocks = packed("e", max(rows, min(CELL, int(CELL * MEAN / max(MEAN, mean)))))
    training = sum(r["n"] for r in files if r["_side"] == "t")
    parts = packed("t", max(rows, -(-training * len(blocks) // (8 * cores))))
    cells = [(e, t) for e in blocks for t in parts]
    numbers = spark.range(0, len(cells), 1, max(1, len(cells))).mapInArrow(gramjoin.near(spark.sparkContext.broadcast(cells), CONTAINED, LEAST_SIZE), "_a bigint, _b bigint")
    pairs = cut(numbers)
    drop(index)
    return pairs


def text_overlaps(records: DataFrame, record: str, side: str, text: str) -> DataFrame:
    """(a, b): each pair of a record of side 't' and one of side 'e' whose texts are the same or nearly the same.

    Null and empty texts, and null record ids or sides, match nothing.  Repeated rows count once.
    """
    with lean(records.sparkSession):
        return _text_overlaps(records, record, side, text)


def _text_overlaps(records: DataFrame, record: str, side: str, text: str) -> DataFrame:
    rows = records.select(F.col(record).alias("_id"), F.col(side).alias("_side"), words(F.col(text)).alias("_words")).where("_id is not null and _side in ('t', 'e') and size(_words) > 0")
    # Texts are kept as text: compressed, that is a quarter of their words' hashes.
    keyed = cut(rows.select("_id", "_side", F.array_join("_words", " ").alias("_text")).withColumn("_key", F.unhex(F.md5("_text"))), compression="zstd")
    by_key = keyed.groupBy("_key").agg(F.any_value("_text").alias("_text"), F.max(F.col("_side") == "t").alias("_t"), F.max(F.col("_side") == "e").alias("_e"))
    # The number of a class is written with the class, so it is unique and doesn't change on a retry.
    classes = cut(by_key.withColumn("_cls", F.monotonically_increasing_id()), compression="zstd")
    member = cut(keyed.select("_id", "_side", "_key").distinct(), compression="zstd")
    drop(keyed)
    split = F.split("_text", " ")
    hashes = F.transform(split, lambda w: F.xxhash64(w))
    met_pairs = candidates(classes.select("_cls", "_t", "_e", grams(hashes).alias("_h")))
    # Texts of the same words in another order may share no trigram at all.
    bags = classes.select("_cls", "_t", "_e", F.unhex(F.md5(F.array_join(F.sort_array(split), " "))).alias("_bag"))
    same_bag = bags.where("_t").select(F.col("_cls").alias("_a"), "_bag").join(bags.where("_e").select(F.col("_cls").alias("_b"), "_bag"), "_bag").where("_a <> _b").select("_a", "_b")
    pairs = cut(met_pairs.withColumn("_same", F.lit(False)).unionAll(same_bag.withColumn("_same", F.lit(True))).groupBy("_a", "_b").agg(F.max("_same").alias("_same")))
    drop(met_pairs)
    # The texts that are in a pair, few of all; what is compared exactly are their grams.
    touched = pairs.select(F.explode(F.array("_a", "_b")).alias("_cls")).distinct()
    asked = cut(classes.select("_cls", "_text").join(touched, "_cls", "left_semi"), compression="zstd")
    left, right = (asked.select(F.col("_cls").alias(c), F.col("_text").alias(g)) for c, g in (("_a", "_ga"), ("_b", "_gb")))
    both = pairs.join(left, "_a").join(right, "_b").select("_a", "_b", "_same", *[grams(F.transform(F.split(g, " "), lambda w: F.xxhash64(w))).alias(g) for g in ("_ga", "_gb")])
    common, less, more = F.size(F.array_intersect("_ga", "_gb")), F.least(F.size("_ga"), F.size("_gb")), F.greatest(F.size("_ga"), F.size("_gb"))
    near = both.where(F.col("_same") | ((less >= LEAST_SIZE * more) & (common >= CONTAINED * less))).select("_a", "_b")
    equal = classes.where("_t and _e").select(F.col("_cls").alias("_a"), F.col("_cls").alias("_b"))
    matched = cut(near.unionAll(equal))
    # Only here copies are expanded, since every pair of records is asked for; AQE splits classes with very many members.
    named = cut(member.join(classes.select(F.col("_key").alias("_k"), "_cls"), F.col("_key") == F.col("_k")).select("_id", "_side", "_cls"))
    for done in (pairs, asked, classes, member):
        drop(done)
    a = named.where("_side = 't'").select(F.col("_cls").alias("_a"), F.col("_id").alias("a"))
    b = named.where("_side = 'e'").select(F.col("_cls").alias("_b"), F.col("_id").alias("b"))
    return matched.join(a, "_a").join(b, "_b").select("a", "b").distinct()


def overlaps(table: DataFrame) -> DataFrame:
    """(train_id, evaluation_id): train record and evaluation record that are the same by case or by query.

    By case: an equi-join on the clean case id.  By query: :func:`text_overlaps`.  Null splits belong to neither side.
    """
    split = clean_split(F.col("split"))
    rows = table.select("record_id", F.when(split == "train", "t").when(split.isNotNull(), "e").alias("side"), clean_case(F.col("case_id")).alias("case"), "query").where("record_id is not null and side is not null")
    t = rows.where("side = 't' and case is not null").select(F.col("record_id").alias("train_id"), "case").distinct()
    e = rows.where("side = 'e' and case is not null").select(F.col("record_id").alias("evaluation_id"), "case").distinct()
    by_case = t.join(e, "case").select("train_id", "evaluation_id")
    by_text = text_overlaps(rows, "record_id", "side", "query").select(F.col("a").alias("train_id"), F.col("b").alias("evaluation_id"))
    return by_case.unionAll(by_text).distinct()


def found(table: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): the pairs of :func:`overlaps`, each with the smaller id first."""
    a, b = F.col("train_id"), F.col("evaluation_id")
    return overlaps(table).select(F.least(a, b).alias("record_id_a"), F.greatest(a, b).alias("record_id_b")).distinct()
