"""Reading level of each document, by regularised ordinal regression calibrated to graded passages.

The features are lexical diversity, word rarity, connectives, a proxy of clause depth, and lengths of words and sentences; all
come from the running prose only (see :mod:`lantern.llm.prose`).  A proportional-odds model with an L2 penalty gives the
probability of every grade band.  The job is a single map over documents: no shuffle, nothing collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.llm.graded import PASSAGES
from lantern.llm.prose import KEPT, is_english, sentences, syllables

#: Lower bounds of the grade bands: early, primary, middle, high school, college.
BANDS = (0, 4, 7, 10, 13)

#: Words that join clauses.
CONNECTIVES = frozenset("although because before after since while whereas unless until though whenever therefore thus hence however moreover furthermore nevertheless nonetheless consequently accordingly thereby whereby notwithstanding particularly instead otherwise meanwhile".split())
SUBORDINATORS = frozenset("that which who whom whose where when if whether why how as than".split())

FEATURES = ("diversity", "rarity", "connectives", "clause_depth", "word_length", "sentence_length", "syllables", "long_words")
PENALTY = 0.02


@lru_cache(KEPT)
def _facts(word: str) -> tuple:
    """(lower case, syllables, length, rare, connective, opens a clause, three syllables or more) of a word."""
    w, y = word.lower(), syllables(word.lower())
    connects = w in CONNECTIVES
    return w, y, len(w), len(w) >= 9 or y >= 4, connects, connects or w in SUBORDINATORS, y >= 3


def measure(sents: list[list[str]]) -> list[float]:
    """The features of a text of at least one word, see FEATURES."""
    words, syl, sizes, rare, connects, opens, long = zip(*[_facts(w) for s in sents for w in s], strict=True)
    n, k = len(words), len(sents)
    # Diversity over windows of 50 words, so that it doesn't fall with length.
    spans = [words[i : i + 50] for i in range(0, max(1, n - 49), 25)]
    diversity = sum(len(set(s)) / len(s) for s in spans) / len(spans)
    # Rarity without a corpus: the share of words that are long and derived, which are rare in any graded word list.
    return [diversity, sum(rare) / n, sum(connects) / n * 10, math.log1p(sum(opens) / k), sum(sizes) / n, math.log(n / k), sum(syl) / n, sum(long) / n]


def flesch_kincaid(sents: list[list[str]]) -> float:
    """The published grade formula (Kincaid and others, 1975)."""
    n = sum(map(len, sents))
    return 0.39 * n / len(sents) + 11.8 * sum(syllables(w) for s in sents for w in s) / n - 15.59


def fit(x: np.ndarray, y: np.ndarray, bands: int, penalty: float = PENALTY, steps: int = 4000) -> dict:
    """Proportional odds: P(band > j) = sigmoid(w.x - t_j) with rising t.  Plain gradient steps with momentum, no randomness."""
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / std
    w, t = np.zeros(z.shape[1]), np.linspace(-1.5, 1.5, bands - 1)
    above = (y[:, None] > np.arange(bands - 1)[None, :]).astype(float)
    vw, vt = np.zeros_like(w), np.zeros_like(t)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((z @ w)[:, None] - t[None, :], -30, 30)))
        err = (p - above) / len(y)
        gw, gt = z.T @ err.sum(1) + penalty * w, -err.sum(0) + 1e-4 * t
        vw, vt = 0.9 * vw - 0.3 * gw, 0.9 * vt - 0.3 * gt
        w, t = w + vw, np.sort(t + vt)
    return {"mean": mean, "std": std, "w": w, "t": t}


@lru_cache(maxsize=1)
def model() -> dict:
    """Fitted on the graded passages: each as a whole, its halves, pairs of neighbouring grades, and hard with plain ones.

    A text of mixed difficulty has the grade that the published Flesch-Kincaid formula gives to the whole of it.
    """
    xs, ys = [], []

    def add(text: str, grade: float) -> None:
        xs.append(measure(sentences(text)))
        ys.append(sum(grade >= b for b in BANDS) - 1)

    ordered = sorted(PASSAGES)
    for grade, text in ordered:
        add(text, grade)
        parts = text.split(". ")
        if len(parts) > 1:
            half = max(1, len(parts) // 2)
            add(". ".join(parts[:half]) + ".", grade)
            add(". ".join(parts[half:]), grade)
    for (g1, a), (g2, b) in zip(ordered, ordered[1:], strict=False):
        if g2 - g1 <= 1:
            add(a + " " + b, (g1 + g2) / 2)
    hard, plain = [t for g, t in ordered if g >= 14], [t for g, t in ordered if 4 <= g <= 9]
    for a in hard:
        for b in plain:
            for mixed in (a + " " + b, a + " " + ". ".join(b.split(". ")[:2]) + "."):
                add(mixed, flesch_kincaid(sentences(mixed)))
    return fit(np.array(xs), np.array(ys), len(BANDS))


def levels(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    """(grade, probability of college): the grade is the expected one, from the mean grade of each band."""
    z = (x - m["mean"]) / m["std"]
    p = 1 / (1 + np.exp(-np.clip((z @ m["w"])[:, None] - m["t"][None, :], -30, 30)))
    gaps = np.diff([2.0, 5.0, 8.0, 11.0, 15.0])
    return 2.0 + p @ gaps, p[:, -1]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("sentences", T.IntegerType()), T.StructField("english", T.BooleanType()), T.StructField("grade", T.DoubleType()), T.StructField("college", T.DoubleType())])


def reading_levels(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, words, sentences, english, grade, college) of every row.

    Null, empty and prose-free texts have 0 words, english false and null grade and college.  Texts are read whole,
    whatever their length.  Repeated rows are repeated.
    """
    fitted = model()

    def map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k, english, rows, at = [], [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                sents = sentences(t) if t else []
                flat = [w for s in sents for w in s]
                n.append(len(flat))
                k.append(len(sents))
                english.append(is_english(flat))
                if flat:
                    rows.append(measure(sents))
                    at.append(i)
            grade, college = np.full(len(n), np.nan), np.full(len(n), np.nan)
            if rows:
                grade[at], college[at] = levels(np.array(rows), fitted)
            none = np.isnan(grade)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(english), pa.array(grade, mask=none), pa.array(college, mask=none)], SCHEMA.names)

    rows = documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(map_batches, SCHEMA).withColumnRenamed("doc_id", id_col)


def college(documents: DataFrame, least_words: int = 50) -> DataFrame:
    """Ids of English documents with at least ``least_words`` words of prose that as a whole ask for college reading."""
    return reading_levels(documents).where((F.col("words") >= least_words) & F.col("english") & (F.col("college") >= 0.5)).select("doc_id")
