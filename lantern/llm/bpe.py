"""Byte-level BPE in Spark expressions: encoding and decoding of whole texts, without Python and without a shuffle.

A text is cut into words by the vocabulary's pattern; the distinct words of each block of a text that aren't tokens themselves
become arrays of byte ids, and a fold merges, in each step, the leftmost pair of lowest rank.  Ranks come from a literal table in the plan.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: The published pre-tokenisation pattern of the vocabulary; (?U) makes \s the Unicode white space.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words of a text are handled in blocks of this size, so look-ups inside a block stay short in texts of any length.
BLOCK = 512

#: At most so many repeated words, of so many bytes at most, have their ids in the plan.
MOST_KEPT, LONGEST_KEPT = 40_000, 64

#: Cells of each half of a table of words: the halves are told by the two halves of a word's CRC.
HALF = 1 << 16

#: Primes: sizes of the two halves of the table of pairs, and multipliers that mix a pair of ids without overflow.
P1, P2 = 65521, 65519
M1, M2 = 2147483629, 1640531527


def _byte_letters() -> dict[str, int]:
    """The alphabet in which byte-level vocabularies are written: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _two_homes(items: dict, spots, strict: bool = True) -> list:  # noqa: ANN001
    """Cuckoo layout: every item lies in one of its two spots, so a look-up reads two cells and never walks.

    What finds no place is an error, or left out where ``strict`` is false.
    """
    table: list = [None] * (2 * HALF)
    for item in items:
        at, held = spots(item)[0], item
        for _ in range(500):
            table[at], held = held, table[at]
            if held is None:
                break
            a, b = spots(held)
            at = b if at == a else a
        else:
            if strict:
                raise ValueError("the table is too full")
    return table


def _crc_spots(text: str) -> tuple[int, int]:
    crc = zlib.crc32(text.encode("utf-8"))
    return crc & (HALF - 1), HALF + (crc >> 16)


@lru_cache(maxsize=4)
def vocabulary(path: str = VOCABULARY) -> dict:
    """bytes: id of each byte; pairs and words: the literal tables as JSON; pieces: the bytes of each id."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    letters, ids = _byte_letters(), model["vocab"]
    raw = {i: bytes(letters[c] for c in t) for t, i in ids.items() if all(c in letters for c in t)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = {}
    for rank, (a, b) in enumerate(merges):
        merged[ids[a] << 16 | ids[b]] = rank, ids[a + b]
    by_rank = [i for _, i in merged.values()]
    if by_rank != sorted(by_rank):
        raise ValueError("ids don't follow the order of the merges")
    pairs = _two_homes({k: v for k, (_, v) in merged.items()}, lambda k: ((k * M1 >> 24) % P1, P1 + (k * M2 >> 24) % P2))
    # Texts of tokens, for words that are tokens as a whole: the merges of such a word end in that token.
    texts = {}
    for i, b in raw.items():
        try:
            texts[b.decode("utf-8")] = i
        except UnicodeDecodeError:  # part of a character, never a word
            pass

    words = _two_homes(texts, _crc_spots)
    inverse = {b: i for i, b in raw.items()}
    return {
        "bytes": [inverse[bytes([b])] for b in range(256)],
        "pairs": json.dumps([0 if k is None else k << 17 | merged[k][1] for k in pairs], separators=(",", ":")),
        "words": json.dumps(words, separators=(",", ":")),
        "word_ids": json.dumps([0 if t is None else texts[t] for t in words], separators=(",", ":")),
        "pieces": raw,
    }


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Bits of an id, and the rank of a pair that doesn't merge.  A merge's rank is the id that it makes.
ID_BITS, NEVER = 17, (1 << 17) - 1


def _ranked(table: Column, a: Column, b: Column) -> Column:
    """An id and, in the bits above it, the rank of its pair with the next id."""

    def look(key: Column) -> Column:
        one, two = F.get(table, (F.shiftright(key * M1, 24) % P1).cast("int")), F.get(table, (F.lit(P1) + F.shiftright(key * M2, 24) % P2).cast("int"))
        rank = lambda cell: F.shiftleft(cell.bitwiseAND(NEVER), ID_BITS)
        return F.when(F.shiftright(one, ID_BITS) == key, rank(one)).when(F.shiftright(two, ID_BITS) == key, rank(two)).otherwise(F.lit(NEVER << ID_BITS))

    return look(F.shiftleft(a, 16) + b) + a


def _id(ranked: Column) -> Column:
    return ranked.bitwiseAND(NEVER)


def _fold(pairs: Column, first: Column) -> Column:
    """All merges of one word, from its byte ids as bigints.

    One array holds ids and ranks, so its least element is the pair to merge, and equal ones are the same pair.  Each step
    replaces that pair and looks up its two new neighbours only.
    """
    n = F.size(first)
    none = F.lit(NEVER << ID_BITS)
    start = F.transform(first, lambda a, i: F.when(i + 1 < n, _ranked(pairs, a, F.get(first, i + 1))).otherwise(a + none))

    def step(q: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            def at(pos: Column) -> Column:  # 1-based: the pair at pos, pos + 1 becomes one id
                best = F.shiftright(least, ID_BITS)
                after, before = F.get(q, pos + 1), F.get(q, pos - 2)
                own = F.when(after.isNull(), best + none).otherwise(_ranked(pairs, best, _id(after)))
                rest = F.slice(q, pos + 2, F.size(q))
                return F.when(before.isNull(), F.concat(F.array(own), rest)).otherwise(F.concat(F.slice(q, 1, pos - 2), F.array(_ranked(pairs, _id(before), best), own), rest))

            return F.when(least >= none, q).otherwise(_let(F.array_position(q, least).cast("int"), at))

        return _let(F.array_min(q), merge)

    done = F.aggregate(F.sequence(F.lit(2), n), start, step)
    return F.when(n < 2, first.cast("array<int>")).otherwise(F.transform(done, lambda x: _id(x).cast("int")))


def _byte_ids(table: Column, word: Column) -> Column:
    """The ids of a word's UTF-8 bytes."""

    def char(c: Column) -> Column:
        def units(cp: Column) -> Column:
            low = lambda shift: F.shiftright(cp, shift).bitwiseAND(63) + 128
            t = lambda b: F.get(table, b)
            return (
                F.when(cp < 0x80, F.array(t(cp)))
                .when(cp < 0x800, F.array(t(F.shiftright(cp, 6) + 192), t(low(0))))
                .when(cp < 0x10000, F.array(t(F.shiftright(cp, 12) + 224), t(low(6)), t(low(0))))
                .otherwise(F.array(t(F.shiftright(cp, 18) + 240), t(low(12)), t(low(6)), t(low(0))))
            )

        return _let(F.ascii(c), units)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: char(F.substring(word, i, F.lit(1)))))


def _tables(path: str, kept: dict[str, list[int]] | None = None) -> Column:
    v = vocabulary(path)
    cells = _two_homes(dict.fromkeys(kept or {}), _crc_spots, strict=False) if kept else []
    return F.struct(
        F.from_json(F.lit(v["pairs"]), "array<bigint>").alias("pairs"),
        F.from_json(F.lit(v["words"]), "array<string>").alias("words"),
        F.from_json(F.lit(v["word_ids"]), "array<int>").alias("ids"),
        F.from_json(F.lit(json.dumps(v["bytes"])), "array<bigint>").alias("bytes"),
        F.from_json(F.lit(json.dumps(cells, separators=(",", ":"))), "array<string>").alias("kept"),
        F.from_json(F.lit(json.dumps([None if w is None else kept[w] for w in cells], separators=(",", ":"))), "array<array<int>>").alias("folds"),
    )


def cut_words(text: Column) -> Column:
    """The words of a text by the vocabulary's pattern; together they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _cell(words: Column, values: Column, w: Column, crc: Column) -> Column:
    """The value of a word in a table of two homes, null for a word that isn't in it."""
    one, two = crc.bitwiseAND(F.lit(HALF - 1)).cast("int"), (F.shiftright(crc, 16) + HALF).cast("int")
    return F.when(F.get(words, one) == w, F.get(values, one)).when(F.get(words, two) == w, F.get(values, two))


def _known(t: Column, ws: Column) -> Column:
    """The id of each word that is a token, null for any other."""
    return F.zip_with(ws, F.transform(ws, lambda w: F.crc32(w.cast("binary"))), lambda w, crc: _cell(t["words"], t["ids"], w, crc))


def _folded(t: Column, w: Column) -> Column:
    return _let(_byte_ids(t["bytes"], w), lambda b: _fold(t["pairs"], b))


def encode(text: Column, path: str = VOCABULARY, kept: dict[str, list[int]] | None = None) -> Column:
    """The token ids of a text, as array<int>; strings of special tokens are ordinary text.

    A null or empty text has an empty list.  Every code point is covered, since any byte is a token; text of any length is
    encoded as a whole.  ``kept`` are words whose ids are known already, see :func:`frequent_words`; any other word is folded,
    so the ids are the same with and without.
    """

    def whole(t: Column) -> Column:
        def ids_of(w: Column) -> Column:
            if not kept:
                return _folded(t, w)
            return F.coalesce(_let(F.crc32(w.cast("binary")), lambda crc: _cell(t["kept"], t["folds"], w, crc)), _folded(t, w))

        def block(ws: Column) -> Column:
            def with_ids(ids: Column) -> Column:
                def with_rest(rest: Column) -> Column:
                    def joined(parts: Column) -> Column:
                        return F.flatten(F.transform(ws, lambda w, i: F.when(F.get(ids, i).isNotNull(), F.array(F.get(ids, i))).otherwise(F.get(parts, (F.array_position(rest, w) - 1).cast("int")))))

                    return F.when(F.size(rest) == 0, ids).otherwise(_let(F.transform(rest, ids_of), joined))

                return _let(F.array_distinct(F.filter(ws, lambda w, i: F.get(ids, i).isNull())), with_rest)

            return _let(_known(t, ws), with_ids)

        def blocks(ws: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(ws), F.lit(BLOCK))
            return F.when(F.size(ws) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(starts, lambda i: block(F.slice(ws, i, BLOCK)))))

        return _let(cut_words(text), blocks)

    return F.when(text.isNull() | (text == ""), F.array().cast("array<int>")).otherwise(_let(_tables(path, kept), whole))


def frequent_words(df: DataFrame, text: str, path: str = VOCABULARY, most: int = MOST_KEPT, longest: int = LONGEST_KEPT) -> dict[str, list[int]]:
    """The ids of the words that the corpus repeats most and that aren't tokens: each is folded once, instead of once a text.

    All texts are counted; what is kept has a fixed bound, ``most`` words of ``longest`` bytes, whatever the corpus, so it can be a literal of the
    plan.  It changes how often a word is folded and never its ids.
    """
    spark = df.sparkSession
    words = df.select(F.explode(cut_words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= longest))
    new = words.where(_let(_tables(path), lambda t: F.get(_known(t, F.array("word")), F.lit(0)).isNull()))
    top = new.orderBy(F.desc("n"), F.asc("word")).limit(most)
    # Few rows, each dear: over all cores.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folded = top.select("word").repartition(tasks, "word").select("word", _let(_tables(path), lambda t: _folded(t, F.col("word"))).alias("ids"))
    return {r["word"]: list(r["ids"]) for r in folded.collect()}


def count(text: Column, path: str = VOCABULARY) -> Column:
    """The length of :func:`encode`, as bigint, without putting the ids together."""

    def whole(t: Column) -> Column:
        def block(ws: Column) -> Column:
            def with_rest(rest: Column) -> Column:
                distinct = F.array_distinct(rest)
                folded = lambda d: _let(F.transform(d, lambda w: F.size(_folded(t, w))), lambda n: F.aggregate(rest, F.lit(0), lambda a, w: a + F.get(n, (F.array_position(d, w) - 1).cast("int"))))
                return F.size(ws) - F.size(rest) + F.when(F.size(rest) == 0, 0).otherwise(_let(distinct, folded))

            return _let(_let(_known(t, ws), lambda ids: F.filter(ws, lambda _, i: F.get(ids, i).isNull())), with_rest)

        def blocks(ws: Column) -> Column:
            starts = F.sequence(F.lit(1), F.size(ws), F.lit(BLOCK))
            return F.when(F.size(ws) == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(starts, F.lit(0).cast("bigint"), lambda a, i: a + block(F.slice(ws, i, BLOCK))))

        return _let(cut_words(text), blocks)

    return F.when(text.isNull() | (text == ""), F.lit(0).cast("bigint")).otherwise(_let(_tables(path), whole))


def word_lengths(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, tokens) of distinct pre-tokenised words: 1 for a token, else the length of its fold.

    Words are few and folds are dear, so they are spread over all cores, however small they are.
    """

    def length(t: Column) -> Column:
        w = F.col("word")
        return _let(_known(t, F.array(w)), lambda ids: F.when(F.get(ids, F.lit(0)).isNotNull(), 1).otherwise(F.size(_folded(t, w))))

    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return words.select("word").distinct().repartition(tasks, "word").select("word", _let(_tables(path), length).cast("bigint").alias("tokens"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it has fewer splits than cores: a text costs far more to encode than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of token ids: their binary pieces, concatenated.  Null for null; unknown ids are an error."""
    v = vocabulary(path)
    top = max(v["pieces"])
    pieces = F.from_json(F.lit(json.dumps([v["pieces"].get(i, b"").hex() for i in range(top + 1)])), "array<string>")
    return _let(pieces, lambda t: F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(t, i + 1)), "")), "UTF-8"))
