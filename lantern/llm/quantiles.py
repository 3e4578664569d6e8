"""Percentiles of very large numeric columns by radix selection.

Doubles are mapped to integers of the same order, the leading digit of those integers is counted per group, and only
the digit that holds a target rank is followed to the next digit.  The counts of one digit are plain sums, so those of
partitions or days can be kept and added up: that digest alone bounds the relative error by 2**-8; following
the digits gives the exact value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.lineage import cut

#: Bits below the digit after each round: sign, exponent and 8 bits of mantissa first, then 15, 15 and 14 more.
SHIFTS = (44, 29, 14, 0)


def _guess(a: Column) -> Column:
    """The exponent of a size, or one beside it: the logarithm may round across a power of two."""
    return F.least(F.floor(F.log2(a)).cast("double"), F.lit(1023.0))


def _bits(x: Column, a: Column, guess: Column, power: Column) -> Column:
    over, under = power > a, power * 2 <= a  # powers of two themselves are exact
    e = F.when(over, guess - 1).when(under, guess + 1).otherwise(guess)
    scale = F.when(over, power / 2).when(under, power * 2).otherwise(power)
    normal = (e.cast("bigint") + 1023) * F.lit(1 << 52) + ((a / scale - 1) * F.lit(2.0**52)).cast("bigint")
    tiny = (a * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = F.when(a == 0, F.lit(0).cast("bigint")).when(a == float("inf"), F.lit(0x7FF << 52)).when(a < F.lit(2.0**-1022), tiny).otherwise(normal)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("bigint")).otherwise(bits * F.when(x < 0, -1).otherwise(1))


def to_ordered(x: Column) -> Column:
    """The double as a bigint in the same order (its IEEE bits, negated for negatives); -0.0 is 0.  Null and NaN give null."""
    x = x.cast("double")
    a = F.abs(x)
    return _bits(x, a, _guess(a), F.pow(F.lit(2.0), _guess(a)))


def with_ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each of ``columns`` replaced by :func:`to_ordered` of it.

    The same map in steps: what is used several times is a column of its own, so that it is computed once per value.
    """
    others = [c for c in df.columns if c not in columns]
    df = df.select(*others, *[F.col(c).cast("double").alias(c) for c in columns], *[F.abs(F.col(c).cast("double")).alias(f"__a{i}") for i, c in enumerate(columns)])
    df = df.withColumns({f"__g{i}": _guess(F.col(f"__a{i}")) for i in range(len(columns))})
    df = df.withColumns({f"__p{i}": F.pow(F.lit(2.0), F.col(f"__g{i}")) for i in range(len(columns))})
    return df.select(*others, *[_bits(F.col(c), F.col(f"__a{i}"), F.col(f"__g{i}"), F.col(f"__p{i}")).alias(c) for i, c in enumerate(columns)])


def from_ordered(v: Column) -> Column:
    """The double of an integer of :func:`to_ordered`."""
    b = F.abs(v)
    e = F.shiftright(b, 52)
    part = F.pmod(b, F.lit(1 << 52)).cast("double") / F.lit(2.0**52)
    normal = (part + 1) * F.pow(F.lit(2.0), (e - 1023).cast("double"))
    size = F.when(e == 0, b.cast("double") * F.lit(2.0**-537) * F.lit(2.0**-537)).when(e == 0x7FF, F.lit(float("inf"))).otherwise(normal)
    return F.when(v < 0, -size).otherwise(size)


def digest(df: DataFrame, keys: Sequence[str], ordered: str = "_v") -> DataFrame:
    """(keys, digit, n): counts of the leading digit.  Digests of any partitions, days or sources add up."""
    return df.groupBy(*keys, F.shiftright(F.col(ordered), SHIFTS[0]).alias("digit")).agg(F.count("*").alias("n"))


def merge(digests: DataFrame, keys: Sequence[str]) -> DataFrame:
    return digests.groupBy(*keys, "digit").agg(F.sum("n").alias("n"))


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return on


def _locate(counts: DataFrame, keys: Sequence[str], targets: DataFrame) -> DataFrame:
    """(keys, _rank, _q, _prefix, _left): the digit that holds each target rank, and the rank inside it.

    A group has few digits however many rows it has: at most 2**15 in a round, and 2**20 in the first, whatever its rows.
    """
    up = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_to", F.sum("n").over(up)).withColumn("_from", F.col("_to") - F.col("n"))
    named = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_q", "_rank")
    hit = (F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to"))
    return run.join(named, _same(keys) & hit).select(*keys, "_q", F.col("digit").alias("_prefix"), (F.col("_rank") - F.col("_from")).alias("_left"))


def bounds(digests: DataFrame, keys: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """(keys, q, n, value, low, high): quantiles from merged digests only; the true value, of rank ceil(n * q), lies in [low, high)."""
    n = digests.groupBy(*keys).agg(F.sum("n").alias("_n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("_q"), F.greatest(F.lit(1), F.ceil(F.col("_n") * F.lit(float(q)))).cast("bigint").alias("_rank")) for i, q in enumerate(qs)])
    at = _locate(digests, keys, n.select(*keys, F.inline(wanted)))
    low, high = from_ordered(F.shiftleft(F.col("_prefix"), SHIFTS[0])), from_ordered(F.shiftleft(F.col("_prefix") + 1, SHIFTS[0]))
    found = at.join(n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n"), _same(keys))
    q = F.element_at(F.array(*[F.lit(float(x)) for x in qs]), F.col("_q") + 1)
    return found.select(*keys, q.alias("q"), F.col("_n").alias("n"), ((low + high) / 2).alias("value"), low.alias("low"), high.alias("high"))


def bounded(digests: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """(keys, n, value, low, high): :func:`bounds` of one quantile."""
    return bounds(digests, keys, [q]).drop("q")


def exact(df: DataFrame, keys: Sequence[str], qs: Sequence[float], digests: DataFrame | None = None, ordered: str = "_v") -> DataFrame:
    """(keys, n, q, value): exact quantiles, interpolated between the two neighbouring ranks as PERCENTILE_CONT does.

    ``df`` has ``keys`` and the ordered integer; nulls in it don't count, null keys are a group.  The first round counts
    all rows (or adds up ready ``digests``); the second looks at those with a followed digit only, keeps them, and the
    last rounds read nothing else.  Groups without values don't appear.
    """
    rows = df.where(F.col(ordered).isNotNull()).select(*keys, F.col(ordered).alias("_v"))
    first = cut(merge(digests, keys) if digests is not None else digest(rows, keys))
    sizes = first.groupBy(*keys).agg(F.sum("n").alias("_n"))
    # Each quantile needs the ranks on both sides of its place; 2i is the lower, 2i+1 the upper one.
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("_q"), (F.floor((F.col("_n") - 1) * F.lit(float(q))) + 1 if not up else F.ceil((F.col("_n") - 1) * F.lit(float(q))) + 1).cast("bigint").alias("_rank")) for i, q in enumerate(qs) for up in (0, 1)])
    at = cut(_locate(first, keys, sizes.select(*keys, F.inline(wanted))))
    live = rows
    for before, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        # The followed prefixes number at most groups x targets; AQE measures them and broadcasts only if they are small.
        follow = at.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_prefix").alias("_f")).distinct()
        live = live.join(follow, _same(keys) & (F.shiftright(F.col("_v"), before) == F.col("_f")), "left_semi")
        if before == SHIFTS[0]:
            live = cut(live)
        counts = live.groupBy(*keys, F.shiftright(F.col("_v"), before).alias("_p"), F.shiftright(F.col("_v"), shift).alias("digit")).agg(F.count("*").alias("n"))
        at = cut(_locate(counts, [*keys, "_p"], at.select(*keys, F.col("_prefix").alias("_p"), "_q", F.col("_left").alias("_rank"))).drop("_p"))
    value = at.select(*keys, F.floor(F.col("_q") / 2).alias("_i"), (F.col("_q") % 2).alias("_up"), from_ordered(F.col("_prefix")).alias("_x"))
    ends = value.groupBy(*keys, "_i").agg(F.max(F.when(F.col("_up") == 0, F.col("_x"))).alias("_lo"), F.max(F.when(F.col("_up") == 1, F.col("_x"))).alias("_hi"))
    named = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    q = F.element_at(F.array(*[F.lit(float(x)) for x in qs]), (F.col("_i") + 1).cast("int"))
    place = (F.col("_n") - 1) * q
    between = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (place - F.floor(place)))
    return ends.join(named, _same(keys)).select(*keys, F.col("_n").alias("n"), q.alias("q"), between.alias("value"))
