"""The N best items of every group, with groups of very different size.

Exact group counts split the rows: groups above ``heavy_rows`` are laid out by salted range sorting, so that a huge
group is spread over many tasks; all others take the ordinary ordered window.  Both halves are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.lineage import cut

#: Up to so many heavy keys are broadcast; more are joined as a table, with the same result.
MOST_HEAVY = 4096


def _null_safe(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_heavy(df: DataFrame, keys: Sequence[str], heavy_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(light rows, heavy rows or None).  Every group above ``heavy_rows`` is heavy, however many there are.

    The heavy keys are a written table; their number is counted, and decides only whether they are broadcast.
    """
    names = [unused(df, f"_h{i}") for i in range(len(keys))]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > heavy_rows)
    heavy = cut(counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]))
    found = heavy.count()
    if not found:
        return df, None
    if found <= MOST_HEAVY:
        heavy = F.broadcast(heavy)
    on = _null_safe(keys, names)
    return df.join(heavy, on, "left_anti"), df.join(heavy, on, "left_semi")


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    item: str,
    n: int,
    heavy_rows: int = 20_000,
    prepare: Callable[[DataFrame], DataFrame] = lambda x: x,
) -> DataFrame:
    """``keys``, ``item``, ``score`` and ``place`` (1..n) of the n items of highest score of every group.

    Order: score descending, then item ascending (byte order).  ``prepare`` cleans rows group by group (for example
    keeps the latest revision of an item) and runs after the split, so that light rows move once only; it may drop
    rows.  Null, NaN and infinite scores have no place; a null key is a group of its own; equal rows take a place each.
    """
    light, heavy = split_heavy(df, keys, heavy_rows)
    cols = [*keys, item, score]
    order = [F.col(score).desc(), F.col(item).asc_nulls_last()]
    finite = F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(F.col(score)) != float("inf"))

    def usable(x: DataFrame) -> DataFrame:
        return prepare(x).select(*cols).where(finite)

    def ranked(x: DataFrame, *by: str) -> DataFrame:
        return x.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)

    # Light groups are clustered on their keys first: the revisions of an item and the ranking share that one exchange.
    out = ranked(usable(light.repartition(*[F.col(k) for k in keys])), *keys)
    if heavy is not None:
        # The partition number after range sorting is the salt: each stretch of a group gives n rows at most.
        laid = usable(heavy).repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_salt", F.spark_partition_id())
        out = out.unionByName(ranked(ranked(laid, *keys, "_salt").drop("place", "_salt"), *keys))
    return out


def latest(df: DataFrame, key: Sequence[str], when: str, keep: Sequence[str]) -> DataFrame:
    """One row per key: that with the largest ``when`` (null is the smallest), then the largest kept values."""
    newest = F.max(F.struct(F.col(when).alias("_w"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(keep)])).alias("_m")
    return df.groupBy(*key).agg(newest).select(*key, *[F.col(f"_m._v{i}").alias(c) for i, c in enumerate(keep)])
