"""Ranks and running sums over groups of any size, without a task that holds a whole group.

Rows are range-partitioned on (group, order); every partition numbers its own stretch of a group, and the small
table of stretch totals (at most partitions + groups rows, one running sum over it) shifts those numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.lineage import cut


def running(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``_pos`` (1-based position in the group) and ``_sum`` (inclusive running sum of ``weight``, or the position).

    ``order`` must be total inside a group.  The result is a written table: positions don't move on a retry.
    """
    n = [partitions] if partitions else []
    weighed = df.withColumn("__w", F.coalesce(F.col(weight), F.lit(0)).cast("double") if weight else F.lit(1.0))
    laid = cut(weighed.repartitionByRange(*n, *[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id()))
    stretch = laid.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.sum("__w").alias("__t"))
    # The partition number grows along the range, so it orders the stretches of a group.
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = stretch.select(
        *[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)],
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        F.coalesce(F.sum("__t").over(before), F.lit(0.0)).alias("__t0"),
    )
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    numbered = laid.withColumn("__i", F.row_number().over(inside)).withColumn("__c", F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    on = [F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(group)] + [F.col("__part") == F.col("__p")]
    return (
        numbered.join(start, on)
        .withColumn("_pos", (F.col("__n0") + F.col("__i")).cast("bigint"))
        .withColumn("_sum", F.col("__t0") + F.col("__c"))
        .drop("__w", "__part", "__i", "__c", "__p", "__n0", "__t0", *[f"__k{i}" for i in range(len(group))])
    )
