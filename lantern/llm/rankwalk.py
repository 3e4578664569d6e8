"""One ranking from several scores of different scale: a Markov chain that walks up the rankings.

From an item a score is picked at random and the walk goes to one of the items that this score places strictly higher, or
stays, all with the same chance.  Only orders count, so no scale or outlier can dominate.  With damping the chain has one
stationary distribution; items are ordered by it.  The step for item j in one score is the sum over all strictly lower
items i of p_i / (h_i + 1), plus its own p_j / (h_j + 1), where h is the number of strictly higher items: a prefix sum along
the sorted score, so a step costs O(n) and no pair of items is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.blocks import running
from lantern.lineage import cut
from lantern.llm.topn import split_heavy

#: Of a share times the size of its group, which is about 1 whatever the size.
DIGITS = 9


def _walk(values: list[np.ndarray], sizes: np.ndarray, damping: float, steps: int, tolerance: float) -> np.ndarray:
    """The shares, times the size of the group, of groups that are rows of matrices, padded at the right.

    Sums run along a row and a group stops by its own change, so the result of a group doesn't depend on its neighbours.
    """
    count, width = values[0].shape
    cols = np.arange(width)[None, :]
    inside = cols < sizes[:, None]
    base = np.arange(count)[:, None] * width
    laid = []
    for v in values:
        valid = inside & ~np.isnan(v)
        v = np.where(valid, v, 0.0)
        order = np.lexsort((v, valid, ~inside), axis=1)
        v, ok, real = (np.take_along_axis(x, order, 1) for x in (v, valid, inside))
        fresh = np.ones((count, width + 1), bool)  # where a new value begins; the last place is past the end
        fresh[:, 1:-1] = (real[:, 1:] != real[:, :-1]) | (ok[:, 1:] != ok[:, :-1]) | (ok[:, 1:] & (v[:, 1:] != v[:, :-1]))
        low = np.maximum.accumulate(np.where(fresh[:, :-1], cols, 0), axis=1)
        past = np.where(fresh[:, 1:], cols + 1, width)
        end = np.flip(np.minimum.accumulate(np.flip(past, 1), axis=1), 1)
        share = np.where(real, 1.0 / (sizes[:, None] - np.minimum(end, sizes[:, None]) + 1), 0.0)
        laid.append(((base + order).ravel(), (np.arange(count)[:, None] * (width + 1) + low).ravel(), share))
    p, open_ = inside.astype(float), np.ones(count, bool)
    run = np.zeros((count, width + 1))
    for _ in range(steps):
        new = np.zeros(count * width)
        for order, low, share in laid:
            w = p.ravel()[order].reshape(count, width) * share
            np.cumsum(w, axis=1, out=run[:, 1:])
            new[order] += run.ravel()[low] + w.ravel()
        new = np.where(inside, (1 - damping) + damping * new.reshape(count, width) / len(laid), 0.0)
        change = np.abs(new - p).max(axis=1)
        p = np.where(open_[:, None], new, p)
        open_ &= change >= tolerance
        if not open_.any():
            break
    return p


def _stationary(groups: np.ndarray, sizes: np.ndarray, scores: list[np.ndarray], damping: float, steps: int, tolerance: float) -> np.ndarray:
    """The stationary shares of many groups; rows are contiguous by group, NaN marks no evidence (lowest place).

    Groups of like size are walked together.
    """
    n, first = len(groups), np.cumsum(sizes) - sizes
    p = np.empty(n)
    by = np.argsort(sizes, kind="stable")
    ordered, at = sizes[by], 0
    while at < len(sizes):
        least = int(ordered[at])
        upto = int(np.searchsorted(ordered, least + least // 4, "right"))
        upto = min(upto, at + max(1, 200_000 // int(ordered[upto - 1])))
        some, width = by[at:upto], int(ordered[upto - 1])
        inside = np.arange(width)[None, :] < sizes[some][:, None]
        rows = np.where(inside, first[some][:, None] + np.arange(width)[None, :], 0)
        walked = _walk([s[rows] for s in scores], sizes[some], damping, steps, tolerance) / sizes[some][:, None]
        p[rows[inside]] = walked[inside]
        at = upto
    return p


def _light(df: DataFrame, n_scores: int, damping: float, steps: int, tolerance: float) -> DataFrame:
    """Groups of ``heavy_rows`` rows at most: packed to one row each, many walked at once in numpy."""
    row = F.struct("_item", *[f"_s{i}" for i in range(n_scores)])
    packed = df.groupBy("_group").agg(F.collect_list(row).alias("rows"))  # df is already clustered by group
    item_type, group_type = df.schema["_item"].dataType, df.schema["_group"].dataType
    out = T.StructType([T.StructField("_group", group_type), T.StructField("_item", item_type), T.StructField("_p", T.DoubleType()), T.StructField("_place", T.IntegerType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            ends, at = np.cumsum(sizes), 0
            while at < len(sizes):  # some 200,000 items at a time, and always whole groups
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 200_000)))
                part, size = lists[at:upto].flatten(), sizes[at:upto]
                ids = np.repeat(np.arange(len(size)), size)
                scores = [part.field(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(n_scores)]
                p = _stationary(ids, size, scores, damping, steps, tolerance)
                flat = pa.table({"g": ids, "p": -np.round(p * np.repeat(size, size), DIGITS), "i": part.field(0)})
                order = pc.sort_indices(flat, sort_keys=[("g", "ascending"), ("p", "ascending"), ("i", "ascending")])
                laid = flat.take(order)
                group = batch.column("_group")[at:upto].take(laid["g"].combine_chunks())
                place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size) + 1
                yield pa.RecordBatch.from_arrays([group, laid["i"].combine_chunks(), pc.divide(pc.negate(laid["p"].combine_chunks()), pa.array(np.repeat(size, size), pa.float64())), pa.array(place, pa.int32())], ["_group", "_item", "_p", "_place"])
                at = upto

    return packed.mapInArrow(walk, out)


def _heavy(df: DataFrame, n_scores: int, damping: float, steps: int, tolerance: float, block: int = 4096) -> DataFrame:
    """Groups of any size, as DataFrames: tied items are summed first, so no task holds a group or a tie.  _p is a share times _size."""
    long = df.select("_group", "_item", F.posexplode(F.array(*[f"_s{i}" for i in range(n_scores)])).alias("_k", "_v"))
    values = long.groupBy("_group", "_k", "_v").agg(F.count("*").alias("_n"))
    # Distinct values get dense numbers by their order; null sorts first, which is the lowest place.
    dense = cut(running(values, ["_group", "_k"], [F.col("_v").asc_nulls_first()], "_n").select("_group", "_k", "_v", F.col("_pos").alias("_i"), F.col("_sum").alias("_upto")))
    sizes = df.groupBy("_group").agg(F.count("*").alias("_size"))
    same = F.col("l._group").eqNullSafe(F.col("d._group")) & (F.col("l._k") == F.col("d._k")) & F.col("l._v").eqNullSafe(F.col("d._v"))
    placed = long.alias("l").join(dense.alias("d"), same).select("l._group", "l._item", "l._k", "_i", "_upto")
    placed = placed.alias("a").join(sizes.alias("b"), F.col("a._group").eqNullSafe(F.col("b._group"))).select("a._group", "_item", "_size", F.struct("_k", "_i", (F.col("_size") - F.col("_upto") + 1).alias("_div")).alias("_spot"))
    # A row is an item with its share and its place in every score, so a step moves nothing but shares to places and back.
    p = cut(placed.groupBy("_group", "_item").agg(F.first("_size").alias("_size"), F.lit(1.0).alias("_p"), F.collect_list("_spot").alias("_spots")))
    for _ in range(steps):
        mass = p.select("_group", "_item", "_size", "_p", F.inline("_spots")).withColumn("_w", F.col("_p") / F.col("_div"))
        tied = mass.groupBy("_group", "_k", "_i").agg(F.sum("_w").alias("_w")).withColumn("_b", F.floor(F.col("_i") / block))
        blocks = tied.groupBy("_group", "_k", "_b").agg(F.sum("_w").alias("_bw"))
        before = Window.partitionBy("_group", "_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        start = blocks.select(F.col("_group").alias("_g"), F.col("_k").alias("_kk"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_bw").over(before), F.lit(0.0)).alias("_base"))
        inside = Window.partitionBy("_group", "_k", "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        low = tied.withColumn("_in", F.coalesce(F.sum("_w").over(inside), F.lit(0.0))).join(start, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_k") == F.col("_kk")) & (F.col("_b") == F.col("_bb")))
        flow = low.select(F.col("_group").alias("_g"), F.col("_k").alias("_kk"), F.col("_i").alias("_ii"), (F.col("_in") + F.col("_base")).alias("_flow"))
        got = mass.join(flow, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_k") == F.col("_kk")) & (F.col("_i") == F.col("_ii")))
        new = got.groupBy("_group", "_item").agg(F.sum(F.col("_flow") + F.col("_w")).alias("_t"), F.first("_size").alias("_size"), F.first("_p").alias("_old"), F.collect_list(F.struct("_k", "_i", "_div")).alias("_spots"))
        step = cut(new.select("_group", "_item", "_size", ((1 - damping) + damping * F.col("_t") / n_scores).alias("_p"), "_spots", "_old"))
        p = step.drop("_old")
        if step.where(F.abs(F.col("_p") - F.col("_old")) >= tolerance).isEmpty():
            break
    return p.select("_group", "_item", "_p", "_size")


def rank_walk(
    df: DataFrame,
    group: str,
    item: str,
    scores: Sequence[str],
    damping: float = 0.85,
    steps: int = 300,
    tolerance: float = 1e-12,
    heavy_rows: int = 50_000,
    prepare: Callable[[DataFrame], DataFrame] = lambda x: x,
) -> DataFrame:
    """(group, item, stationarity, place): every item of every group in one order; more is higher in every score.

    ``prepare`` cleans rows within their group (revisions, names) and runs after groups were split by size, so that the
    rows of light groups move once only.  Repeated (group, item) rows are walked as one, with the largest value of each
    score.  A null or NaN score is no evidence: the item takes the lowest place of that score, tied with others without
    one.  Infinities are ordinary largest and smallest values.  Equal stationarity (9 decimals of it times the size of
    the group; ``tolerance`` is of that as well) is ordered by item, ascending.  Rows without group or item form the group or item null.  An empty table gives an empty table.
    """
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(f"_s{i}") for i, s in enumerate(scores)]

    def once(rows: DataFrame) -> DataFrame:
        named = prepare(rows).select(F.col(group).alias("_group"), F.col(item).alias("_item"), *clean)
        return named.groupBy("_group", "_item").agg(*[F.max(f"_s{i}").alias(f"_s{i}") for i in range(len(scores))])

    light, heavy = split_heavy(df, [group], heavy_rows)
    walked = _light(once(light.repartition(F.col(group))), len(scores), damping, steps, tolerance)
    if heavy is not None:
        p = _heavy(cut(once(heavy)), len(scores), damping, steps, tolerance)
        rounded = p.withColumn("_p", F.round("_p", DIGITS))
        placed = running(rounded, ["_group"], [F.col("_p").desc(), F.col("_item").asc()])
        walked = walked.unionByName(placed.select("_group", "_item", (F.col("_p") / F.col("_size")).alias("_p"), F.col("_pos").cast("int").alias("_place")))
    return walked.select(F.col("_group").alias(group), F.col("_item").alias(item), F.col("_p").alias("stationarity"), F.col("_place").alias("place"))


def valid_profiles(profiles: DataFrame, scores: Sequence[str]) -> DataFrame:
    """(case_id, service, scores): the valid revision of each profile of a case; its service is entity, or service_id where that is empty.

    A profile without any name has no candidate and is left out.
    """
    name = F.coalesce(F.nullif(F.trim("entity"), F.lit("")), F.nullif(F.trim("service_id"), F.lit("")))
    newest = F.max(F.struct("ingested_at", "scored_at", name.alias("service"), *scores)).alias("m")
    return profiles.groupBy("case_id", "profile_id").agg(newest).select("case_id", "m.service", *[f"m.{s}" for s in scores]).where("service is not null")
