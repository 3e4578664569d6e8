"""Splits that keep related records together.

Records that share a value of a link column (author, source, entity, family ...) are one unit.  A Borůvka-style
contraction over the bipartite graph record - shared value finds the units: in every round each component takes its
cheapest outgoing edge, the chosen edges join a spanning forest that is written out, and components collapse.  The roots are
then stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.blocks import running
from lantern.lineage import cut


def clean_label(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one '-', none at the ends; empty becomes null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""), F.lit(""))


def link_edges(records: DataFrame, record: str, links: Sequence[str]) -> DataFrame:
    """(u, v): record node and the node of each value that it carries.  A null value links nothing; equal rows give one edge."""
    values = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"v{i}:"), F.col(c).cast("string"))) for i, c in enumerate(links)])
    u = F.concat(F.lit("r:"), F.col(record).cast("string"))
    return records.select(u.alias("u"), F.explode(values).alias("v")).where("u is not null and v is not null").distinct()


def _flatten(parent: DataFrame) -> DataFrame:
    """Pointer jumping: (node, parent) becomes (node, root).  Depth halves, so the rounds are logarithmic."""
    while True:
        up = parent.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        step = cut(parent.join(up, F.col("parent") == F.col("_n"), "left").select("node", F.coalesce("_p", "parent").alias("parent"), (F.col("_p") != F.col("parent")).alias("moved")))
        parent = step.select("node", "parent")
        if step.where("moved").isEmpty():
            return parent


def spanning_forest(edges: DataFrame, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(forest, roots): forest has the chosen (u, v, round), roots has (node, root) for every node that has an edge.

    Edges are ranked by a seeded hash, ties by their ends, so the minimum of a component is unique and the forest is the
    same on every run.  Two components that choose each other form the only possible cycle; the smaller name is its root.
    """
    live = cut(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", F.xxhash64(F.lit(seed), "u", "v").alias("w")))
    roots, forest, round_no = None, None, 0
    while not live.isEmpty():
        round_no += 1
        both = live.select("a", "b", "u", "v", "w").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "w"))
        best = cut(both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.u").alias("u"), F.col("m.v").alias("v")))
        back = best.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        mutual = (F.col("_b") == F.col("a")) & (F.col("a") < F.col("b"))
        parent = best.join(back, F.col("b") == F.col("_a"), "left").select(F.col("a").alias("node"), F.when(mutual, F.col("a")).otherwise(F.col("b")).alias("parent"))
        star = _flatten(parent)
        chosen = best.select("u", "v").distinct().withColumn("round", F.lit(round_no))
        forest = chosen if forest is None else forest.unionAll(chosen)
        new = star.select(F.col("node").alias("_n"), F.col("parent").alias("_r"))
        roots = star.select("node", F.col("parent").alias("root")) if roots is None else cut(roots.join(new, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")))
        at = live.join(new, F.col("a") == F.col("_n")).select(F.col("_r").alias("a"), "b", "u", "v", "w")
        moved = at.join(new, F.col("b") == F.col("_n")).select("a", F.col("_r").alias("b"), "u", "v", "w").where("a <> b")
        # Of parallel edges only the cheapest can ever be chosen.
        pair = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "u", "v", "w")
        live = cut(pair.groupBy("a", "b").agg(F.min(F.struct("w", "u", "v")).alias("m")).select("a", "b", "m.u", "m.v", "m.w"))
    if roots is None:
        empty = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
        return edges.select("u", "v", F.lit(0).alias("round")).limit(0), empty
    return cut(forest), roots


def units(records: DataFrame, record: str, links: Sequence[str], seed: int = 7) -> DataFrame:
    """(record, unit): the unit of every distinct record id; one without any link value is a unit of its own.

    Null record ids are left out.  Extra columns, whatever their names, don't matter.
    """
    only = records.select(F.col(record).alias("_id"), *[F.col(c).alias(f"_l{i}") for i, c in enumerate(links)]).where("_id is not null")
    _, roots = spanning_forest(link_edges(only, "_id", [f"_l{i}" for i in range(len(links))]), seed)
    node = F.concat(F.lit("r:"), F.col("_id").cast("string"))
    named = only.select("_id").distinct().withColumn("_node", node)
    return named.join(roots, F.col("_node") == F.col("node"), "left").select(F.col("_id").alias(record), F.coalesce("root", "_node").alias("unit"))


def deal(unit_of: DataFrame, record: str, shares: Mapping[str, float], seed: int = 7) -> DataFrame:
    """(record, unit, split): whole units go to splits in the given shares of the records.

    Size bands (powers of two) are dealt from the largest to the smallest.  Within a band the units lie on a line in a seeded
    order, as long as their records; it is divided by what each split still lacks after the larger bands, most first, and a unit goes to the
    split that holds its start.  So every band follows the shares, and what a large unit upsets the later bands make good:
    a split misses its share by the records of the largest unit at most.  The driver sees sums per band and split only.
    An empty table gives an empty table.
    """
    total = sum(shares.values())
    if not shares or total <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must be positive")
    sizes = unit_of.groupBy("unit").agg(F.count("*").alias("size")).withColumn("band", F.floor(F.log2("size")).cast("int"))
    line = running(sizes.withColumn("_h", F.xxhash64(F.lit(seed), "unit")), ["band"], [F.col("_h"), F.col("unit")], "size")
    placed = cut(line.select("unit", "size", "band", (F.col("_sum") - F.col("size")).alias("_start")), "band")
    bands = {r["band"]: int(r["n"]) for r in placed.groupBy("band").agg(F.sum("size").alias("n")).collect()}
    lacks = {s: v / total * sum(bands.values()) for s, v in shares.items()}
    split = F.lit(list(shares)[0])
    for band in sorted(bands, reverse=True):
        names = sorted((s for s in shares if lacks[s] > 0), key=lambda s: (-lacks[s], s))
        long, upto, one = sum(lacks[s] for s in names), 0.0, F.lit(names[-1])
        ends = []
        for s in names:
            upto += lacks[s] * bands[band] / long
            ends.append(upto)
        for s, end in list(zip(names, ends, strict=True))[-2::-1]:
            one = F.when(F.col("_start") < end, F.lit(s)).otherwise(one)
        split = F.when(F.col("band") == band, one).otherwise(split)
        if band != min(bands):
            for r in placed.where(F.col("band") == band).groupBy(one.alias("s")).agg(F.sum("size").alias("n")).collect():
                lacks[r["s"]] -= r["n"]
    dealt = placed.select(F.col("unit").alias("_u"), split.alias("split"))
    return unit_of.join(dealt, F.col("unit") == F.col("_u")).select(record, "unit", "split")


def breaches(unit_of: DataFrame, current: DataFrame, record: str, split: str) -> DataFrame:
    """Records of units that now lie in more than one split, with the unit and its splits.  Null splits don't count."""
    now = current.select(F.col(record).alias("_r"), F.col(split).alias("_s")).where("_s is not null")
    joined = unit_of.join(now, F.col(record) == F.col("_r")).select(F.col(record), "unit", F.col("_s").alias("split"))
    # The count is an aggregate, not a window: it combines on the map side, however large a unit is.
    bad = joined.groupBy("unit").agg(F.sort_array(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    return joined.join(bad.withColumnRenamed("unit", "_u"), F.col("unit") == F.col("_u")).select(record, "unit", "split", "splits")


def valid_cases(manifest: DataFrame) -> DataFrame:
    """The valid row of each case (latest ``listed_at``) with clean labels, its family and the repetition.

    An empty suite is what stands before '-' in ``dataset``.  A case without service has no family.
    """
    cols = ["dataset", "system", "fault", "root_cause_service", "repetition", "partition", "suite"]
    newest = F.max(F.struct("listed_at", *cols)).alias("m")
    rows = manifest.select("case_id", "listed_at", *cols).where("case_id is not null").groupBy("case_id").agg(newest).select("case_id", "m.*")
    suite = F.coalesce(clean_label(F.col("suite")), clean_label(F.split_part(F.col("dataset"), F.lit("-"), F.lit(1))))
    service = clean_label(F.col("root_cause_service"))
    family = F.when(service.isNotNull(), F.concat_ws("|", F.coalesce(suite, F.lit("")), F.coalesce(clean_label(F.col("system")), F.lit("")), service, F.coalesce(clean_label(F.col("fault")), F.lit(""))))
    part = F.regexp_replace(clean_label(F.col("partition")), "-", "_")
    return rows.select("case_id", family.alias("family"), part.alias("partition"), "repetition")
