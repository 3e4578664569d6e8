"""Structured Streaming twins: the same results as the batch operators, row by row as the data arrives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lantern.lineage import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream, with an event-time column."""
    raw = spark.readStream.schema(EVENTS).parquet(f"{folder}/event[s].parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, with checkpoints in the shared folder, and give the table it wrote."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/lantern-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{root}/out").start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Count and sum per window and type.  A window comes out when the watermark has passed it; rows later than that are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.unix_seconds("w.start").alias("start_ts"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    g = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


def deduplicated(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rolling_zscore(stream: DataFrame, window: int = 24) -> DataFrame:
    """(event_type, event_id, z): each value against the ``window`` values of its type before it; the state is that ring.

    Batches must arrive in order of event id, as an append-only log does; the state per key is ``window`` numbers.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = np.array(state.get[0] if state.exists else [], float)
        pdf = pd.concat(list(batches)).sort_values("event_id")
        values = pdf["value"].to_numpy(dtype=float)
        line = np.concatenate([ring, values])
        out = np.full(len(line), np.nan)
        if len(line) > window:
            before = np.lib.stride_tricks.sliding_window_view(line[:-1], window)
            out[window:] = np.round((line[window:] - before.mean(axis=1)) / (before.std(axis=1) + 1e-6), 6)
        out = out[len(ring) :]
        state.update((line[-window:].tolist(),))
        yield pd.DataFrame({"event_type": key[0], "event_id": pdf["event_id"].to_numpy(), "z": out})

    return stream.select("event_type", "event_id", "value").groupBy("event_type").applyInPandasWithState(update, "event_type string, event_id bigint, z double", "ring array<double>", "append", "NoTimeout")


def availability(parents: DataFrame, children: DataFrame, key: str, start: str, seen: str, horizon: str, late: str = "1 day") -> DataFrame:
    """(key, start, seen): each child that comes within ``horizon`` of its parent, both as streams.

    Watermarks on both sides bound what either keeps: a parent is forgotten when no child in time can follow.
    """
    p = parents.withWatermark(start, late).select(F.col(key).alias("_k"), start)
    c = children.withWatermark(seen, late)
    return c.join(p, (F.col(key) == F.col("_k")) & (F.col(seen) >= F.col(start)) & (F.col(seen) <= F.col(start) + F.expr(f"interval {horizon}"))).select(key, start, seen)


def orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(orders, line items) as streams, with the days of order and of shipping as event times."""
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}].parquet")
    o = read("orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("timestamp").alias("ordered"))
    li = read("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").cast("timestamp").alias("shipped"))
    return o, li


RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_tumbling": lambda s, d: drain(tumbling(events(s, d))),
    "stream_sliding": lambda s, d: drain(tumbling(events(s, d), "2 hours", "4 hours", "1 hour")),
    "stream_session": lambda s, d: drain(sessions(events(s, d)), "complete"),
    "stream_dedup": lambda s, d: drain(deduplicated(events(s, d), "event_id").select("event_id", "user_id")),
    "stream_join": lambda s, d: drain(availability(*orders(s, d), "key", "ordered", "shipped", "30 days")).groupBy("key").agg(F.count("*").alias("n"), F.unix_seconds(F.max("shipped")).alias("last")),
    "stream_zscore": lambda s, d: drain(rolling_zscore(events(s, d))).where("z is not null and not isnan(z)"),
}
