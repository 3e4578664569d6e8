"""The telemetry tables, as projections of the tables that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.sources.tables import table

HOUR = 3600


def case_of(user: Column) -> Column:
    return F.concat(F.lit("c"), (user % 4).cast("string"))


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, ts, obs_idx, metric, entity, signal, value): hourly count, sum and mean of every event type.

    Hours without events have count and sum 0 and no mean.  The hours come from one pass for the bounds; the spine has a row per
    case, type and hour, however many events there are.
    """
    ev = table(spark, folder, "events", ["ts", "user_id", "event_type", "value"]).select(case_of(F.col("user_id")).alias("case_id"), F.col("event_type").alias("entity"), (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / HOUR) * HOUR).cast("bigint").alias("ts"), "value")
    low, high = ev.agg(F.min("ts"), F.max("ts")).first()
    hours = F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"), F.lit(HOUR).cast("bigint"))) if low is not None else F.explode(F.array().cast("array<bigint>"))
    spine = ev.select("case_id", "entity").distinct().select("case_id", "entity", hours.alias("ts"))
    each = ev.groupBy("case_id", "entity", "ts").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("a"))
    joined = spine.join(each, ["case_id", "entity", "ts"], "left")
    signals = F.array(
        F.struct(F.lit("count").alias("signal"), F.coalesce("n", F.lit(0)).cast("double").alias("value")),
        F.struct(F.lit("sum").alias("signal"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("value")),
        F.struct(F.lit("avg").alias("signal"), F.round("a", 6).alias("value")),
    )
    idx = F.floor((F.col("ts") - F.lit(low or 0)) / HOUR).cast("int")
    return joined.select("case_id", "ts", idx.alias("obs_idx"), "entity", F.inline(signals)).select("case_id", "ts", "obs_idx", F.concat_ws("_", "entity", "signal").alias("metric"), "entity", "signal", "value")


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """(case_id, trace_id, span_id, parent_span_id, service, start_us, duration_us): a user's day is a trace, each event a span."""
    from pyspark.sql import Window

    ev = table(spark, folder, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    trace = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    base = ev.select(case_of(F.col("user_id")).alias("case_id"), trace.alias("trace_id"), F.col("event_id").alias("span_id"), F.col("event_type").alias("service"), F.unix_micros(F.col("ts").cast("timestamp")).alias("start_us"), F.round(F.col("value") * 1_000_000).cast("bigint").alias("duration_us"))
    return base.withColumn("parent_span_id", F.lag("span_id").over(Window.partitionBy("trace_id").orderBy("start_us", "span_id")))


def order_spans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(parents, children): an order of 60 days, and its line items, which overlap and reach beyond it; in days."""
    o = table(spark, folder, "orders", ["o_orderkey", "o_orderdate", "o_orderpriority"])
    li = table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus"])
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    parents = o.select(F.col("o_orderkey").alias("span_id"), F.col("o_orderpriority").alias("service"), day("o_orderdate").alias("start"), F.lit(60).cast("bigint").alias("duration"))
    children = li.select(F.col("l_orderkey").alias("parent_span_id"), F.col("l_linenumber").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("service"), day("l_shipdate").alias("start"), F.col("l_quantity").cast("bigint").alias("duration"))
    return parents, children


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """(container, timestamp, message) of the documents."""
    return table(spark, folder, "documents", ["doc_id", "source", "text"]).select(F.lower(F.trim("source")).alias("container"), F.col("doc_id").alias("timestamp"), F.col("text").alias("message"))
