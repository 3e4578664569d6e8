"""Log templates and anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.blocks import running

#: Words that mark an error.
ERROR = r"(?i)\b(error|exception|fail|failed|failure|fatal|timeout|refused|oom|panic|50[0-9]|unavailable)\b"


def template(message: Column) -> Column:
    """The first 80 characters, with every run of digits as <*>."""
    return F.regexp_replace(F.substring(message, 1, 80), "[0-9]+", "<*>")


def signature(message: Column) -> Column:
    """The whole message with long hexadecimal words as <id>, whole numbers as <n>, and white space collapsed."""
    t = F.regexp_replace(F.regexp_replace(message, r"(?i)\b[0-9a-f]{8,}\b", "<id>"), r"\b[0-9]+\b", "<n>")
    return F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " "))


def score(logs: DataFrame, onset: int) -> DataFrame:
    """(container, baseline, incident, errors, novel, score): 0.4 share of errors, 0.35 novel lines up to 10, 0.25 growth up to 5.

    A line of the incident is novel if its container had no line of that template before the onset.  Null messages are empty
    lines, a null container is the empty name.
    """
    m = F.coalesce("message", F.lit(""))
    x = logs.select(F.coalesce("container", F.lit("")).alias("container"), (F.col("timestamp") >= onset).alias("inc"), template(m).alias("tpl"), m.rlike(ERROR).alias("err"))
    # Lines collapse to counts per template first, so the self join is between aggregates.
    per = x.groupBy("container", "tpl").agg(F.count_if(~F.col("inc")).alias("b"), F.count_if("inc").alias("i"), F.count_if(F.col("inc") & F.col("err")).alias("e"))
    g = per.groupBy("container").agg(F.sum("b").alias("baseline"), F.sum("i").alias("incident"), F.sum("e").alias("errors"), F.sum(F.when(F.col("b") == 0, F.col("i")).otherwise(0)).alias("novel"))
    parts = 0.4 * F.col("errors") / F.col("incident") + 0.35 * F.least(F.lit(10), "novel") / 10.0 + 0.25 * F.least(F.lit(5.0), (F.col("incident") + 1) / (F.col("baseline") + 1)) / 5.0
    return g.withColumn("score", F.round(F.when(F.col("incident") == 0, 0.0).otherwise(parts), 9))


def top_templates(logs: DataFrame, n: int = 3) -> DataFrame:
    c = logs.groupBy(F.coalesce("container", F.lit("")).alias("container"), template(F.coalesce("message", F.lit(""))).alias("template")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("container").orderBy(F.desc("n"), F.asc("template"))
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sampled(logs: DataFrame, most: int) -> DataFrame:
    """Systematic sampling, where a reader asks for at most so many lines: every (n // most)-th line of a container by time.

    Lines are numbered by ranges of (container, time), so a container of any size is spread over tasks.
    """
    named = logs.withColumn("_group", F.coalesce("container", F.lit("")))
    n = named.groupBy(F.col("_group").alias("_g")).agg(F.greatest(F.floor(F.count("*") / most), F.lit(1)).alias("_s"))
    placed = running(named, ["_group"], [F.col("timestamp").asc_nulls_first(), F.col("message").asc_nulls_first()]).drop("_sum")
    return placed.join(n, F.col("_group") == F.col("_g")).where((F.col("_pos") - 1) % F.col("_s") == 0).drop("_pos", "_s", "_g", "_group")
