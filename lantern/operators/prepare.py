"""Preparation of telemetry: wide tables, names, subsets of cases, and what a query text may hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lantern.blocks import running

#: What a log line says when a service was changed.
CHANGES = ("deploy", "restarting", "configuration changed", "started container")

#: Fields that no query text may name, since they give the answer away.
PROHIBITED = ("ground_truth", "root_cause_service", "fault_type", "inject_time", "injection_time", "post_recovery", "remediation", "final_rca")


def unpivot(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, metric, value): every numeric column that is no key, as a row of its own; nulls are kept.  One pass, no shuffle."""
    numeric = [f.name for f in wide.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keys]
    values = [F.col(c).cast("double").alias(c) for c in numeric]
    return wide.select(*keys, *values).unpivot(list(keys), numeric, "metric", "value")


def aliased(name: Column, aliases: Mapping[str, str]) -> Column:
    """The name that an alias stands for; only exact aliases are known, any other name, and null, stays."""
    if not aliases:
        return name
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def is_change(message: Column) -> Column:
    """Whether a log line tells of a deployment, restart or changed configuration; null is no line."""
    said = F.lower(message)
    out = F.lit(False)
    for word in CHANGES:
        out = out | said.contains(word)
    return F.coalesce(out, F.lit(False))


def of_dataset(target: str, suites: Sequence[str], suite: Column, dataset: Column, system: Column) -> Column:
    """Whether a case belongs to a data set: a whole suite, a suite's system (``suite-system``), or the data set of that name.  Null belongs to none."""
    wanted = target.upper()
    head, _, tail = wanted.partition("-")
    if wanted in suites:
        hit = (suite == wanted) | dataset.startswith(wanted)
    elif head in suites and tail:
        hit = (dataset == wanted) | ((suite == head) & (F.lower(system) == tail.lower()))
    else:
        hit = F.upper(dataset) == wanted
    return F.coalesce(hit, F.lit(False))


def ordered_unique(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of every key by ``order``, whole: an aggregate that combines on the map side, so a key may repeat at will."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("_rest"))).alias("_m")
    return df.groupBy(*keys).agg(first).select(*keys, "_m._rest.*")


def violations(text: Column, tokens: Sequence[str] = PROHIBITED) -> Column:
    """The tokens that a text holds, in any letter case; none for null."""
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.coalesce(F.contains(F.lower(text), t), F.lit(False)))


def leak_free(df: DataFrame, text: str, tokens: Sequence[str] = PROHIBITED) -> DataFrame:
    """``df`` itself; a text that holds a prohibited token is an error when the result is read."""
    bad = violations(F.col(text), tokens)
    stop = F.raise_error(F.concat(F.lit("prohibited: "), F.array_join(bad, ", ")))
    return df.withColumn(text, F.when(F.size(bad) > 0, stop.cast("string")).otherwise(F.col(text)))


def query_text(df: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """(key, query): only the allowed columns, in that order, joined by blanks; arrays give their elements, nulls and empty texts nothing."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.col(c).cast("array<string>") if isinstance(types[c], T.ArrayType) else F.array(F.col(c).cast("string")) for c in allowed]
    flat = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return df.select(key, F.array_join(F.filter(flat, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), " ").alias("query"))


def scalar_files(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, scalar): the number in each text file, named by the folder that holds it."""
    parts = F.split(F.input_file_name(), "/")
    return spark.read.text(path, wholetext=True).select(F.element_at(parts, -2).alias("case_id"), F.trim(F.col("value")).cast("bigint").alias("scalar"))


def cross_checked(index: DataFrame, scalars: DataFrame, column: str) -> DataFrame:
    """``index`` itself; a case whose file has another number than its row is an error when read, a case without a file is not."""
    told = scalars.select(F.col("case_id").alias("_c"), "scalar")
    joined = index.join(told, F.col("case_id") == F.col("_c"), "left")
    off = F.col("scalar").isNotNull() & ~F.col("scalar").eqNullSafe(F.col(column))
    stop = F.raise_error(F.concat(F.lit(f"{column} differs from its file: "), F.col("case_id"))).cast(index.schema[column].dataType)
    return joined.withColumn(column, F.when(off, stop).otherwise(F.col(column))).select(*index.columns)


def ordered_index(df: DataFrame, keys: Sequence[str], time: str, ordinal: str) -> DataFrame:
    """``df`` and ``obs_idx``, the 0-based place of a row in its group by time; rows of the same time keep the order of ``ordinal``.

    Rows are numbered by ranges of (group, time), so a group of any size is spread over tasks.
    """
    placed = running(df, keys, [F.col(time).asc_nulls_first(), F.col(ordinal).asc_nulls_first()])
    return placed.withColumn("obs_idx", (F.col("_pos") - 1).cast("bigint")).drop("_pos", "_sum")
