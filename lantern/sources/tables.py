"""Readers and writers: each gives or takes a DataFrame, nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, with only the named columns read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table that may be absent: then an empty one with the declared schema."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def exactly_one(df: DataFrame, where: Column, what: str) -> DataFrame:
    """The one row that meets ``where``; none or several is an error when the result is read."""
    hit = df.where(where)
    n = hit.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") != 1, F.raise_error(F.concat(F.lit(f"{what}: rows found: "), F.col("_n").cast("string")))).otherwise(F.lit(True)).alias("_ok"))
    return hit.join(F.broadcast(n), F.col("_ok")).drop("_ok")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself; a key that occurs twice is an error when the result is read."""
    bad = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("_n"))
    guard = bad.select(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.lit("keys that occur more than once: "), F.col("_n").cast("string")))).otherwise(F.lit(True)).alias("_ok"))
    return df.join(F.broadcast(guard), F.col("_ok")).drop("_ok")


def corpus(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Documents of a JSON file or folder: a list, or an object with ``documents``; ids and texts under either usual name."""
    if lines:
        raw = spark.read.json(path, schema="id string, document_id string, title string, text string, content string, metadata map<string,string>")
    else:
        entry = "struct<id:string,document_id:string,title:string,text:string,content:string,metadata:map<string,string>>"
        whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("j"))
        listed = F.when(F.col("j").startswith("["), F.from_json("j", f"array<{entry}>")).otherwise(F.from_json("j", f"struct<documents:array<{entry}>>")["documents"])
        raw = whole.select(F.inline(listed))
    return raw.select(F.coalesce("document_id", "id").alias("document_id"), "title", F.coalesce("text", "content").alias("text"), "metadata")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, version: str) -> None:
    """JSON lines, each with the version of the report."""
    df.withColumn("report_version", F.lit(version)).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, version: str) -> DataFrame:
    """What :func:`write_report` wrote, without the version; lines of another version are an error when read."""
    raw = spark.read.json(path)
    if "report_version" not in raw.columns:
        raise ValueError(f"{path} has no report_version")
    bad = F.raise_error(F.concat(F.lit("report of version "), F.coalesce("report_version", F.lit("null")))).cast("boolean")
    return raw.where(F.when(F.col("report_version").eqNullSafe(version), True).otherwise(bad)).drop("report_version")


def feature_cache(df: DataFrame, path: str, key: str = "case_id") -> DataFrame:
    """Features kept as Parquet by case, so that one case is read by partition pruning."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)
    return df.sparkSession.read.parquet(path)


def embedding_key(df: DataFrame, id_col: str) -> DataFrame:
    """One row with the hash that names a set of vectors: that of the sum and the exclusive or of its ids' hashes, in any order of rows."""
    h = F.sha2(F.col(id_col).cast("string"), 256)
    each = df.select(*[F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("bigint").alias(f"h{i}") for i in (0, 1)])
    made = each.agg(F.count("*").alias("n"), F.sum(F.col("h0").cast("decimal(38,0)")).alias("s"), F.bit_xor("h1").alias("x"))
    return made.select(F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "s", "x")]), 256).alias("cache_key"))


def cached_vectors(df: DataFrame, id_col: str, folder: str) -> DataFrame:
    """``df`` as Parquet below ``folder``, under the key of its ids; a set that is there already is read and not made again."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{embedding_key(df, id_col).first()[0]}"
    schema = df.schema
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)
