"""Cutting lineage, in a folder that every executor can read.

Iterative operators must not carry an ever longer plan, and must not depend on blocks that live on one
executor only.  :func:`cut` therefore writes a table below the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where the session names none and all runs on this machine.

    A cluster without such a folder is an error: its executors could not read each other's tables.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    own = tempfile.mkdtemp(prefix="lantern-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame, *partition_by: str, **options: str | int) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, with the writer's ``options``, and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lantern-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of an action go when the action ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop(table: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote and that no later plan reads."""
    files = table.inputFiles()
    for spark, path in list(_written):
        if files and path.rpartition("/")[2] in files[0]:
            _written.remove((spark, path))
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # a session that is gone, or a folder; the cluster's own clean-up has what is left
        pass


def release() -> None:
    """Delete what :func:`cut` wrote.  Also runs at exit, as long as the session still answers."""
    while _written:
        _delete(*_written.pop())


atexit.register(release)
