"""Working tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Only where it is unset (tests, a laptop) a temporary
folder is made, once a session.  Lineage is cut by writing Parquet there, so a lost executor costs the
tasks that it ran and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder as a URI or path."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("logbrook.scratch.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="logbrook-")
        spark.conf.set("logbrook.scratch.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a narrow table that are worth a partition; partitions of a core, at least.
NARROW, TASKS = 50_000, 4


class Scratch:
    """A folder of its own for one run of an operator; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._last)

    def _last(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes df and reads it back; the result's lineage is the files alone."""
        df.write.mode("overwrite").option("compression", codec).parquet(at := f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.path}/{name}")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, rows: int) -> int:
    """Partitions of about `rows` rows of a written table (its count is in the files' footers), never below the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / rows))


def few(df: DataFrame, rows: int, each: int = NARROW) -> DataFrame:
    """df of about `rows` rows at most, in no more partitions than they are worth: a file costs more than a few rows in it."""
    return df.coalesce(max(TASKS * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / each)))


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str, default: str | None = None):
    before = spark.conf.get(name) if default is None else spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def file_a_task(spark: SparkSession):
    """While this holds, a task reads one file, or a piece of a large one, where a session may say so; else as many as it likes."""
    return _set(spark, "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))


def shuffles_go(spark: SparkSession):
    """While this holds, what is written or collected leaves no shuffle files, which else wait until the driver's JVM collects the plan."""
    return _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")
