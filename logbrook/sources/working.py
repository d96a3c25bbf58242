"""Tables between the steps of a plan, in the folder that driver and executors share.

``spark.checkpoint.dir`` names it; a temporary folder stands in only where it is unset, as in tests.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Working:
    """Writes tables and reads them back, so that what follows has a short lineage; the driver's end removes them."""

    def __init__(self, spark: SparkSession, name: str):
        found = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
        self.spark, self.path, self.count = spark, f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.parquet(at := f"{self.path}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return
