"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest, one row per distinct text, in a folder that
all executors share.  It is made before the first batch.  A batch is reduced to (id, length, digest)
rows, these to one winner per digest (combined map-side, so a text that a third of all rows share costs
one row per task), and the winners meet the index in a sort-merge anti-join that reads the index bucket
by bucket without a shuffle.  What is new is appended in the same buckets.  An ingest that is run again
after a failure finds its own digests and appends nothing.

`exact_dedup` brings a table in as SLICES batches, each a slice of the digests, so that a batch is a
part of the table that fits the cluster while all copies of a text come together.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.  Of equal
texts the row with the most code points stays, then the smallest id; a text that an earlier table
brought stays with that table's row.

Defined cases: a null text counts as empty; empty texts are copies of each other; a null id loses to any
other of that length; fully repeated rows share one keep_id and are all `kept` where they carry it; a very
long text is one row and goes no further than its digest; an empty table returns no rows; columns besides
id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A digest is hot when it holds over one in HOT_SHARE rows; so at most HOT_SHARE digests are hot.
HOT_SHARE = 1000
#: Batches in which a table is brought in.
SLICES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length in code points, digest) of each row; the text goes no further."""
    text = F.col(text_col)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars"),
        F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("digest"),
    )


class DigestIndex:
    """A bucketed table of digests under `path`, which outlives the session."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        if not spark.catalog.tableExists(self.name):  # files of an earlier session, if any, are its rows
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, chars BIGINT, copies BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )
        if name is None:
            atexit.register(self._forget)

    def _forget(self) -> None:
        """An index without a name leaves the catalog with the driver; its files stay where they are."""
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new(self, rows: DataFrame, batch: str = "0") -> DataFrame:
        """The winners of rows (id, chars, digest) whose digest the index lacks."""
        order = F.struct((-F.col("chars")).alias("fewer"), F.col("id").isNull().alias("nameless"), "id")
        winners = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("copies"))
        rows = winners.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.fewer")).alias("chars"), "copies", F.lit(batch).alias("batch"))
        return rows.repartition(self.buckets, "digest").join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def ingest(self, rows: DataFrame, batch: str = "0") -> None:
        (
            self.new(rows, batch).repartition(self.buckets, "digest").write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def judge(self, rows: DataFrame) -> DataFrame:
        """rows with the index's keep_id; hot digests (at most HOT_SHARE) by broadcast, the rest by merge."""
        counted = self.table().select("digest", "keep_id", "copies")
        total = counted.agg(F.sum("copies")).first()[0] or 0
        bound = max(2, total // HOT_SHARE)
        hot = counted.where(F.col("copies") > bound)
        if not hot.take(1):
            return rows.join(counted.hint("merge"), "digest")
        known = hot.select("digest", F.lit(True).alias("is_hot"), F.col("keep_id").alias("hot_keep"), F.col("copies").alias("hot_copies"))
        marked = rows.join(F.broadcast(known), "digest", "left")
        common = marked.where("is_hot").select("id", "chars", "digest", F.col("hot_keep").alias("keep_id"), F.col("hot_copies").alias("copies"))
        rare = marked.where("is_hot is null").select("id", "chars", "digest").join(counted.where(F.col("copies") <= bound).hint("merge"), "digest")
        return common.unionByName(rare)


def exact_dedup(df: DataFrame, index: DigestIndex, staged, batch: str = "0", id_col: str = "doc_id", text_col: str = "text", slices: int = SLICES) -> DataFrame:
    """One row per row of df: id, keep_id, copies in the table that brought the text, kept, digest.

    `staged` writes a narrow table and reads it back, so that the texts are read once.
    """
    rows = staged(digests(df, id_col, text_col))
    for part in range(slices):
        index.ingest(rows.where(F.pmod(F.xxhash64("digest"), F.lit(slices)) == part), batch)
    return index.judge(rows).select("id", "keep_id", "copies", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), "digest")
