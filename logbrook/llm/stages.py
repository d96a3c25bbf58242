"""Operators as filters and rewriters of the documents table, for pipelines.

Defined cases, beside those of the operators: null and empty texts are no reason to drop a row (they
score as the bias alone, have no lines, link with nothing and hit nothing) and take no part in a mix, as
they have no words; repeated rows are judged alike, and one of them is left after near-dedup where they
have an id; ties go to the smallest id; very long texts are rows like any other; an empty table gives no
rows; all other columns, whatever they are called, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from . import decontaminate, line_dedup, mixing, near_dedup, toxicity
from .scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs whose toxicity score is below `limit`."""
    model = toxicity.train(docs, labels)
    name = K.free(docs.columns, toxicity.SCORE)[0]
    return toxicity.score(docs, model).where(F.col(name) < limit).drop(name)


def cut_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without lines that stand on many sites; n_chars follows the text where it changed."""
    found = line_dedup.line_dedup(docs, Scratch(spark, "line-dedup"))
    counts = K.free(docs.columns, *line_dedup.COUNTS)
    if "n_chars" in docs.columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(counts[1]) > 0, now).otherwise(F.col("n_chars")))
    return found.drop(*counts)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id.

    Rows without an id stay.  Of rows that share an id, which are one document to the join, each distinct
    text stays once; of those with the same text, the one whose other columns sort first.
    """
    found = near_dedup.near_components(docs.select("doc_id", "text"), Scratch(spark, "near-dedup"))
    stay = found.where("id = component").select(F.col("id").alias("doc_id")).distinct()
    kept = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi")
    place = K.free(docs.columns, "__place")[0]
    order = W.partitionBy("doc_id", F.xxhash64("text")).orderBy(*[F.xxhash64(F.col(f"`{c}`")) for c in docs.columns if c != "doc_id"])
    once = kept.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return once.unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without a window of a benchmark item."""
    return decontaminate.clean(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix: docs' rows as often as they are taken, numbered in `copy`."""
    return mixing.mixed_rows(docs, Scratch(spark, "mixing"))
