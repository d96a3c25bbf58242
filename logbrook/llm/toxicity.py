"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, adjacent pairs and pairs one or two words apart, hashed to
2**BITS places.  Training reads at most `max_train` labelled rows (the lowest hashes of their ids) in
one task, in hash order; each coordinate has its own learning rate, and L1 keeps every weight at zero
whose evidence is thin.  What is left is a short list of (place, weight), at most 2**BITS rows, that
goes to all tasks as a broadcast; scoring is one pass over the texts without a shuffle.

Labels, language, source and id never enter a score; the id only decides the fold.

The bound is on rows: a document that stands in more rows than are left of it is left out of training.

Defined cases: null and empty texts have no features and score sigmoid(bias); a document with several
labels has the highest; null labels don't count; with no training rows all weights are 0 and every
score is 0.5 minus a hair (`predicted` 0); repeated rows score alike, and each counts in training; a very
long text is scored whole, in one task; an empty table gives no rows; further columns pass through, and
where there is one named `score` the score is `score_1`, or the next free number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import kernels as K

BITS = 20
MAX_TRAIN = 24_000
ALPHA, BETA, L1, L2 = 1.5, 1.0, 3.0, 0.1
SCORE = "score"
REACH = 3  # a pair's words are at most this far apart


def features(tokens: K.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every feature, with repeats."""
    h, docs = tokens.hashes, tokens.docs()
    found, owners = [h], [docs]
    for gap in range(1, REACH + 1):
        same = docs[gap:] == docs[:-gap]
        found.append(K.mix(h[:-gap] * K.U64(0x9E3779B97F4A7C15) + h[gap:] + K.U64(1 if gap == 1 else 2))[same])
        owners.append(docs[gap:][same])
    return np.concatenate(owners), (np.concatenate(found) >> K.U64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; place 2**BITS is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, w = self.z[at], np.zeros(len(at))
        live = np.flatnonzero((np.abs(z) > L1) | (at == 1 << BITS))
        size = z[live] - np.sign(z[live]) * np.where(at[live] == 1 << BITS, 0.0, L1)
        w[live] = -size / ((BETA + np.sqrt(self.n[at[live]])) / ALPHA + L2)
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def _train(batches):
    model = Ftrl()
    for batch in batches:
        labels = batch.column("toxic").to_numpy(zero_copy_only=False)
        for a, b, data, offsets in K.slices(batch.column("text")):
            docs, at = features(K.tokenize(data, offsets, K.ALNUM))
            order = np.unique(docs * (1 << BITS) + at)
            bounds = np.searchsorted(order, np.arange(b - a + 1) << BITS)
            for i in range(b - a):
                model.learn(order[bounds[i] : bounds[i + 1]] & ((1 << BITS) - 1), int(labels[a + i]))
    w = model.weights(np.arange((1 << BITS) + 1))
    keep = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(w[keep])], names=["place", "weight"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_train: int, fold: bool) -> DataFrame:
    """(text, toxic) of at most max_train labelled documents; the ids are broadcast, the bound is max_train."""
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    if fold:
        usable = usable.where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    order = F.xxhash64("id", F.lit(7))
    chosen = usable.orderBy(order, "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id")).join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.orderBy(order, "id").rowsBetween(W.unboundedPreceding, W.currentRow))  # over at most max_train rows
    chosen = rows.where(F.col("n") <= max_train).withColumn("upto", upto).where(F.col("upto") <= max_train).select("id", "toxic")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "toxic", order.alias("place"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero."""
    rows = training_rows(docs, labels, id_col, text_col, max_train, fold)
    found = rows.repartition(1).sortWithinPartitions("place", "text").select("text", "toxic").mapInArrow(_train, "place long, weight double").toPandas()
    return found["place"].to_numpy(np.int64), found["weight"].to_numpy(np.float32)


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """A function from a string column to scores."""
    dense: list[np.ndarray] = []

    def score(texts) -> np.ndarray:
        if not dense:
            dense.append(np.zeros((1 << BITS) + 1, np.float32))
            dense[0][model[0]] = model[1]
        w, out = dense[0], np.zeros(len(texts))
        for a, b, data, offsets in K.slices(texts):
            docs, at = features(K.tokenize(data, offsets, K.ALNUM))
            live = w[at] != 0
            once = np.unique(docs[live] * (1 << BITS) + at[live])
            out[a:b] = np.bincount(once >> BITS, w[once & ((1 << BITS) - 1)], b - a)
        logit = np.clip(out + np.float64(w[1 << BITS]) - 1e-9, -35, 35)
        return 1 / (1 + np.exp(-logit))

    return score


def score(docs: DataFrame, model, text_col: str = "text", name: str = SCORE) -> DataFrame:
    """docs with a double column `name`, or the next free one; other columns pass through."""
    name = K.free(docs.columns, name)[0]
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of(batch.column(batch.schema.get_field_index(text_col))))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
