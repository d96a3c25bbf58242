"""Line dedup by spread over sites.

Each slice of documents gives its distinct (line, site) pairs, lines as 64-bit hashes.  Per line, a
HyperLogLog sketch of the sites is built map-side and the sketches merge in the shuffle, so a line
that half of the corpus carries costs one sketch per task.  Lines whose estimate is clearly above
`min_sites` are boilerplate, those clearly below are not; only those in between are counted exactly,
on the pairs of these lines alone.  Boilerplate lines are then cut from every document.

A document whose lines are all boilerplate is not a carrier of it but a copy that is spread over sites as
a whole; it is left as it is, for document dedup to judge.  `most_cut`, off unless given, also spares
documents that would lose more than that part of their line bytes.

The boilerplate lines go to the tasks as a sorted array while there are at most BROADCAST_LINES of
them (8 bytes each); beyond that the lines of each document meet them in a shuffled semi-join, and
each document gets back its own.

Defined cases: a line is the bytes between newlines without leading and trailing ``[\\x20\\x09-\\x0D]``;
blank lines are kept and never counted; null and empty texts have no lines; a null site is a site of
its own; a line counts once per site however often it is repeated; repeated rows are cut alike;
very long texts are cut like any other, one at a time; an
empty table gives no rows; other columns pass
through, whatever they are called: the counts are named `__n_lines` and `__n_cut`, or where there are such
columns by the next free number (`__n_lines_1`), see COUNTS and kernels.free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

MIN_SITES, LG_K, BAND = 10, 12, 0.25
COUNTS = ("__n_lines", "__n_cut")
BROADCAST_LINES = 4_000_000


class Lines:
    """Non-blank lines of a slice of documents: hashes, byte spans, spans with the newline, and document ranges."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        ends = np.flatnonzero(data == 10)
        heads = np.unique(np.concatenate([offsets[:-1], ends + 1]))
        heads = heads[heads < len(data)]
        words = K.tokenize(data, offsets, K.NOT_SPACE)
        first = np.searchsorted(words.starts, heads)
        after = np.append(first[1:], len(words.starts))
        full = first < after
        self.start, self.end = words.starts[first[full]], words.ends[after[full] - 1]
        self.hashes = K.span_hashes(data, self.start, self.end).view(np.int64)
        self.head = heads[full]
        self.bounds = np.searchsorted(self.start, offsets)
        self.next = np.append(heads[1:], len(data))[full]  # the next line's head, so past the newline
        self.docs = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))


def pairs(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """Distinct (line, site) of each slice."""
    rows = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.concat(F.lit("="), site_col), F.lit(""))).alias("site"))

    def run(batches):
        for batch in batches:
            sites = batch.column("site").to_numpy()
            for a, b, data, offsets in K.slices(batch.column("text")):
                lines = Lines(data, offsets)
                both = np.empty(len(lines.hashes), [("l", "i8"), ("s", "i8")])
                both["l"], both["s"] = lines.hashes, sites[a:b][lines.docs]
                order = np.lexsort((both["s"], both["l"]))
                both = both[order][K.edges(both[order])[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(both["l"].copy()), pa.array(both["s"].copy())], names=["line", "site"])

    return rows.mapInArrow(run, "line long, site long")


def boilerplate(docs: DataFrame, scratch, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites) of the lines on at least min_sites sites; `sites` is exact near the threshold."""
    found = scratch.write(pairs(docs, text_col, site_col), "pairs")
    sketches = found.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    judged = scratch.write(sketches.select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - BAND)), "judged")
    near = judged.where(F.col("sites") <= min_sites * (1 + BAND))
    exact = found.join(near.select("line"), "line", "left_semi").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    out = scratch.write(judged.where(F.col("sites") > min_sites * (1 + BAND)).unionByName(exact), "boilerplate")
    scratch.drop("pairs", "judged")
    return out


def _cut(text: pa.Array, known, most_cut: float | None):
    """Per slice: first row, cleaned texts, lines, lines cut; known(hashes, rows of each) marks boilerplate."""
    for a, b, data, offsets in K.slices(text):
        lines = Lines(data, offsets)
        bad = known(lines.hashes, a + lines.docs)
        size = lines.end - lines.start
        n = b - a
        total, lost = np.bincount(lines.docs, size, n), np.bincount(lines.docs[bad], size[bad], n)
        count = np.bincount(lines.docs, minlength=n)
        cut = (lost > 0) & (lost < total)
        if most_cut is not None:
            cut &= lost <= most_cut * total
        bad &= cut[lines.docs]
        n_cut = np.bincount(lines.docs[bad], minlength=n)
        texts = [None] * n
        for d in np.flatnonzero(n_cut).tolist():
            at, out = int(offsets[d]), []
            for j in range(int(lines.bounds[d]), int(lines.bounds[d + 1])):
                if bad[j]:
                    out.append(data[at : lines.head[j]].tobytes())
                    at = int(min(lines.next[j], offsets[d + 1]))
            out.append(data[at : offsets[d + 1]].tobytes())
            texts[d] = b"".join(out).decode("utf-8")
        yield a, texts, count, n_cut


def _apply(batch: pa.RecordBatch, text_at: int, own: int, known, most_cut: float | None, counts: list[str]):
    text = batch.column(text_at)
    for a, texts, count, n_cut in _cut(text, known, most_cut):
        part = batch.slice(a, len(texts))
        old = part.column(text_at)
        new = [o if t is None else t for o, t in zip(old.to_pylist(), texts)] if n_cut.any() else None
        columns = list(part.columns[:own])
        if new is not None:
            columns[text_at] = pa.array(new, old.type)
        yield pa.RecordBatch.from_arrays([*columns, pa.array(count), pa.array(n_cut)], names=[*batch.schema.names[:own], *counts])


def remove(docs: DataFrame, lines: DataFrame, text_col: str = "text", id_col: str = "doc_id", most_cut: float | None = None, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs without the given lines, with the counts of COUNTS."""
    counts = K.free(docs.columns, *COUNTS)
    own = len(docs.columns)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts)])
    if lines.count() <= broadcast_lines:
        listed = np.sort(lines.select("line").toPandas()["line"].to_numpy(np.int64))
        shared = docs.sparkSession.sparkContext.broadcast(listed)

        def run(batches):
            listed = shared.value

            def known(hashes, rows):
                if not len(listed):
                    return np.zeros(len(hashes), bool)
                return listed[np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)] == hashes

            for batch in batches:
                yield from _apply(batch, at, own, known, most_cut, counts)

        return docs.mapInArrow(run, schema)

    packed = docs.select(F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("a"), F.xxhash64(F.col(text_col)).alias("b")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mine = packed.select("key", F.col(f"row.`{text_col}`").alias("text")).mapInArrow(_lines_of, "a long, b long, line long")
    bad = mine.join(lines.select("line"), "line", "left_semi").groupBy("a", "b").agg(F.collect_set("line").alias("bad"))
    held = packed.join(bad, (F.col("key.a") == F.col("a")) & (F.col("key.b") == F.col("b")), "left").select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("bad").alias(K.free(docs.columns, "__bad")[0]))

    def run_held(batches):
        for batch in batches:
            lists = batch.column(own)
            rows, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(lists.flatten()):
                values = lists.flatten().to_numpy()
                rows = np.repeat(np.arange(len(lists)), [len(x) if x is not None else 0 for x in lists.to_pylist()])
            listed = set(zip(rows.tolist(), values.tolist()))

            def known(hashes, of, listed=listed):
                return np.fromiter(((r, h) in listed for r, h in zip(of.tolist(), hashes.tolist())), bool, len(hashes))

            yield from _apply(batch, at, own, known, most_cut, counts)

    return held.mapInArrow(run_held, schema)


def _lines_of(batches):
    for batch in batches:
        key = batch.column("key")
        a, b = (pa.array(key.field(j)).to_numpy() for j in (0, 1))
        for first, _, data, offsets in K.slices(batch.column("text")):
            lines = Lines(data, offsets)
            rows = first + lines.docs
            yield pa.RecordBatch.from_arrays([pa.array(a[rows]), pa.array(b[rows]), pa.array(lines.hashes)], names=["a", "b", "line"])


def line_dedup(docs: DataFrame, scratch, text_col: str = "text", site_col: str = "source", id_col: str = "doc_id", min_sites: int = MIN_SITES, most_cut: float | None = None, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines cut, and the counts of COUNTS."""
    found = boilerplate(docs, scratch, text_col, site_col, min_sites)
    return remove(docs, found, text_col, id_col, most_cut, broadcast_lines)
