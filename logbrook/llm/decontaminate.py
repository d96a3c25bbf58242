"""Benchmark decontamination with suffix arrays of the training text.

Each shard (a slice of documents, words as numbers, a divider after each document) gets a suffix
array by prefix doubling, in which only suffixes that are still tied are sorted again.  Every test
suffix is binary-searched in it, word by word and for all suffixes at once: the range after `window`
words holds every location of the suffix's window, and going on until the range is empty gives the
longest verbatim match and where it lies.  Shards are independent, so this is a map over the
documents with no shuffle.

The benchmark goes to the tasks in blocks of at most BLOCK_WORDS words.  Up to AT_ONCE blocks pass over
the documents one after another within the same stage; a larger benchmark makes more such passes, and
what they found is written between them, so that no task holds more than AT_ONCE blocks.

Defined cases: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null and
empty texts have no words and are clean; an item of fewer words than the window is one window; items
without words, or with a null id, are ignored; rows with the same item_id are one item; repeated
documents are judged alike; an empty benchmark finds nothing; of matches of the same length the first in
the text, then of the first item is the longest; a very long text is a shard of its own; an empty table
gives no rows; other columns pass through, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import Scratch

WINDOW = 10
BLOCK_WORDS = 2_000_000
#: Blocks that are broadcast at a time.
AT_ONCE = 4
WORDS, SPANS, ITEMS, LONGEST = FOUND_AS = ("__n_words", "__spans", "__items", "__longest")


class Block:
    """Test suffixes of some items, as words' hashes with the windows that start them."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.names = [name for name, _ in items]
        self.text = np.concatenate([h for _, h in items] or [np.zeros(0, K.U64)])
        starts, ends, owner, size = [], [], [], []
        at = 0
        for k, (_, h) in enumerate(items):
            n = min(window, len(h))
            places = np.arange(at, at + len(h) - n + 1)
            starts.append(places)
            ends.append(np.full(len(places), at + len(h)))
            owner.append(np.full(len(places), k))
            size.append(np.full(len(places), n))
            at += len(h)
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        self.start, self.end, self.owner, self.size = join(starts), join(ends), join(owner), join(size)
        keys = np.zeros(len(self.start), K.U64)
        for n in np.unique(self.size):
            here = self.size == n
            keys[here] = K.runs(self.text, int(n))[self.start[here]]
        _, self.first, self.window = np.unique(keys, return_index=True, return_inverse=True)  # equal windows are searched once

        order = np.argsort(self.window, kind="stable")
        self.by_window, self.window_at = order, np.searchsorted(self.window[order], np.arange(len(self.first) + 1))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK_WORDS) -> Iterator[Block]:
    held, words = [], 0
    rows = benchmark.selectExpr(f"cast(`{id_col}` as string) as id", f"`{text_col}` as text").dropna()
    for row in rows.toLocalIterator():
        data, offsets = K.buffers(pa.array([row.text], pa.string()))
        h = K.tokenize(data, offsets, K.ALNUM).hashes
        if not len(h):
            continue
        if held and words + len(h) > most:
            yield Block(held, window)
            held, words = [], 0
        held.append((row.id, h))
        words += len(h)
    if held:
        yield Block(held, window)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` (numbers of at least 0) in the order of their suffixes, exact to `depth` words."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.zeros(n + 1, np.int64)  # past the end: 0, as a divider
    rank[order] = np.repeat(starts := K.edges(text[order])[:-1], np.diff(np.append(starts, n))) + 1 if n else 0
    h = 1
    tied = np.flatnonzero(_tied(rank[order])) if n else np.zeros(0, np.int64)
    while h < depth and len(tied):
        at = order[tied]
        after = rank[np.minimum(at + h, n)]
        key = rank[at] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at  # `tied` rises, and groups lie one after another, so each group keeps its places
        first = K.edges(key)[:-1]
        rank[at] = np.repeat(tied[first], np.diff(np.append(first, len(key)))) + 1
        tied = tied[_tied(key)]
        h *= 2
    return order


def _tied(sorted_keys: np.ndarray) -> np.ndarray:
    same = sorted_keys[1:] == sorted_keys[:-1]
    out = np.zeros(len(sorted_keys), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _bound(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: int | np.ndarray, word: np.ndarray, right: bool) -> np.ndarray:
    """Per row, the first place in [lo, hi) of the suffix array whose word `at` is not below (right: is above) `word`."""
    lo, hi = lo.copy(), hi.copy()
    last = len(text) - 1
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) >> 1
        value = text[np.minimum(order[mid] + at, last)]
        down = value <= word[live] if right else value < word[live]
        lo[live] = np.where(down, mid + 1, lo[live])
        hi[live] = np.where(down, hi[live], mid)
    return lo


class Shard:
    """Slices of documents as one text of numbers, 0 dividing documents."""

    def __init__(self, tokens: K.Tokens, depth: int):
        n_docs = len(tokens.bounds) - 1
        self.vocabulary, ranks = np.unique(tokens.hashes, return_inverse=True)
        docs = tokens.docs()
        self.text = np.zeros(len(ranks) + n_docs + 1, np.int64)
        self.text[np.arange(len(ranks)) + docs] = ranks + 1
        self.doc_at = tokens.bounds[:-1] + np.arange(n_docs)  # where each document starts in text
        self.order = suffix_array(self.text, depth)

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur, and their ranges in the suffix array."""
        live = np.arange(len(block.first))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.text))
        start, size = block.start[block.first], block.size[block.first]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while len(live):
            live, lo, hi = self._narrow(block, live, start[live] + at, lo, hi, at)
            at += 1
            whole = size[live] == at
            done.append((live[whole], lo[whole], hi[whole]))
            live, lo, hi = live[~whole], lo[~whole], hi[~whole]
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (live, lo, hi)

    def _narrow(self, block: Block, live, place, lo, hi, at):
        words = block.text[place]
        number = np.minimum(np.searchsorted(self.vocabulary, words), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[number] == words if len(self.vocabulary) else np.zeros(len(words), bool)
        live, lo, hi, number = live[known], lo[known], hi[known], number[known] + 1
        low = _bound(self.text, self.order, lo, hi, at, number, False)
        high = _bound(self.text, self.order, low, hi, at, number, True)
        kept = low < high
        return live[kept], low[kept], high[kept]

    def longest(self, block: Block, windows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix whose window occurs: suffix, words of its longest match, and its range."""
        count = block.window_at[windows + 1] - block.window_at[windows]
        live = block.by_window[_ranges(block.window_at[windows], count)]
        lo, hi = np.repeat(lo, count), np.repeat(hi, count)
        length, low, high = block.size.copy(), np.zeros(len(block.start), np.int64), np.zeros(len(block.start), np.int64)
        every = live
        low[live], high[live] = lo, hi
        while len(live):
            more = block.start[live] + length[live] < block.end[live]
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                break
            by = length[live]
            kept = [self._narrow(block, live[by == n], block.start[live[by == n]] + n, lo[by == n], hi[by == n], int(n)) for n in np.unique(by)]
            live, lo, hi = (np.concatenate(x) for x in zip(*kept))
            length[live] += 1
            low[live], high[live] = lo, hi
        return every, length[every], low[every], high[every]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... for count[i] numbers, for all i."""
    if not len(start):
        return np.zeros(0, np.int64)
    end = np.cumsum(count)
    return np.arange(end[-1]) - np.repeat(end - count, count) + np.repeat(start, count)


def matcher(block: Block, window: int):
    """From a string column: n_words, spans of hit words, items, and the longest match, per document."""
    depth = max(window, int((block.end - block.start).max()) if len(block.start) else 0)

    def match(texts):
        for a, b, data, offsets in K.slices(texts, 1 << 22):
            tokens = K.tokenize(data, offsets, K.ALNUM)
            spans: list = [[] for _ in range(b - a)]
            items: list = [[] for _ in range(b - a)]
            longest: list = [None] * (b - a)
            if len(tokens.hashes) and len(block.first):
                shard = Shard(tokens, depth)
                windows, lo, hi = shard.search(block)
                if len(windows):
                    _report(shard, block, windows, lo, hi, tokens, spans, items, longest)
            yield a, np.diff(tokens.bounds), spans, items, longest

    return match


def _report(shard: Shard, block: Block, windows, lo, hi, tokens, spans, items, longest) -> None:
    count = hi - lo
    place = shard.order[_ranges(lo, count)]
    size = np.repeat(block.size[block.first[windows]], count)
    which = np.repeat(windows, count)
    cover = np.bincount(place, minlength=len(shard.text) + 1) - np.bincount(place + size, minlength=len(shard.text) + 1)
    covered = np.concatenate(([False], np.cumsum(cover) > 0, [False]))
    turn = np.flatnonzero(covered[1:] != covered[:-1])
    for x, y in zip(turn[::2].tolist(), turn[1::2].tolist()):
        doc = int(np.searchsorted(shard.doc_at, x, "right")) - 1
        spans[doc].append((x - int(shard.doc_at[doc]), y - int(shard.doc_at[doc])))
    doc = np.searchsorted(shard.doc_at, place, "right") - 1
    pairs = np.unique(doc * len(block.first) + which)
    doc, which = pairs // len(block.first), pairs % len(block.first)
    share = block.window_at[which + 1] - block.window_at[which]
    owners = block.owner[block.by_window[_ranges(block.window_at[which], share)]]
    pairs = np.unique(np.repeat(doc, share) * len(block.names) + owners)
    for d, k in zip((pairs // len(block.names)).tolist(), (pairs % len(block.names)).tolist()):
        items[d].append(block.names[k])
    suffix, length, low, high = shard.longest(block, windows, lo, hi)
    place = shard.order[_ranges(low, high - low)]
    length, suffix = np.repeat(length, high - low), np.repeat(suffix, high - low)
    doc = np.searchsorted(shard.doc_at, place, "right") - 1
    best = np.lexsort((place, -length, doc))
    for j in best[K.edges(doc[best])[:-1]].tolist():
        d = int(doc[j])
        longest[d] = {"item": block.names[int(block.owner[suffix[j]])], "words": int(length[j]), "at": int(place[j] - shard.doc_at[d])}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


FOUND = T.StructType([
    T.StructField(WORDS, T.LongType()),
    T.StructField(SPANS, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField(ITEMS, T.ArrayType(T.StringType())),
    T.StructField(LONGEST, T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.LongType()), T.StructField("at", T.LongType())])),
])
_ARROW = [
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
    pa.list_(pa.string()),
    pa.struct([("item", pa.string()), ("words", pa.int64()), ("at", pa.int64())]),
]


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, list[str]]:
    """docs with n_words, the spans of hit words, the items found and the longest match; and the names of these four."""
    spark, own = docs.sparkSession, docs.columns
    names = K.free(own, *FOUND_AS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, FOUND.fields))])

    def step(held, first: bool):
        def run(batches):
            match = matcher(held.value, window)
            for batch in batches:
                texts = batch.column(own.index(text_col))
                for a, n_words, spans, items, longest in match(texts):
                    part = batch.slice(a, len(n_words))
                    if not first:
                        old = [part.column(len(own) + j).to_pylist() for j in (1, 2, 3)]
                        spans = [merge_spans([(x["start"], x["end"]) for x in o] + s) for o, s in zip(old[0], spans)]
                        items = [sorted({*o, *i}) for o, i in zip(old[1], items)]
                        longest = [max((x for x in (o, m) if x), key=lambda x: x["words"], default=None) for o, m in zip(old[2], longest)]
                    values = [n_words.tolist(), [[{"start": x, "end": y} for x, y in s] for s in spans], [sorted(set(i)) for i in items], longest]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *(pa.array(v, t) for v, t in zip(values, _ARROW))], names=[*own, *names])

        return run

    found, shared, scratch, number = docs, [], Scratch(spark, "decontaminate"), 0
    for block in blocks(benchmark, item_col, item_text, window, block_words):
        if len(shared) == AT_ONCE:
            found = scratch.write(found, f"pass-{number}")
            for held in shared:
                held.destroy()
            if number:
                scratch.drop(f"pass-{number - 1}")
            shared, number = [], number + 1
        shared.append(spark.sparkContext.broadcast(block))
        found = found.mapInArrow(step(shared[-1], found is docs), schema)
    if found is docs:
        found = docs.mapInArrow(step(spark.sparkContext.broadcast(Block([], window)), True), schema)
    return found, names


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items, contaminated, spans, longest."""
    found, (n_words, spans, items, longest) = find(docs, benchmark, **how)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col(f"`{id_col}`").alias("id"), F.col(n_words).alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.col(items).alias("items"), (hit > 0).alias("contaminated"), F.col(spans).alias("spans"), F.col(longest).alias("longest"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated documents, in docs' own columns."""
    found, (_, spans, _, _) = find(docs, benchmark, **how)
    return found.where(F.size(spans) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
