"""Substring dedup by collinear chaining: fuzzy passages that repeat an earlier document.

Seeds are hashes of k words sampled by minimizers, so any `k + window - 1` words that two documents
share give both the same seed.  There are two kinds: short ones (SEED words), which live through small
changes, and long ones (half of `min_words`), of which any `min_words` equal words hold at least one,
and which stock phrases don't share.

Occurrences are sorted by (seed, id) over range partitions, so a seed of a third of all documents lies
in as many partitions as it fills.  An occurrence is joined to two earlier documents: the seed's anchor
(its smallest id) and its predecessor (the next smaller id).  So a seed costs two rows an occurrence
and never a pair of occurrences.  Where a seed goes on in the next partition, what joins its two parts
is found from one row a partition and end.

The matches of a document with an earlier one are merged into runs on a diagonal, and the runs are
chained in order in both texts: a run adds its words and pays for the words between it and the one
before.  With that cost (a sum over both gaps) the best predecessor is a prefix maximum, kept in a
Fenwick tree.  Chains of at least LEAST words are then aligned on the words themselves: runs word by
word, the gaps between them by longest common subsequence, both ends outwards as long as matches
outweigh misses; a chain whose words lie in the passage of a better one is left out.  Ends that are still open at the edge of the words at hand are aligned again with more
words, until none is open; so it doesn't matter which of a passage's seeds were joined to other
documents.  What has at least `min_words` words and `identity` matches is a passage.  Of passages that span the same words of
a document, the one with the most matches, then the smallest anchor, is returned.

Chaining is grouped by the later document, whose matches are bounded by its length.  The ranges of
words that chains ask for are gathered by document first; a text is read once and cut into all of them.
Only these words (32 bits each) are shuffled.  A range that many chains ask for is dealt over several
keys.

Defined cases: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; null, empty and short texts have
no passage; a null id takes no part; rows that share an id are one document and are not compared with
each other; of equal ids with several texts the words of each are tried; very long texts are read
whole, and cost memory in proportion to their length in one task at a time; of chains that score alike
the one that begins first is kept whole; repeated rows give the passages of one; empty tables give no
rows; repeats within one document are not reported; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import dealt

SEED, WINDOW = 6, 16
GAP_COST, NEAR = 0.25, 24
#: Words beyond a chain's ends that are looked at first, and how much further each time an end is open.
REACH, FURTHER, OPEN = 64, 8, 20
MIN_WORDS, IDENTITY = 50, 0.8
#: Words in seeds that a chain needs to be aligned.
LEAST = 12
#: Ranges (16 bytes each) that are broadcast with their ids; more meet the texts by shuffling.
BROADCAST_RANGES = 500_000
#: Rows of a task, and chains that may share a key.
TASK_ROWS, SHARED = 1_000_000, 2_000
#: Rows with words that are turned into Python objects at a time.
ROWS = 500


# ---- seeds ---------------------------------------------------------------------------------------


def minimizers(tokens: K.Tokens, k: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in it, seed) of the sampled k-word runs."""
    h = K.runs(tokens.hashes, k)
    docs = tokens.docs()
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), h
    inside = docs[: len(h)] == docs[k - 1 :]
    bits = K.U64(max(1, int(len(h)).bit_length()))
    order = ((h >> bits) << bits) | np.arange(len(h)).astype(K.U64)
    order[~inside] = K.U64(0xFFFFFFFFFFFFFFFF)
    low, span = order, 1
    while span < window:  # the least of `window` places from each place on, by doubling
        step = min(span, window - span)
        later = np.full(len(low), K.U64(0xFFFFFFFFFFFFFFFF))
        later[: max(0, len(low) - step)] = low[step:]
        low = np.minimum(low, later)
        span += step
    low = low[low != K.U64(0xFFFFFFFFFFFFFFFF)]
    at = np.unique((low & ((K.U64(1) << bits) - K.U64(1))).astype(np.int64))
    return docs[at], at - tokens.bounds[docs[at]], h[at]


def long_seed(min_words: int) -> int:
    return max(SEED, min_words // 2)


def seeds(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(seed, id, pos): pos is twice the place, and one more for a long seed."""
    k = long_seed(min_words)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a, b, data, offsets in K.slices(batch.column("text")):
                tokens = K.tokenize(data, offsets, K.NOT_SPACE)
                for kind, found in enumerate((minimizers(tokens), minimizers(tokens, k, max(1, min_words - k + 1)))):
                    doc, pos, seed = found
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(ids[a:b][doc]), pa.array((2 * pos + kind).astype(np.int32))], names=["seed", "id", "pos"])

    return docs.mapInArrow(run, "seed long, id long, pos int")


_MATCH = "id long, anchor long, pos int, apos int, edge int, seed long"
_MATCH_NAMES = [x.split()[0] for x in _MATCH.split(", ")]


def _links(batches):
    """Of rows sorted by (seed, id, pos): matches with the seed's first id here and with the id before.

    Rows with `edge` tell of the first (0, 1) and the last (2, 3) seed of the partition: its first and
    its last document.  In them `anchor` is the partition.
    """
    part = TaskContext.get().partitionId()
    ends: list[list[tuple]] = []
    for table in K.groups(batches, "seed"):
        seed, ids, pos = (table.column(c).to_numpy() for c in ("seed", "id", "pos"))
        new_seed = np.ones(len(seed), bool)
        new_seed[1:] = seed[1:] != seed[:-1]
        new_id = new_seed.copy()
        new_id[1:] |= ids[1:] != ids[:-1]
        rows = np.arange(len(seed))
        heads = np.flatnonzero(new_id)  # the first place of each document
        which = np.cumsum(new_id) - 1
        before = heads[np.maximum(which - 1, 0)]
        first = np.maximum.accumulate(np.where(new_seed, rows, 0))
        later = np.flatnonzero(ids != ids[first])
        other = later[before[later] != first[later]]
        a, p = np.concatenate([later, other]), np.concatenate([first[later], before[other]])
        none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[p]), pa.array(pos[a]), pa.array(pos[p]), *none], names=_MATCH_NAMES)
        begin = np.flatnonzero(new_seed)
        for x, y in ((begin[0], np.append(begin, len(seed))[1]), (begin[-1], len(seed))):
            tail = heads[which[y - 1]]
            ends.append([(int(ids[x]), int(pos[x]), int(seed[x])), (int(ids[tail]), int(pos[tail]), int(seed[x]))])
    if ends:
        told = [*ends[0], *ends[-1]]
        columns = [[t[0] for t in told], [part] * 4, [t[1] for t in told], [0] * 4, [0, 1, 2, 3], [t[2] for t in told]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=_MATCH_NAMES)


def across(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Matches of each partition's first document with the parts of its seed in earlier partitions.

    rows: (partition, edge, seed, id, pos), four a partition.
    """
    out, told = [], {}
    for part, edge, seed, id_, pos in rows:
        told.setdefault(part, {})[edge] = (seed, id_, pos)
    head: tuple | None = None  # of the last seed so far: its first document
    tail: tuple | None = None
    for part in sorted(told):
        mine = told[part]
        if tail is not None and mine[0][0] == tail[0]:
            for other in {head, tail}:
                if other[1] != mine[0][1]:
                    out.append((mine[0][1], other[1], mine[0][2], other[2]))
        if tail is None or mine[2][0] != tail[0]:
            head = mine[2]
        tail = mine[3]
    return out


def matches(found: DataFrame, scratch) -> DataFrame:
    """(id, anchor, pos, apos) of every occurrence with its seed's smallest id and with the next smaller one."""
    spark = found.sparkSession
    rows = dealt(found, TASK_ROWS)
    ordered = found.repartitionByRange(rows, "seed", "id", "pos").sortWithinPartitions("seed", "id", "pos")
    linked = scratch.write(ordered.mapInArrow(_links, _MATCH), "matches")
    ends = linked.where("edge is not null").select("anchor", "edge", "seed", "id", "pos").collect()  # four rows a partition
    plain = linked.where("edge is null").select("id", "anchor", "pos", "apos")
    return plain.unionByName(spark.createDataFrame(across([tuple(r) for r in ends]), "id long, anchor long, pos int, apos int"))


# ---- chaining ------------------------------------------------------------------------------------


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def raise_to(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        """The best of the places 0 .. at."""
        out = (float("-inf"), -1)
        at += 1
        while at > 0:
            if self.best[at] > out:
                out = self.best[at]
            at -= at & -at
        return out


def chain(runs: list[tuple[int, int, int, int]], cost: float = GAP_COST) -> list[list[int]]:
    """Chains of runs (start, last, anchor start, weight), best first; each run is in one chain.

    `start` and `last` are first and last seed places; a run lies on one diagonal.
    """
    n = len(runs)
    ends = sorted({a + last - s for s, last, a, _ in runs})
    place = {e: i for i, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, before = [0.0] * n, [-1] * n
    starts = sorted(range(n), key=lambda j: (runs[j][0], runs[j][2]))
    closing = sorted(range(n), key=lambda j: runs[j][1])
    done = 0
    for j in starts:
        s, last, a, weight = runs[j]
        while done < n and runs[closing[done]][1] < s:
            i = closing[done]
            aend = runs[i][2] + runs[i][1] - runs[i][0]
            tree.raise_to(place[aend], (score[i] + cost * (runs[i][1] + aend), i))
            done += 1
        score[j] = float(weight)
        low = bisect_left(ends, a) - 1
        if low >= 0:
            value, i = tree.upto(low)
            if i >= 0 and value - cost * (s + a) > 0:
                score[j], before[j] = weight + value - cost * (s + a), i
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda x: -score[x]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        if path:
            out.append(path[::-1])
    return out


def _chains(min_words: int):
    """Chains of at least LEAST words in seeds, with the words around that are looked at first."""
    k = long_seed(min_words)

    def run(batches):
        for table in K.groups(batches, "id"):
            ids, anchors, pos, apos = (table.column(c).to_numpy().astype(np.int64) for c in ("id", "anchor", "pos", "apos"))
            whole, pos, apos = (pos & 1) == 1, pos >> 1, apos >> 1
            steps = [0, *range(NEAR // 2, k - SEED, NEAR // 2), k - SEED]  # a long seed is short ones on its diagonal
            ids, anchors = (np.concatenate([x[~whole], *[x[whole]] * len(steps)]) for x in (ids, anchors))
            pos, apos = (np.concatenate([x[~whole], *[x[whole] + n for n in steps]]) for x in (pos, apos))
            diag = apos - pos
            order = np.lexsort((pos, diag, anchors, ids))
            ids, anchors, pos, apos, diag = (x[order] for x in (ids, anchors, pos, apos, diag))
            pair = np.ones(len(ids), bool)
            pair[1:] = (ids[1:] != ids[:-1]) | (anchors[1:] != anchors[:-1])
            new = pair.copy()
            new[1:] |= (diag[1:] != diag[:-1]) | (pos[1:] - pos[:-1] > NEAR)
            at = np.append(np.flatnonzero(new), len(ids))
            first, last = at[:-1], at[1:] - 1
            weight = pos[last] - pos[first] + SEED
            at = np.append(np.flatnonzero(pair[first]), len(first))
            enough = np.add.reduceat(weight, at[:-1]) >= LEAST
            rows = []
            for x, y in zip(at[:-1][enough].tolist(), at[1:][enough].tolist()):
                f = first[x:y]
                runs = list(zip(pos[f].tolist(), pos[last[x:y]].tolist(), apos[f].tolist(), weight[x:y].tolist()))
                kept = []
                for path in chain(runs) if y - x > 1 else [[0]]:
                    if (words := sum(runs[j][3] for j in path)) >= LEAST:
                        kept.append((words, [(runs[j][0], runs[j][1] + SEED, runs[j][2]) for j in path]))
                rows += clusters(int(ids[f[0]]), int(anchors[f[0]]), kept, REACH)
            yield _packed(rows)

    return run


def clusters(id_: int, anchor: int, chains: list[tuple[int, list[tuple[int, int, int]]]], reach: int) -> list[tuple]:
    """Chains (words, runs) of a pair, put together where their windows overlap in both texts."""
    held: list[list] = []
    for words, path in sorted(chains, key=lambda c: c[1][0]):
        d = window(path[0][0], path[-1][1], reach)
        a = window(path[0][2], path[-1][2] + path[-1][1] - path[-1][0], reach)
        for h in held[-4:]:
            if d[0] <= h[1] and a[0] <= h[3] and h[2] <= a[1]:
                h[1], h[2], h[3] = max(h[1], d[1]), min(h[2], a[0]), max(h[3], a[1])
                h[4].append((words, path))
                break
        else:
            held.append([*d, *a, [(words, path)]])
    out = []
    for d_from, d_to, a_from, a_to, members in held:
        members.sort(key=lambda c: (-c[0], c[1][0]))
        flat = np.array([(k, words, *run) for k, (words, path) in enumerate(members) for run in path], np.int64)
        out.append((id_, anchor, d_from, d_to, a_from, a_to, flat.tobytes()))
    return out


def window(start: int, end: int, reach: int) -> tuple[int, int]:
    """start and end with `reach` words around, on a grid, so that windows of many chains are the same."""
    return max(0, (start - reach) // REACH * REACH), -(-(end + reach) // REACH) * REACH


_CHAIN = "id long, anchor long, d_from long, d_to long, a_from long, a_to long, runs binary"
_CHAIN_NAMES = [x.split()[0] for x in _CHAIN.split(", ")]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 6 + [pa.binary()])], names=_CHAIN_NAMES)


# ---- aligning ------------------------------------------------------------------------------------


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def extend(same: np.ndarray) -> tuple[int, int, bool]:
    """How far matches outweigh misses (each costs two): words, matches, and whether more words might add to it."""
    if not len(same):
        return 0, 0, True
    total = np.cumsum(np.where(same, 1, -2))
    best = int(np.argmax(total))
    still = bool(total[-1] > max(0, total[best]) - OPEN)
    return (best + 1, int(same[: best + 1].sum()), still) if total[best] > 0 else (0, 0, still)


def align(dw: np.ndarray, aw: np.ndarray, runs: np.ndarray) -> tuple[int, int, int, int, int, bool, bool]:
    """(start, end, anchor start, anchor end, matches, open before, open after) for runs (start, end, anchor start) within both word lists."""
    hits = 0
    s0, _, a0 = (int(x) for x in runs[0])
    back = min(s0, a0)
    grow, gained, before = extend(dw[s0 - back : s0][::-1] == aw[a0 - back : a0][::-1])
    start, astart = s0 - grow, a0 - grow
    hits += gained
    pd, pa_ = s0, a0
    for s, e, a in runs.tolist():
        skip = max(0, pd - s, pa_ - a)
        s, a = s + skip, a + skip
        if s >= e:
            continue
        hits += common(dw[pd:s], aw[pa_:a])
        n = min(e - s, len(dw) - s, len(aw) - a)
        hits += int((dw[s : s + n] == aw[a : a + n]).sum())
        pd, pa_ = s + n, a + n
    n = min(len(dw) - pd, len(aw) - pa_)
    grow, gained, after = extend(dw[pd : pd + n] == aw[pa_ : pa_ + n])
    return start, pd + grow, astart, pa_ + grow, hits + gained, before, after


def _cut(batches):
    """The words of every range (from, to) of a text."""
    for batch in batches:
        ids, ranges = batch.column("id").to_pylist(), batch.column("ranges")
        for a, b, data, offsets in K.slices(batch.column("text")):
            tokens = K.tokenize(data, offsets, K.NOT_SPACE)
            words = (tokens.hashes >> K.U64(32)).astype(np.uint32)
            rows = []
            for j in range(a, b):
                own = words[tokens.bounds[j - a] : tokens.bounds[j - a + 1]]
                rows += [(ids[j], r["from"], r["to"], own[r["from"] : r["to"]].tobytes()) for r in ranges[j].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "from", "to", "words"])


_FOUND = "id long, anchor long, start long, end long, anchor_start long, anchor_end long, matches long"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _aligned(min_words: int, identity: float, reach: int):
    """Passages; and chains with an open end, with the wider windows that they need."""

    def run(batches):
        names = [*_CHAIN_NAMES, "d_words", "a_words"]
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            done, again = [], []
            for i, anchor, d_from, d_to, a_from, a_to, runs, dw, aw in zip(*(batch.column(c).to_pylist() for c in names)):
                dw, aw = np.frombuffer(dw, np.uint32), np.frombuffer(aw, np.uint32)
                flat = np.frombuffer(runs, np.int64).reshape(-1, 5)
                at = K.edges(flat[:, 0])
                covered: list[tuple[int, int]] = []
                wider = []
                for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = flat[x:y, 2:]
                    first, last = int(own[0][0]) - d_from, int(own[-1][1]) - d_from
                    if any(s <= first and last <= e for s, e in covered):
                        continue  # a better chain has taken these words
                    if last > len(dw) or own[-1][2] - a_from + own[-1][1] - own[-1][0] > len(aw):
                        continue  # another text of the same id
                    s, e, a, b, hits, before, after = align(dw, aw, own - np.array([d_from, d_from, a_from]))
                    if hits < identity * max(e - s, b - a):
                        continue
                    covered.append((s, e))
                    if (before and d_from > 0 and a_from > 0) or (after and len(dw) == d_to - d_from and len(aw) == a_to - a_from):
                        wider.append((int(flat[x][1]), [tuple(r) for r in own.tolist()]))
                    elif e - s >= min_words:
                        done.append((i, anchor, s + d_from, e + d_from, a + a_from, b + a_from, hits))
                again += clusters(i, anchor, wider, reach)
            columns = list(zip(*done)) if done else [[]] * 7
            found = [*(pa.array(c, pa.int64()) for c in columns), pa.nulls(len(done), pa.struct([(n, c.type) for n, c in zip(_CHAIN_NAMES, _packed([]).columns)]))]
            chains = _packed(again)
            held = pa.StructArray.from_arrays(chains.columns, names=_CHAIN_NAMES)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c, pa.nulls(len(again), pa.int64())]) for c in found[:7]] + [pa.concat_arrays([found[7], held])], names=[*_FOUND_NAMES, "chain"])

    return run


def _words(rows: DataFrame, chains: DataFrame, scratch, name: str) -> DataFrame:
    """(id, from, to, words) of all ranges that chains ask for."""
    late = chains.select("id", F.col("d_from").alias("from"), F.col("d_to").alias("to"))
    early = chains.select(F.col("anchor").alias("id"), F.col("a_from").alias("from"), F.col("a_to").alias("to"))
    asked = late.unionByName(early).distinct().groupBy("id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    asked = scratch.write(asked, f"asked-{name}")
    few = (asked.agg(F.sum(F.size("ranges"))).first()[0] or 0) <= BROADCAST_RANGES
    texts = rows.join(F.broadcast(asked) if few else asked, "id")
    return scratch.write(texts.select("id", "text", "ranges").mapInArrow(_cut, "id long, from long, to long, words binary").distinct(), f"words-{name}")


def passages(docs: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """(id, anchor, start, end, anchor_start, anchor_end, matches), in words; anchor is an earlier (smaller) id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    found = scratch.write(seeds(rows, min_words), "seeds")
    near = matches(found, scratch)
    near = near.repartition(dealt(near, TASK_ROWS), "id").sortWithinPartitions("id")
    chains = scratch.write(near.mapInArrow(_chains(min_words), _CHAIN), "chains-0")
    scratch.drop("seeds", "matches")
    out, number, reach = None, 0, REACH
    while chains.take(1):
        reach *= FURTHER
        words = _words(rows, chains, scratch, str(number))
        hot = scratch.write(chains.groupBy("anchor", "a_from", "a_to").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _bound(chains)), f"hot-{number}")
        hot = F.broadcast(hot.select("anchor", "a_from", "a_to", F.ceil(F.col("n") / SHARED).cast("long").alias("keys")))  # at most 10,000 rows, see _bound
        asked = chains.join(hot, ["anchor", "a_from", "a_to"], "left").withColumn("salt", F.when(F.col("keys") > 1, F.pmod(F.xxhash64("id", "d_from"), "keys")).otherwise(0))
        early = words.select(F.col("id").alias("anchor"), F.col("from").alias("a_from"), F.col("to").alias("a_to"), F.col("words").alias("a_words"))
        early = early.join(hot, ["anchor", "a_from", "a_to"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("keys") - 1, F.lit(0))))).drop("keys")
        late = words.select("id", F.col("from").alias("d_from"), F.col("to").alias("d_to"), F.col("words").alias("d_words"))
        both = asked.drop("keys").join(early, ["anchor", "a_from", "a_to", "salt"]).join(late, ["id", "d_from", "d_to"])
        schema = f"{_FOUND}, chain struct<{', '.join(x.replace(' ', ':') for x in _CHAIN.split(', '))}>"
        judged = scratch.write(both.select(*_CHAIN_NAMES, "d_words", "a_words").mapInArrow(_aligned(min_words, identity, reach), schema), f"judged-{number}")
        ready = judged.where("chain is null").select(*_FOUND_NAMES)
        out = ready if out is None else out.unionByName(ready)
        scratch.drop(f"words-{number}", f"asked-{number}", f"hot-{number}", f"chains-{number}")
        number += 1
        chains = scratch.write(judged.where("chain is not null").select("chain.*"), f"chains-{number}")
    if out is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    best = out.groupBy("id", "start", "end").agg(F.min(F.struct((-F.col("matches")).alias("fewer"), "anchor", "anchor_start", "anchor_end")).alias("b"))
    return best.select("id", "b.anchor", "start", "end", "b.anchor_start", "b.anchor_end", (-F.col("b.fewer")).alias("matches"))


def _bound(chains: DataFrame) -> int:
    """Chains of one range from which on it is hot; so at most 10,000 ranges are."""
    return max(SHARED, chains.count() // 10_000)
