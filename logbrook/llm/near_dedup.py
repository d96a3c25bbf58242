"""MinHash near-dedup by chosen-path set similarity join.

A document's set is its distinct k-word shingles.  Equal sets are one class from the start, so exact
copies are never compared.  Each class has a signature of COORDINATES minwise values.  A tree starts
from all classes; a node picks one or two coordinates (1 / threshold on average, by a hash of the
node, so all its members agree) and its members branch by their minwise value there.  Similar sets
go on together often enough that a pair at the threshold meets in a tree with a fair chance; TREES
independent trees bring the chance of missing it to well under one in a thousand.

Members carry a label: what they are known to be joined to.  A node whose members share one label is
dropped, for there is nothing to find in it.  The first tree begins with every class as its own label;
its links give components, which are the labels of the other trees.  So a group of near copies costs
rows in one tree, and is a handful of labels in the others.

A node of at most LEAF members is compared exhaustively.  A larger node in which at most BLOCK members
are outside of its main label is put aside: these outsiders are compared with all of the node, in
blocks.  Any other large node is split by how similar its members are to its pivot: those like it form a
star and are compared with the pivot and within chunks of LEAF members, those unlike it branch on; in
the first tree at STAR, in the others members between STAR and CORE do both.  When all trees are done,
what was put aside, the stars and what is still large at the last level are compared once more: the
members outside the main label (of all links so far) with all of the node, however many they are:
blocks of signatures first, then the sets of what is alike.  So pairs that share a large node are never
missed by how its members fell into chunks.

Comparisons are made in two steps: signatures drop members that resemble nobody of another label in
their node, then links are confirmed on full shingle sets (64 bits a shingle), which are only computed
for the members that are left.  A node yields the links that join its components (at most one fewer
than it has members), never all pairs.  Links become components by hooking and pointer jumping.  Only
narrow rows, and the sets of documents that have a likely partner, are shuffled; nothing is collected.

Defined cases: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than k words is
one shingle; null and empty texts have no shingles, are linked with nothing and are their own
component; a null id is its own (null) component; rows that share an id are one document whose
links join; repeated rows share a component; a very long text is one row and its set is held whole by
one task; the pivot of a node is the member with the smallest hash, so reruns agree; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .scratch import dealt, few

SHINGLE, THRESHOLD = 5, 0.75
COORDINATES, TREES, LEAF, DEPTH = 64, 10, 64, 6
#: Signatures must agree this far before sets are compared: over four standard errors below the threshold.
LIKELY = 0.5
#: In a large node, members this like its pivot form a star, and those below CORE branch on.
STAR, CORE = 0.6, 0.9
#: Signatures that are compared with as many others at a time, and outsiders of a node that is put aside.
BLOCK = 1024
#: Outsiders that are compared with a block of members in one group.
OUTSIDERS = 256
#: Sets that are compared with one at a time, at least, by numbers instead of hashes.
MANY = 4
#: Rows with a signature, and rows with a set, of a task.
SIGNATURES, SETS = 100_000, 20_000
#: Ids that are broadcast to pick documents; more are joined by shuffling.
BROADCAST_IDS = 1_000_000

_RANDOM = np.random.default_rng(20_3)
_A = (_RANDOM.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | 1)[:, None]
_B = _RANDOM.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minwise values of a set, over the upper halves of its shingles."""
    high = (shingles >> K.U64(32)).astype(np.uint32)
    best = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 2048):
        x = _A * (high[at : at + 2048] ^ _B)
        x ^= x >> np.uint32(15)
        best = np.minimum(best, (x * np.uint32(0x2C1B3C6D)).min(axis=1))
    return best


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a set."""
    one, two = K.mix(shingles), K.mix(shingles ^ K.U64(0x5851F42D4C957F2D))
    return int(np.add.reduce(one).view(np.int64)), int(np.bitwise_xor.reduce(two).view(np.int64) ^ len(shingles))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column("text")):
                sets = K.shingle_sets(K.tokenize(data, offsets, K.NOT_SPACE), shingle)
                full = [len(s) > 0 for s in sets]
                d = [class_of(s) if f else (None, None) for s, f in zip(sets, full)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array([signature(s).tobytes() if f else None for s, f in zip(sets, full)], pa.binary())],
                    names=["id", "n_shingles", "d1", "d2", "sig"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, sig binary")


# ---- trees ---------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def branch(nodes: np.ndarray, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, child node): each node's chosen coordinates, each member's values there."""
    h = K.mix(nodes.view(K.U64))
    picks = [(h % K.U64(COORDINATES)).astype(np.int64)]
    second = ((h >> K.U64(8)) % K.U64(COORDINATES - 1)).astype(np.int64)
    second += second >= picks[0]
    also = (h >> K.U64(40)).astype(np.float64) / (1 << 24) < 1 / threshold - 1
    who = np.arange(len(nodes))
    members, children = [], []
    for pick, rows in ((picks[0], who), (second[also], who[also])):
        value = sigs[rows, pick].astype(K.U64)
        children.append(K.mix(K.mix(nodes[rows].view(K.U64) + K.U64(0x632BE59BD9B4E019)) ^ (value << K.U64(8)) ^ pick.astype(K.U64)))
        members.append(rows)
    return np.concatenate(members), np.concatenate(children).view(np.int64)


def _plant(threshold: float, trees: range):
    def run(batches):
        for batch in batches:
            sigs, ids, labels = _matrix(batch.column("sig")), batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for tree in trees:
                who, child = branch(np.full(len(ids), tree + 1, np.int64), sigs, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(ids[who]), pa.array(labels[who])], names=["node", "id", "label"])

    return run


def _grow(threshold: float, core: float):
    """Members of large nodes: star members (chunked) and the next level's members."""

    def run(batches):
        for batch in batches:
            node, ids, labels, chunks = (batch.column(c).to_numpy() for c in ("node", "id", "label", "chunks"))
            sigs, pivots = _matrix(batch.column("sig")), _matrix(batch.column("pivot_sig"))
            like = (sigs == pivots).mean(axis=1)
            star = np.flatnonzero(like >= STAR)
            on = np.flatnonzero(like < core)
            who, child = branch(node[on], sigs[on], threshold)
            who = on[who]
            chunk = (K.mix(ids[star].view(K.U64) ^ node[star].view(K.U64)) % chunks[star].astype(K.U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[star], child])), pa.array(np.concatenate([ids[star], ids[who]])), pa.array(np.concatenate([labels[star], labels[who]])), pa.array(np.concatenate([chunk, np.full(len(who), -1)]))],
                names=["node", "id", "label", "chunk"],
            )

    return run


_NODE = "node long, id long, label long"


def grow(classes: DataFrame, sigs: DataFrame, which: range, core: float, scratch, name: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over classes (id, sig, label): leaves (node, id, label) of 2 to LEAF members; stars (the same and chunk)
    with their pivots in each chunk; and what is left to the comparison of outsiders (node, id).  Nodes of one label are gone.

    `sigs` (id, sig) is a written table: each level reads it twice, while classes, which may be a join, is read once.
    """
    level = classes.mapInArrow(_plant(threshold, which), _NODE)
    leaves, stars, aside, total = [], [], [], 0
    for depth in range(DEPTH + 1):
        level = scratch.write(level, f"{name}-level-{depth}")
        rows = level.count()
        total += rows
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(F.xxhash64("id", "node").alias("h"), "id", "label")).alias("p")).where("lo < hi")
        sizes = scratch.write(few(sizes.select("node", "n", F.col("p.id").alias("pivot"), F.col("p.label").alias("pivot_label")), rows), f"{name}-sizes-{depth}")
        leaves.append(level.join(sizes.where(F.col("n") <= LEAF).select("node"), "node"))
        large = sizes.where(F.col("n") > LEAF)
        if not large.take(1):
            break
        members = scratch.write(few(level.join(large, "node"), rows), f"{name}-members-{depth}")
        if depth == DEPTH:  # what no depth tells apart
            aside.append(members.select("node", "id"))
            break
        main = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.sum("k").alias("n"), F.max("k").alias("k"))
        split = scratch.write(few(main.select("node", (F.col("n") - F.col("k") > BLOCK).alias("many")), rows), f"{name}-split-{depth}")
        aside.append(members.join(split.where("not many"), "node", "left_semi").select("node", "id"))
        chunks = F.ceil(F.col("n") / (LEAF // 2)).cast("long").alias("chunks")
        many = members.join(split.where("many"), "node", "left_semi").select("node", "id", "label", "pivot", chunks)
        many = many.join(sigs.withColumnsRenamed({"id": "pivot", "sig": "pivot_sig"}), "pivot").join(sigs, "id")
        grown = scratch.write(few(many.select("node", "id", "label", "chunks", "sig", "pivot_sig").mapInArrow(_grow(threshold, core), f"{_NODE}, chunk long"), rows), f"{name}-grown-{depth}")
        star = grown.where("chunk >= 0")
        used = star.select("node", "chunk").distinct().join(large.select("node", F.col("pivot").alias("id"), F.col("pivot_label").alias("label")), "node")
        stars.append(star.unionByName(used))
        level = grown.where("chunk < 0").select("node", "id", "label")
    leaf = scratch.write(few(_union(leaves), total), f"{name}-leaves")
    star = scratch.write(few(_union(stars or [leaf.where("false").withColumn("chunk", F.lit(0).cast("long"))]).distinct(), total), f"{name}-stars")
    left = scratch.write(few(_union(aside or [leaf.where("false").select("node", "id")]), total), f"{name}-aside")
    scratch.drop(*[f"{name}-{x}-{d}" for d in range(DEPTH + 1) for x in ("level", "sizes", "members", "split", "grown")])
    return leaf, star, left


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


# ---- comparing -----------------------------------------------------------------------------------


def _resembling(batches):
    """Members of leaves whose signature is like that of a member with another label, in groups (grp, id, label) that
    hang together by such likenesses.  A group is named by its members, so one that met in many trees is one group.
    """
    for table in K.groups(batches, "node"):
        node, ids, labels = (table.column(c).to_numpy() for c in ("node", "id", "label"))
        sigs = _matrix(table.column("sig"))
        grp = np.zeros(len(node), K.U64)
        keep = np.zeros(len(node), bool)
        at = K.edges(node)
        names = K.mix(ids.view(K.U64) ^ K.U64(0x3C79AC492BA7B653))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if y - x == 2:
                if (sigs[x] == sigs[x + 1]).mean() >= LIKELY:
                    keep[x:y] = True
                    grp[x:y] = np.add.reduce(names[x:y])
                continue
            part = np.arange(y - x)
            for lo in range(x, y):
                like = ((sigs[x:y] == sigs[lo]).mean(axis=1) >= LIKELY) & (labels[x:y] != labels[lo])
                if like.any():
                    keep[lo] = True
                    met = np.unique(part[like])
                    part[np.isin(part, met)] = part[lo - x]
            for k in np.unique(part[keep[x:y]]).tolist():
                mine = x + np.flatnonzero((part == k) & keep[x:y])
                grp[mine] = np.add.reduce(names[mine])
        yield pa.RecordBatch.from_arrays([pa.array(K.mix(grp[keep]).view(np.int64)), pa.array(ids[keep]), pa.array(labels[keep])], names=["grp", "id", "label"])


def shares(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of the threshold (in hundredths) or more."""
    least, most = sorted((len(a), len(b)))
    percent = round(100 * threshold)
    if 100 * least < percent * most:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (least + most - common)


def shares_many(one: np.ndarray, ends: np.ndarray, flat: np.ndarray, which: np.ndarray, flags: np.ndarray, threshold: float) -> np.ndarray:
    """shares() of one set with those of `which`, which are runs of `flat` that end at `ends`; shingles are numbers below len(flags)."""
    percent, starts = round(100 * threshold), np.concatenate(([0], ends[:-1]))[which]
    sizes = ends[which] - starts
    places = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    flags[one] = True
    common = np.add.reduceat(flags[flat[places]].astype(np.int64), np.cumsum(sizes) - sizes)
    flags[one] = False
    return 100 * common >= percent * (len(one) + sizes - common)


def _join(threshold: float):
    """Links that join the components of each group; `label` is what is known to be joined already."""

    def run(batches):
        for table in K.groups(batches, "grp"):
            group, ids, labels = (table.column(c).to_numpy() for c in ("grp", "id", "label"))
            sets = [np.frombuffer(x, K.U64) for x in table.column("shingles").to_pylist()]
            sigs = _matrix(table.column("sig"))
            out: list[tuple[int, int]] = []
            at = K.edges(group)
            for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
                _, comp = np.unique(labels[x:y], return_inverse=True)
                comp = comp.copy()
                sketch = sigs[x:y]
                ends, flat, flags = np.cumsum([len(s) for s in sets[x:y]]), None, None
                for i in range(y - x):
                    if (comp == comp[0]).all():
                        break
                    like = (sketch[i + 1 :] == sketch[i]).mean(axis=1)
                    met = np.flatnonzero((comp[i + 1 :] != comp[i]) & (like >= LIKELY)) + i + 1
                    if sure := len(met) >= MANY:
                        if flat is None:
                            names, flat = np.unique(np.concatenate(sets[x:y]), return_inverse=True)
                            flags = np.zeros(len(names), bool)
                        met = met[shares_many(flat[ends[i] - len(sets[x + i]) : ends[i]], ends, flat, met, flags, threshold)]
                    for j in met.tolist():
                        if comp[i] != comp[j] and (sure or shares(sets[x + i], sets[x + j], threshold)):
                            out.append((int(ids[x + i]), int(ids[x + j])))
                            comp[comp == comp[j]] = comp[i]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in K.slices(batch.column("text")):
                sets = K.shingle_sets(K.tokenize(data, offsets, K.NOT_SPACE), shingle)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    return run


def _wanted(docs: DataFrame, classes: DataFrame, ids: DataFrame, scratch, name: str, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, sig, shingles) of the given ids; their texts are read again rather than kept."""
    ids = scratch.write(few(ids.distinct(), ids.count()), f"wanted-{name}")
    small = ids.count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rows = rows.join(F.broadcast(ids) if small else ids, "id", "left_semi")
    sets = scratch.write(rows.mapInArrow(_sets(shingle), "id long, shingles binary"), f"sets-{name}")
    scratch.drop(f"wanted-{name}")
    return sets.join(classes.select("id", "sig"), "id")


def _links(groups: DataFrame, sets: DataFrame, threshold: float, scratch, name: str) -> DataFrame:
    """Links of groups (grp, id, label)."""
    groups = scratch.write(groups, f"groups-{name}")
    rows = groups.join(sets, "id").repartition(dealt(groups, SETS), "grp").sortWithinPartitions("grp", "id")
    out = scratch.write(few(rows.select("grp", "id", "label", "sig", "shingles").mapInArrow(_join(threshold), "a long, b long"), groups.count(), SETS // 2), f"links-{name}")
    scratch.drop(f"groups-{name}", f"sets-{name}")
    return out


def near_components(docs: DataFrame, scratch, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: id, n_shingles, component."""
    prints = scratch.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    n = prints.count()
    full = prints.where("n_shingles > 0 and id is not null")
    named = scratch.write(few(full.groupBy("d1", "d2").agg(F.min("id").alias("rep")), n), "named")
    same = (F.col("id") == F.col("rep")) & (F.col("x1") == F.col("d1")) & (F.col("x2") == F.col("d2"))
    reps = full.join(named.withColumnsRenamed({"d1": "x1", "d2": "x2"}), same, "left_semi")
    classes = scratch.write(few(reps.select("id", "sig"), n), "classes")

    links, known, left = None, None, []
    for name, which, core in (("one", range(1), STAR), ("rest", range(1, TREES), CORE)):
        labelled = classes.withColumn("label", F.col("id")) if known is None else classes.join(known, "id", "left").select("id", "sig", F.coalesce("component", "id").alias("label"))
        leaves, stars, aside = grow(labelled, classes.select("id", "sig"), which, core, scratch, name, threshold)
        rows = leaves.join(classes, "id").repartition(dealt(leaves, SIGNATURES), "node").sortWithinPartitions("node", "id")
        likely = rows.select("node", "id", "label", "sig").mapInArrow(_resembling, "grp long, id long, label long")
        likely = scratch.write(few(likely.distinct(), leaves.count()), f"{name}-likely")
        groups = likely.unionByName(stars.select(F.xxhash64("node", "chunk").alias("grp"), "id", "label"))
        sets = _wanted(docs, classes, groups.select("id"), scratch, name, id_col, text_col, shingle)
        found = _links(groups, sets, threshold, scratch, name)
        links = found if links is None else links.unionByName(found)
        if known is None or found.take(1):
            known = components(links, scratch, f"round-{name}")
        left += [aside, stars.select("node", "id")]
        scratch.drop(f"{name}-leaves", f"{name}-likely")
    alike = _outsiders(_union(left), known, classes, scratch)
    if alike is not None:
        sets = _wanted(docs, classes, alike.select("id"), scratch, "last", id_col, text_col, shingle)
        found = _links(alike, sets, threshold, scratch, "last")
        if found.take(1):
            known = components(links.unionByName(found), scratch, "round-last")
    found = scratch.write(few(named.join(known, F.col("rep") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component")), n), "found")
    scratch.drop("classes", "named", "one-stars", "one-aside", "rest-stars", "rest-aside", "links-one", "links-rest", "links-last")
    out = prints.select("id", "n_shingles", "d1", "d2").join(found, ["d1", "d2"], "left")
    return out.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component"))


def _alike(batches):
    """Of each block of outsiders and members: those with a likely partner of another label, OUTSIDERS outsiders to a group."""
    for table in K.groups(batches, "grp"):
        group, ids, labels = (table.column(c).to_numpy() for c in ("grp", "id", "label"))
        inside = table.column("inside").to_numpy().astype(bool)
        sigs = _matrix(table.column("sig"))
        out: list[tuple[int, np.ndarray]] = []
        at = K.edges(group)
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            rows, others = x + np.flatnonzero(~inside[x:y]), x + np.flatnonzero(inside[x:y])
            for i in range(0, len(rows), OUTSIDERS):
                a = rows[i : i + OUTSIDERS]
                like = np.stack([((sigs[others] == sigs[r]).mean(axis=1) >= LIKELY) & (labels[others] != labels[r]) for r in a])
                if like.any():
                    kept = np.concatenate([a[like.any(axis=1)], others[like.any(axis=0)]])
                    kept = kept[np.unique(ids[kept], return_index=True)[1]]
                    name = K.mix(group[x : x + 1].view(K.U64) ^ K.U64(i // OUTSIDERS + 1)).view(np.int64)[0]
                    out.append((int(name), kept))
        kept = np.concatenate([k for _, k in out]) if out else np.zeros(0, np.int64)
        names = np.repeat(np.array([n for n, _ in out], np.int64), [len(k) for _, k in out])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids[kept]), pa.array(labels[kept])], names=["grp", "id", "label"])


def _outsiders(crowds: DataFrame, known: DataFrame, classes: DataFrame, scratch) -> DataFrame | None:
    """Of large nodes (node, id): groups (grp, id, label) of members that the main component doesn't hold and members alike.

    Of two members with different labels at least one is outside, so all pairs that may add a link are met.
    Nodes of which the same component holds the greater part are one crowd, so that an outsider that met
    it in many trees is compared with it once.
    """
    labelled = crowds.distinct().join(known, "id", "left").select("node", "id", F.coalesce("component", "id").alias("label"))
    rows = crowds.count()
    labelled = scratch.write(few(labelled, rows), "crowd-labels")
    counts = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    nodes = counts.groupBy("node").agg(F.max(F.struct("n", "label")).alias("m"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("all")).where("labels > 1")
    crowd = F.when(2 * F.col("m.n") > F.col("all"), F.xxhash64("m.label", F.lit(3))).otherwise(F.col("node"))
    nodes = nodes.select("node", crowd.alias("crowd"), F.col("m.label").alias("main"))
    mixed = scratch.write(few(labelled.join(nodes, "node").select("crowd", "main", "id", "label").distinct(), rows), "mixed")
    if not mixed.take(1):
        return None
    blocks = lambda n: F.ceil(n / BLOCK).cast("long")
    sizes = mixed.groupBy("crowd").agg(blocks(F.count_if(F.col("label") != F.col("main"))).alias("o"), blocks(F.count(F.lit(1))).alias("c"))
    mixed = scratch.write(few(mixed.join(sizes, "crowd"), rows), "crowds")
    place = F.xxhash64("id", "crowd")
    one, two = F.pmod(place, F.col("o")), F.pmod(place, F.col("c"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = mixed.where("label <> main").select("crowd", "id", "label", one.alias("i"), each("c").alias("j"), F.lit(False).alias("inside"))
    members = mixed.select("crowd", "id", "label", each("o").alias("i"), two.alias("j"), F.lit(True).alias("inside"))
    both = scratch.write(outside.unionByName(members).select(F.xxhash64("crowd", "i", "j").alias("grp"), "id", "label", "inside"), "blocks")
    dealt_out = both.join(classes.select("id", "sig"), "id").repartition(dealt(both, SIGNATURES), "grp").sortWithinPartitions("grp", "id")
    alike = scratch.write(few(dealt_out.select("grp", "id", "label", "inside", "sig").mapInArrow(_alike, "grp long, id long, label long"), both.count()), "alike")
    scratch.drop("crowd-labels", "mixed", "crowds", "blocks")
    return alike
