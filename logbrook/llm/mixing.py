"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `share` times
all words; a target stops at `most` times its source's words and the excess goes to the others by
weight, until none is above.  That is a water level t with target = min(weight * t, most * size): it
is bracketed by passes that sum the small table of sources at a grid of levels, then solved exactly.
No pass gathers sources in one task.

Sample: a document's expected copies are least(most, rate * size): in proportion to its words, so that
long documents are likelier, and never above `most`.  A source's rate is the one at which the expected
words are its target; it is found on the counts of each size, which are combined map-side.  Whole copies
are certain; what is left, l, is the document's inclusion probability.  Order sampling ranks documents
by random odds u / (1 - u) divided by inclusion odds l / (1 - l) and takes them from the lowest until
their words come nearest the words that are missing, which is the sum of l * size (a size that is fixed
in words).  The random odds are a hash of the id, so reruns agree.

The rank's cut is found without sorting a source: words are summed by bucket of the rank
(combined map-side), the cut's bucket is found on these sums, and only rows in that bucket are
ordered.  The cut of a source is then one row, and taking it is a comparison in a projection, so a
source that holds a third of all rows is never gathered, and texts are not shuffled.

Defined cases: null text has size 0; documents of size 0 are never short of words, and take 0; a
null source is a source of its own; a source without words has target 0; a very long text is one
document like any other and is taken at most `most` times; equal ranks are taken by id, then size;
repeated rows are taken or left together; an empty table gives no rows; columns besides id, source and
text are ignored by `mix`; `mixed_rows` keeps all columns and adds `copy` (`copy_1` and so on where
there is one by that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WEIGHTS = (3, 1, 2)
_LOWEST = -(1 << 63)
#: Sources whose level is solved in memory; more are solved by passes over their table.
DRIVER_ROWS = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def _odds(id_: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(id_, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return u / (F.lit(1.0) - u)


def _rank(odds: Column, chance: Column) -> Column:
    """In (0, 1), rising with random odds over inclusion odds."""
    x = odds * (F.lit(1.0) - chance) / F.greatest(chance, F.lit(1e-12))
    return x / (F.lit(1.0) + x)


def _level(rows: list[tuple[float, float, float]], total: float) -> float:
    """The same from (cap / weight, weight, cap) in memory."""
    weight = sum(w for _, w, _ in rows)
    for edge, w, cap in sorted(rows):
        if edge * weight >= total:
            return total / weight
        total, weight = total - cap, weight - w
    return float("inf")


def water_level(sources: DataFrame, total: float) -> float:
    """t with sum(least(weight * t, cap)) = total, for rows (weight, cap); inf when every cap is reached."""
    if sources.count() <= DRIVER_ROWS:
        return _level([(r.cap / r.weight, r.weight, r.cap) for r in sources.select("weight", "cap").collect()], total)
    edge = F.col("cap") / F.col("weight")
    low, high, caps = 0.0, *sources.agg(F.max(edge), F.sum("cap")).first()
    if high is None or total >= caps:
        return float("inf")
    while True:
        inner = sources.where((edge > low) & (edge < high)).agg(F.min(edge), F.max(edge)).first()
        if inner[0] is None:
            break
        grid = sorted({low + (high - low) * j / 32 for j in range(33)} | {inner[0], inner[1]})
        sums = sources.agg(*[F.sum(F.least(F.col("weight") * t, F.col("cap"))) for t in grid]).first()
        at = max(j for j, s in enumerate(sums) if s <= total or j == 0)
        if at + 1 >= len(grid) or (grid[at], grid[at + 1]) == (low, high):
            break
        low, high = grid[at], grid[at + 1]
    capped, weight = sources.agg(F.sum(F.when(edge <= low, F.col("cap")).otherwise(0.0)), F.sum(F.when(edge > low, F.col("weight")).otherwise(0))).first()
    return (total - capped) / weight if weight else float("inf")


def targets(rows: DataFrame, scratch, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source of rows (source, size): key, source, source_size, target."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ordered = scratch.write(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("mid", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("mid", 33)
    offsets, before = [], 0
    for row in sorted(ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k")).collect()):  # a row per partition
        offsets.append((row.part, before))
        before += row.k
    spark = rows.sparkSession
    place = spark.createDataFrame(offsets, "part long, before long")
    numbered = ordered.withColumn("part", part).join(place, "part").withColumn("rank", F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    weighed = numbered.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(most)})
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(weighed.where("cap > 0"), share * total)
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level)) if level != float("inf") else F.col("cap")
    return weighed.select(_key(F.col("source")).alias("key"), "source_size", "n", F.when(F.col("cap") > 0, target).otherwise(0.0).alias("target"))


def rates(rows: DataFrame, aims: DataFrame, most: float) -> DataFrame:
    """Per source (key) with a target: the rate at which sum(size * least(most, rate * size)) is its target.

    Of the sizes of a source, the largest that is not held back by `most` at its own rate gives the rate.
    """
    sizes = rows.where("size > 0").groupBy(_key(F.col("source")).alias("key"), "size").agg(F.count(F.lit(1)).cast("double").alias("k"))
    upto = W.partitionBy("key").orderBy("size")
    longer = W.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    words_ = F.col("k") * F.col("size")
    sums = sizes.withColumns({"above": F.coalesce(F.sum(words_).over(longer), F.lit(0.0)), "squares": F.sum(words_ * F.col("size")).over(upto)})
    tried = sums.join(aims.where("target > 0").select("key", "target"), "key").withColumn("rate", (F.col("target") - F.lit(most) * F.col("above")) / F.col("squares"))
    fits = F.col("rate") * F.col("size") <= most * (1 + 1e-9)
    return tried.groupBy("key").agg(F.max_by("rate", F.when(fits, F.col("size"))).alias("rate"))


def _share(size: Column, most: float) -> tuple[Column, Column]:
    """Whole copies and inclusion probability of a document that was joined to its source's rate."""
    copies_ = F.least(F.lit(float(most)), F.greatest(F.coalesce(F.col("rate"), F.lit(0.0)), F.lit(0.0)) * size)
    whole = F.floor(copies_ + 1e-9)
    chance = copies_ - whole
    return whole.cast("long"), F.when(chance > 1e-9, chance).otherwise(0.0)


def cuts(rows: DataFrame, scratch, share: float = 1.5, most: float = 2.0, seed: int = 8) -> DataFrame:
    """Per source: source_size, target, rate, and the last place taken (q, cut_id, cut_size).

    rows: id, source, size.
    """
    aims = scratch.write(targets(rows, scratch, share, most), "targets")
    aims = scratch.write(aims.join(rates(rows, aims, most), "key", "left"), "aims")
    n_rows = aims.agg(F.sum("n")).first()[0] or 0
    buckets = min(1 << 16, max(16, n_rows // 1000))
    whole, chance = _share(F.col("size"), most)
    placed = rows.select(F.col("id"), "size", _key(F.col("source")).alias("key")).join(aims.where("rate > 0").select("key", "rate", "target"), "key").where("size > 0")
    placed = placed.withColumns({"whole": whole, "chance": chance})
    certain = placed.groupBy("key").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("missing"))
    certain = scratch.write(certain, "missing")
    placed = placed.where("chance > 0").join(certain.where("missing > 0"), "key")
    placed = placed.withColumn("q", _rank(_odds(F.col("id"), seed), F.col("chance")))
    placed = placed.withColumn("bucket", F.floor(F.col("q") * buckets).cast("int"))
    sums = placed.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    upto = sums.withColumn("end", F.sum("words").over(W.partitionBy("key").orderBy("bucket")))
    crossing = upto.where("end > missing").groupBy("key").agg(F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("base"))).alias("x"))
    crossing = crossing.select("key", F.col("x.bucket").alias("bucket"), F.col("x.base").alias("base"))
    order = W.partitionBy("key").orderBy("q", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    near = placed.join(crossing, ["key", "bucket"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    inside = near.where(F.col("before") + F.col("size") / 2 <= F.col("missing")).groupBy("key").agg(F.max(F.struct("q", "id", "size")).alias("last"))
    cut = crossing.join(inside, "key", "left").select(
        "key",
        F.coalesce(F.col("last.q"), F.col("bucket") / F.lit(float(buckets))).alias("q"),
        F.coalesce(F.col("last.id"), F.lit(_LOWEST)).alias("cut_id"),
        F.coalesce(F.col("last.size"), F.lit(-1)).alias("cut_size"),
    )
    every = F.when(F.col("missing") > 0, 2.0).otherwise(-1.0)  # without a crossing bucket: all, if words are missing
    out = aims.join(certain, "key", "left").join(cut, "key", "left").select(
        "key", "source_size", "target", "rate", F.coalesce("q", every).alias("q"),
        F.coalesce("cut_id", F.lit(_LOWEST)).alias("cut_id"), F.coalesce("cut_size", F.lit(-1)).alias("cut_size"),
    )
    return scratch.write(out, "cuts")


def copies(id_: Column, size: Column, most: float = 2.0, seed: int = 8) -> Column:
    """How often a row that was joined to its source's cut is in the mix."""
    whole, chance = _share(size, most)
    place = F.struct(_rank(_odds(id_, seed), chance).alias("q"), id_.alias("i"), size.alias("s"))
    last = F.struct(F.col("q").alias("q"), F.col("cut_id").alias("i"), F.col("cut_size").alias("s"))
    return F.when(size > 0, whole + F.when(chance > 0, (place <= last).cast("long")).otherwise(0)).otherwise(0)


def mix(df: DataFrame, scratch, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, most: float = 2.0, seed: int = 8) -> DataFrame:
    """Per row of df: id, size, source_size, target, copies, taken."""
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    rows = scratch.write(df.select(id_.alias("id"), F.col(id_col).alias("doc"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "rows")
    found = cuts(rows, scratch, share, most, seed)
    joined = rows.withColumn("key", _key(F.col("source"))).join(found, "key")
    out = joined.withColumn("copies", copies(F.col("id"), F.col("size"), most, seed))
    return out.select(F.col("doc").alias("id"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, scratch, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mix itself: df's rows, each as often as it is taken, numbered from 1 in `copy`, or the next free name."""
    own = df.columns
    name = next(n for n in ("copy", *(f"copy_{k}" for k in range(1, len(own) + 2))) if n not in own)
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST))
    rows = scratch.write(df.select(id_.alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "rows")
    found = cuts(rows, scratch, **how)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), id_.alias("id"), words(F.col(text_col)).alias("size"), _key(F.col(source_col)).alias("key"))
    taken = packed.join(found, "key").withColumn("n", copies(F.col("id"), F.col("size"), how.get("most", 2.0), how.get("seed", 8))).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy_number")).select(*[F.col(f"row.`{c}`") for c in own], F.col("copy_number").alias(name))
