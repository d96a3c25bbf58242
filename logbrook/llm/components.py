"""Connected components of a link table by hooking and pointer jumping, all in DataFrames.

Each round hooks every node to its smallest neighbour, jumps pointers until they rest, and contracts
the links; the nodes shrink at least by half a round.  Once at most ONE_TASK links are left, one task
does the same in memory.  Every table is written to the shared folder, so lineage stays short and a lost
executor costs only its tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links that one task joins; with more, rounds over all tasks come first.
ONE_TASK = 1_000_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the smallest node that each can reach."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = np.arange(len(ids))
    x, y = place[: len(a)], place[len(a) :]
    while True:
        x, y = up[x], up[y]
        live = x != y
        if not live.any():
            return ids, ids[up]
        x, y = np.minimum(x[live], y[live]), np.maximum(x[live], y[live])
        np.minimum.at(up, y, x)
        while not np.array_equal(above := up[up], up):
            up = above


def _together(batches):
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
    ids, least = smallest(np.concatenate(a), np.concatenate(b))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least, pa.int64())], names=["id", "p"])


def components(links: DataFrame, scratch, name: str = "components") -> DataFrame:
    """(id, component) for the ids in links (a, b); the component is its smallest id."""
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    if ordered.count() <= ONE_TASK:
        alone = scratch.write(ordered.coalesce(1).mapInArrow(_together, "id long, p long"), f"{name}-labels-0")
        return alone.select("id", F.col("p").alias("component"))
    edges = scratch.write(ordered.distinct(), f"{name}-edges-0")
    spent = [f"{name}-edges-0"]
    labels: DataFrame | None = None
    k = 0
    while left := edges.count():
        if left <= ONE_TASK and labels is not None:
            up = scratch.write(edges.coalesce(1).mapInArrow(_together, "id long, p long"), f"{name}-up").withColumnRenamed("id", "i")
            spent += [f"{name}-up"]
            k += 1
            labels = scratch.write(labels.join(up, F.col("component") == F.col("i"), "left").select("id", F.coalesce("p", "component").alias("component")), f"{name}-labels-{k}")
            spent.append(f"{name}-labels-{k}")
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = scratch.write(both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("id"), F.least("a", "p").alias("p")), f"{name}-parents-{k}-0")
        spent.append(f"{name}-parents-{k}-0")
        jump = 0
        while True:
            jump += 1
            up = parents.select(F.col("id").alias("i"), F.col("p").alias("q"))
            moved = scratch.write(parents.join(up, F.col("p") == F.col("i")).select("id", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), f"{name}-parents-{k}-{jump}")
            spent.append(f"{name}-parents-{k}-{jump}")
            parents = moved.select("id", "p")
            if not moved.where("moved").take(1):
                break
        if labels is None:
            labels = parents.select("id", F.col("p").alias("component"))
        else:
            up = parents.select(F.col("id").alias("i"), "p")
            labels = labels.join(up, F.col("component") == F.col("i"), "left").select("id", F.coalesce("p", "component").alias("component"))
        k += 1
        labels = scratch.write(labels, f"{name}-labels-{k}")
        spent.append(f"{name}-labels-{k}")
        one, two = (parents.select(F.col("id").alias(c), F.col("p").alias(f"{c}2")) for c in ("a", "b"))
        nexts = edges.join(one, "a").join(two, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a < b").distinct()
        edges = scratch.write(nexts, f"{name}-edges-{k}")
        spent.append(f"{name}-edges-{k}")
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    kept = f"{name}-labels-{k}"
    scratch.drop(*[x for x in spent if x != kept])
    return labels
