"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, checkpointed

#: So many links at most are united in one task (some 100 MB); more of them by stars, in rounds.
ONE_TASK = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(by_key(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(by_key(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def united(batches):
    """(u, v) of all links -> (node, component), each node under the least one that it reaches."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*ends) if ends else ((), ())))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    least = np.arange(len(nodes))
    while len(u):
        a, b = least[u], least[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]
    for i in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[least[i : i + (1 << 16)]])], ["node", "component"])


def connected_components(links: DataFrame) -> DataFrame:
    """links(u, v) -> (node, component): every node that has a link, with the least node it reaches.

    Links may repeat, run both ways or lead to themselves; null ends are left out; no links give no rows. Each round
    shuffles links alone and is cut off in the checkpoint folder; the driver sees two numbers a round. Few links need no
    rounds, whose plans are what a driver's memory is spent on.
    """
    edges = checkpointed(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if all(t == "bigint" for _, t in edges.dtypes) and edges.count() <= ONE_TASK:
        return checkpointed(edges.coalesce(1).mapInArrow(united, "node long, component long"))
    mark = None
    while True:
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark = tuple(row)
        edges = checkpointed(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
