"""Exact inner-product top-k with one KD-tree per shard.

Vectors are dealt into shards that are compact in space: the top levels of one KD-tree, at most `LEAVES` leaves, are cut at the
medians of a bounded sample (`SAMPLE` rows by hash of the id); every row goes to its leaf, and a leaf of more than `SHARD_ROWS`
rows is parted by hash. Where a cut lies changes nothing in the result. Each shard becomes one row that holds its tree: median
splits on the widest side, tight bounding boxes, leaves of `LEAF` vectors. Queries come in blocks of about `BLOCK`, dealt by
the same cuts. For a query q the best product within a box [lo, hi] is sum(max(q*lo, q*hi)); a search takes boxes best
first and ends when the next bound lies under the k-th score.

A block visits leaves by falling bound, in rounds: the best one, then the next four, then the rest. After each round the k-th
scores so far are propagated: leaves whose box can't reach them aren't visited, and trees are entered with them.

Rows without an id, null or empty vectors and those with null or non-finite components take no part; vectors of different
lengths are not compared with each other. Ties go to the smaller id; rows of the query's own id are never its results; an
id that occurs several times as a query is asked once for each different vector, and results merge under the id.
Fewer candidates than k give fewer rows; an empty table gives none. Other columns are left out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, small_batches, table

SHARD_ROWS, LEAF, BLOCK = 8192, 128, 256
#: Leaves of the tree over the shards at most, and rows it is cut by.
LEAVES, SAMPLE = 1024, 16384
#: Leaves that a block has visited after each round.
ROUNDS = (1, 5, LEAVES)


class Tree:
    """Nodes as arrays: rows [start, end), the box, and the left child (the right one follows it; -1: a leaf)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        start, end, left, lo, hi = [], [], [], [], []

        def node(a: int, b: int) -> int:
            start.append(a), end.append(b), left.append(-1)
            own = points[order[a:b]]
            lo.append(own.min(0)), hi.append(own.max(0))
            return len(start) - 1

        todo = [node(0, len(ids))]
        while todo:
            at = todo.pop()
            a, b = start[at], end[at]
            if b - a <= leaf or not (hi[at] > lo[at]).any():
                continue
            side = int(np.argmax(hi[at] - lo[at]))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(points[order[a:b], side], mid)]
            left[at] = node(a, a + mid)
            node(a + mid, b)
            todo += [left[at], left[at] + 1]
        self.ids, self.points = ids[order], np.ascontiguousarray(points[order])
        self.start, self.end, self.left, self.lo, self.hi = np.array(start), np.array(end), np.array(left), np.array(lo), np.array(hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Best possible product of each query in each box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, id), best first, of those that reach `least`."""
        best: list[tuple[float, int]] = []
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            at = heapq.heappop(heap)[1]
            if (child := self.left[at]) >= 0:
                for c in (child, child + 1):
                    if bounds[c] >= least:
                        heapq.heappush(heap, (-bounds[c], int(c)))
                continue
            a, b = self.start[at], self.end[at]
            scores = self.points[a:b] @ query
            near = np.flatnonzero((scores >= least) & (self.ids[a:b] != own))
            if len(near):
                best = sorted([*best, *zip(scores[near].tolist(), self.ids[a:b][near].tolist())], key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


def cuts(points: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (side, value, left, right) of a tree with so many leaves; a leaf is (-1, its number, 0, 0)."""
    nodes: list[tuple] = []
    numbers = iter(range(leaves))

    def grow(own: np.ndarray, want: int) -> int:
        at = len(nodes)
        nodes.append(())
        if want == 1:
            nodes[at] = -1, next(numbers), 0, 0
            return at
        side = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
        value = float(np.quantile(own[:, side], (want // 2) / want)) if len(own) else 0.0
        low = own[:, side] <= value if len(own) else np.zeros(0, bool)
        left = grow(own[low], want // 2)
        nodes[at] = side, value, left, grow(own[~low], want - want // 2)
        return at

    grow(points, leaves)
    return nodes


def leaf_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    side, value, left, right = (np.array(x) for x in zip(*nodes))
    at = np.zeros(len(points), np.int64)
    while (inner := np.flatnonzero(side[at] >= 0)).size:
        own = at[inner]
        at[inner] = np.where(points[inner, side[own]] <= value[own], left[own], right[own])
    return value[at].astype(np.int64)


def _dealt(df: DataFrame, nodes: list[tuple], dims: int, per: int, name: str) -> DataFrame:
    """df with the leaf of each row, and the number of its part of the leaf. Vectors of another length than `dims` have leaf 0."""

    def run(frames):
        for frame in frames:
            leaf = np.zeros(len(frame), np.int32)
            own = np.flatnonzero(frame.v.map(len).to_numpy() == dims) if len(frame) else []
            if len(own):
                leaf[own] = leaf_of(nodes, np.stack(frame.v.iloc[own].to_numpy()).astype(np.float64))
            yield frame.assign(leaf=leaf)

    placed = df.select("id", "v").mapInPandas(run, "id long, v array<double>, leaf int") if len(nodes) > 1 else df.select("id", "v", F.lit(0).alias("leaf"))
    # One row a leaf, LEAVES of them at most.
    parts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / per).cast("int").alias("parts"))
    spread = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")).cast("int")  # repeated ids are spread, too
    return placed.join(F.broadcast(parts), "leaf").select("id", "v", "leaf", spread.alias(name))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(id, v array<double>), queries(id, v) -> query_id, rank, id, score double.

    What one task holds is one shard's tree and one block of queries, whatever the table's size.
    """
    small_batches(vectors.sparkSession)
    sound = lambda df: df.where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    vectors, queries = sound(vectors), sound(queries)
    lengths = vectors.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims, leaves = (lengths["dims"], max(1, min(LEAVES, -(-lengths["count"] // shard_rows)))) if lengths else (0, 1)
    nodes = [(-1, 0, 0, 0)]
    if leaves > 1:
        # A share of the hashes first, so that partitions don't each send SAMPLE rows to the driver.
        least = min((1 << 63) - 1, int((min(1.0, 2 * SAMPLE / lengths["count"]) - 0.5) * 2**64))
        near = vectors.where((F.size("v") == dims) & (F.xxhash64("id") <= least)).groupBy("id").agg(F.first("v").alias("v"))
        sample = near.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
        nodes = cuts(np.stack(sample.v.to_numpy()), leaves)

    def packed(own: pd.DataFrame, name: str) -> pd.DataFrame:
        rows = []
        for dim, part in own.groupby(own.v.map(len)):
            points = np.stack(part.v.to_numpy()).astype(np.float64)
            rows.append((int(part.leaf.iloc[0]), int(part[name].iloc[0]), dim, part.id.to_numpy(np.int64).tobytes(), points.tobytes(), np.concatenate([points.min(0), points.max(0)]).tobytes()))
        return pd.DataFrame(rows, columns=["leaf", name, "dim", f"{name}_ids", f"{name}_points", "box"]).astype({"leaf": "int32", name: "int32", "dim": "int32"})

    dealt = _dealt(vectors, nodes, dims, shard_rows, "shard")
    stored = checkpointed(dealt.groupBy("leaf", "shard").applyInPandas(lambda own: packed(own, "shard"), "leaf int, shard int, dim int, shard_ids binary, shard_points binary, box binary"))
    asked = _dealt(queries.dropDuplicates(), nodes, dims, BLOCK, "block").groupBy("leaf", "block").applyInPandas(lambda own: packed(own, "block"), "leaf int, block int, dim int, block_ids binary, block_points binary, box binary")
    blocks = checkpointed(asked.select(F.concat_ws(":", "leaf", "block").alias("block"), "dim", "block_ids", "block_points"))

    def united(own: pd.DataFrame) -> pd.DataFrame:
        boxes = np.stack([np.frombuffer(b) for b in own.box]).reshape(len(own), 2, -1)
        return pd.DataFrame({"leaf": own.leaf.iloc[:1], "dim": own.dim.iloc[:1], "parts": [int(own.shard.max()) + 1], "box": [np.concatenate([boxes[:, 0].min(0), boxes[:, 1].max(0)]).tobytes()]}).astype({"leaf": "int32", "dim": "int32", "parts": "int32"})

    # A leaf has one row for each length of vectors in it; all but leaf 0 have one.
    boxes = stored.select("leaf", "shard", "dim", "box").groupBy("leaf", "dim").applyInPandas(united, "leaf int, dim int, parts int, box binary").toPandas()

    def visits(frames, done: int, now: int):
        """(leaf, shard) that each block still has to visit, of those from number `done` to `now` by falling bound."""
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                own = boxes[boxes.dim == row.dim]
                if not len(own):
                    continue
                q, b = np.frombuffer(row.block_points).reshape(-1, row.dim), np.stack([np.frombuffer(x) for x in own.box]).reshape(len(own), 2, -1)
                bounds = np.maximum(q, 0) @ b[:, 1].T + np.minimum(q, 0) @ b[:, 0].T
                least = np.frombuffer(row.least) if row.least else np.full(len(q), -np.inf)
                order = np.lexsort((own.leaf.to_numpy(), -bounds.max(0)))[done:now]
                out += [(*row, int(own.leaf.iloc[i]), part) for i in order if (bounds[:, i] >= least).any() for part in range(own.parts.iloc[i])]
            yield pd.DataFrame(out, columns=[*frame.columns, "leaf", "shard"]).astype({"dim": "int32", "leaf": "int32", "shard": "int32"})

    def search(frames):
        """Rows come by shard, its own row before the blocks that ask it."""
        held, tree = None, None
        for frame in frames:
            for row in frame.itertuples(index=False):
                ids, points = np.frombuffer(row.ids, np.int64), np.frombuffer(row.points).reshape(-1, row.dim)
                if row.kind == 0:
                    held, tree = (row.leaf, row.shard, row.dim), Tree(ids, points)
                    continue
                if held != (row.leaf, row.shard, row.dim):
                    continue
                least = np.frombuffer(row.least) if row.least else np.full(len(ids), -np.inf)
                bounds, found = tree.bounds(points), []
                for i, own in enumerate(ids.tolist()):
                    found += [(row.block, row.dim, i, own, c, s) for s, c in tree.search(points[i], own, bounds[i], k, least[i])]
                yield pd.DataFrame(found, columns=["block", "dim", "place", "query_id", "id", "score"]).astype({"id": "int64", "query_id": "int64", "score": "float64", "dim": "int32", "place": "int32"})

    schema = "block string, dim int, place int, query_id long, id long, score double"

    def searched(asked: DataFrame) -> DataFrame:
        """A shard's row is sent once, a block's row once a shard it visits."""
        none = F.lit(None)
        rows = stored.join(asked.select("leaf", "shard").distinct(), ["leaf", "shard"], "left_semi")
        rows = rows.select("leaf", "shard", "dim", F.lit(0).alias("kind"), F.col("shard_ids").alias("ids"), F.col("shard_points").alias("points"), none.cast("string").alias("block"), none.cast("binary").alias("least"))
        rows = rows.union(asked.select("leaf", "shard", "dim", F.lit(1), "block_ids", "block_points", "block", "least"))
        return rows.repartition("leaf", "shard").sortWithinPartitions("leaf", "shard", "dim", "kind").mapInPandas(search, schema)

    def with_least(key, block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        block = block[["block", "dim", "block_ids", "block_points"]].copy()
        n = len(block.block_ids.iloc[0]) // 8 if len(block) else 0
        least = np.full(n, -np.inf)
        for place, scores in found.groupby("place").score:
            if len(scores) >= k:
                least[place] = scores.nlargest(k).min()
        block["least"] = [least.tobytes()] * len(block)
        return block

    found, done = None, 0
    known = blocks.withColumn("least", F.lit(None).cast("binary"))
    for now in ROUNDS:
        if done and done >= len(boxes):
            break
        if found is not None:
            known = blocks.groupBy("block", "dim").cogroup(found.groupBy("block", "dim")).applyInPandas(with_least, "block string, dim int, block_ids binary, block_points binary, least binary")
        a, b = done, now if now < LEAVES else len(boxes)
        visit = checkpointed(known.mapInPandas(lambda frames, a=a, b=b: visits(frames, a, b), "block string, dim int, block_ids binary, block_points binary, least binary, leaf int, shard int"))
        more = checkpointed(searched(visit))
        found, done = more if found is None else found.union(more), now
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.select("query_id", "id", "score").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op4_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("transform(embedding, x -> cast(floor(256 * cast(x as double)) as double))").alias("v"), "embedding")
    rows = rows.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))").drop("embedding")
    found = top_k(rows, rows.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


OP4_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
