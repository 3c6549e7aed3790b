"""Vector operators: health, exact top-k, batch nearest neighbours, reconciliation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import vector_fault


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): best cosines; what isn't sound or of the query's length takes no part. A batch is one matrix product."""
    asked = np.array(query, np.float64)
    asked_norm = float(np.linalg.norm(asked))

    def scored(batches):
        for batch in batches:
            own = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), len(asked)), False))
            points = own.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, len(asked))
            norm = np.sqrt((points * points).sum(1))
            good = np.isfinite(points).all(1) & (norm > 0)
            score = points[good] @ asked / (norm[good] * asked_norm) if asked_norm else np.zeros(int(good.sum()))
            yield pa.RecordBatch.from_arrays([own.column(0).filter(pa.array(good)), pa.array(score, pa.float64())], [id_col, "score"])

    kind = vectors.schema[id_col].dataType.simpleString()
    found = vectors.select(id_col, vector_col).mapInArrow(scored, f"`{id_col}` {kind}, score double")
    return found.select(id_col, F.round("score", 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def sound(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vectors have no fault; the length that most have (the least of several) is asked for."""
    v = F.col(vector_col)
    most = vectors.where(v.isNotNull()).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return vectors.where(vector_fault(v, most["d"] if most else 0).isNull())


def health(vectors: DataFrame, dims: int, vector_col: str = "embedding") -> DataFrame:
    return vectors.select(F.coalesce(vector_fault(F.col(vector_col), dims), F.lit("ok")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


#: Rows of one pack of candidates, and scores that a task holds at once.
PACK_ROWS, SCORES = 4096, 1 << 22


def blocks_of(rows: int, vectors: DataFrame, block_rows: int) -> int:
    """Blocks of at most about `block_rows` queries (of 256 at least); where there are several, as many as keep all cores busy."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, min(-(-rows // min(256, block_rows)), cores * -(-rows // (block_rows * cores))))


def packs(rows: DataFrame, kind: str, pack_rows: int = PACK_ROWS) -> DataFrame:
    """rows(key, id, v), those of a key in a row -> (key, ids, points): up to `pack_rows` vectors of a key as one row of float64 bytes
    or, where v is array<float>, float32."""

    def run(batches):
        for batch in batches:
            key, v = batch.column(0).to_numpy(), batch.column(2)
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(bounds[:-1], bounds[1:]):
                for a in range(low, high, pack_rows):
                    own = slice(a, min(high, a + pack_rows))
                    ids = pa.array([batch.column(1)[own].to_pylist()], pa.list_(batch.column(1).type))
                    points = v[own].flatten().to_numpy(zero_copy_only=False).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 1]), ids, pa.array([points], pa.binary())], ["key", "ids", "points"])

    return rows.mapInArrow(run, f"key int, ids array<{kind}>, points binary")


def unit(points: bytes, rows: int, dtype: str) -> np.ndarray:
    v = np.frombuffer(points, dtype).reshape(rows, -1).astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


class Best:
    """The k best (score, id) of each of a block's queries, so far; ties to the lesser id."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, k: int):
        self.ids, self.points, self.single, self.k = ids, points, points.astype(np.float32), k
        self.least = np.full(len(ids), -np.inf)
        self.rows = pd.DataFrame({"row": np.zeros(0, np.int64), "score": np.zeros(0), "neighbour": ids[:0]})
        # What a product of unit vectors in single precision may be off by, and what rounding to six digits adds.
        self.slack = (points.shape[1] + 8) * 2.0**-23 + 1.1e-6

    def meet(self, ids: np.ndarray, points: np.ndarray, own: np.ndarray) -> None:
        """Compare the queries at the places `own` with a pack. Single precision chooses, double precision scores."""
        single = points.astype(np.float32)
        step = max(1, SCORES // max(1, len(ids)))
        for a in range(0, len(own), step):
            at = own[a : a + step]
            s = self.single[at] @ single.T
            least = self.least[at] - self.slack
            if len(ids) > self.k + 1 and not np.isfinite(least).all():
                # One more than k, as the query itself may be among them.
                least = np.maximum(least, np.partition(s, -self.k - 1, axis=1)[:, -self.k - 1] - self.slack)
            # As a float32 the bound is rounded down, so none is lost by it.
            i, j = np.nonzero(s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            for b in range(0, len(i), 1 << 17):
                self.add(at[i[b : b + (1 << 17)]], ids, points, j[b : b + (1 << 17)])

    def add(self, row: np.ndarray, ids: np.ndarray, points: np.ndarray, j: np.ndarray) -> None:
        score = np.round(np.einsum("ij,ij->i", self.points[row], points[j]), 6)
        good = (score >= self.least[row]) & (self.ids[row] != ids[j])
        if not good.any():
            return
        new = pd.DataFrame({"row": row[good], "score": score[good], "neighbour": ids[j[good]]})
        touched = np.zeros(len(self.ids), bool)
        touched[new["row"].to_numpy()] = True
        old = touched[self.rows["row"].to_numpy()]
        both = pd.concat([self.rows[old], new]).sort_values(["row", "score", "neighbour"], ascending=[True, False, True])
        number = both.groupby("row").cumcount().to_numpy()
        last = both[number == self.k - 1]
        self.least[last["row"].to_numpy()] = last["score"].to_numpy()
        self.rows = pd.concat([self.rows[~old], both[number < self.k]])

    def result(self) -> pd.DataFrame:
        return pd.DataFrame({"id": self.ids[self.rows["row"].to_numpy()], "neighbour": self.rows["neighbour"].to_numpy(), "score": self.rows["score"].to_numpy()})


def nearest(asked: DataFrame, sent: DataFrame, blocks: int, k: int, probed=None) -> DataFrame:
    """asked(block, id, v) and sent(block, key, ids, points) -> (id, neighbour, score): k best cosines of every query among what its block is sent.

    A task takes the queries of a block into memory and what is sent to them pack by pack, so it holds a bounded number of
    scores and returns k rows a query. With `probed` (vectors -> a table of bools) a query meets the keys it names alone.
    """
    kind, dtype = asked.schema["id"].dataType.simpleString(), "<f4" if asked.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    own = packs(asked.select(F.col("block").alias("key"), "id", "v").repartitionById(blocks, F.col("block")).sortWithinPartitions("key"), kind)
    rows = own.select(F.col("key").alias("block"), F.lit(0).alias("role"), "key", "ids", "points").union(sent.select("block", F.lit(1), "key", "ids", "points"))

    def run(batches):
        block, best, queries, names = None, None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                at, role, key = (batch.column(c)[row].as_py() for c in range(3))
                ids, points = batch.column(3)[row].values.to_numpy(zero_copy_only=False), batch.column(4)[row].as_py()
                if at != block:
                    if best is not None:
                        yield pa.RecordBatch.from_pandas(best.result(), schema=schema, preserve_index=False)
                    block, best, queries = at, None, []
                points = unit(points, len(ids), dtype)
                if role == 0:
                    queries.append((ids, points))
                    continue
                if best is None:
                    if not queries:
                        continue
                    best = Best(*(np.concatenate(x) for x in zip(*queries)), k)
                    names = probed(best.points) if probed else None
                best.meet(ids, points, np.flatnonzero(names[:, key]) if probed else np.arange(len(best.ids)))
        if best is not None:
            yield pa.RecordBatch.from_pandas(best.result(), schema=schema, preserve_index=False)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = f"id {kind}, neighbour {kind}, score double"
    schema = to_arrow_schema(StructType.fromDDL(out))
    found = rows.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "role").mapInArrow(run, out)
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", F.col("rank").cast("int").alias("rank"), "neighbour", "score")


def block_of(id_col: str, blocks: int):
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def knn_join(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384) -> DataFrame:
    """(id, rank, neighbour, score): each vector's k best cosines among the others.

    Queries are dealt into blocks, and packs of all rows are sent to each; every pair is a matrix product of bounded size.
    Vectors with a fault, or of another length than most, take no part.
    """
    vectors = sound(vectors, vector_col)
    blocks = blocks_of(vectors.count(), vectors, block_rows)
    v = F.col(vector_col) if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else F.col(vector_col).cast("array<double>")
    rows = vectors.select(block_of(id_col, blocks).alias("block"), F.col(id_col).cast("long").alias("id"), v.alias("v"))
    all_packs = packs(rows.select(F.lit(0).alias("key"), "id", "v"), "bigint", min(PACK_ROWS, block_rows))
    sent = all_packs.select("key", "ids", "points", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return nearest(rows, sent, blocks, k).withColumnRenamed("id", id_col)


def ivf_index(vectors: DataFrame, lists: int, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 10_000, seed: int = 7):
    """Coarse centroids fitted on a bounded sample (`sample` rows by hash of the id), and every sound row's list."""
    vectors = sound(vectors, vector_col)
    # A share of the hashes first, so that partitions don't each send `sample` rows to the driver.
    least = min((1 << 63) - 1, int((min(1.0, 2 * sample / max(1, vectors.count())) - 0.5) * 2**64))
    near = vectors.where(F.xxhash64(id_col) <= least).groupBy(id_col).agg(F.first(vector_col).alias(vector_col))
    rows = near.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toPandas()
    points = np.stack(rows[vector_col].to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    centres = points[np.random.default_rng(seed).choice(len(points), min(lists, len(points)), replace=False)] if len(points) else np.zeros((1, 1))
    for _ in range(10 if len(points) else 0):
        own = np.argmax(points @ centres.T, axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                m = points[own == c].mean(0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)

    def lists_of(frames):
        for frame in frames:
            p = np.stack(frame[vector_col].to_numpy()).astype(float) if len(frame) else np.zeros((0, centres.shape[1]))
            yield frame.assign(list=np.argmax(p @ centres.T, axis=1).astype("int32"))

    kind = vectors.schema[id_col].dataType.simpleString()
    listed = vectors.select(id_col, vector_col).mapInPandas(lists_of, f"{id_col} {kind}, {vector_col} array<float>, list int")
    return centres, listed


def ivf_top_k(index, query: list[float], k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    centres, listed = index
    near = np.argsort(-(centres @ np.array(query)))[:probes]
    return top_k(listed.where(F.col("list").isin([int(x) for x in near])), query, k, id_col, vector_col)


def ivf_search(index, queries: DataFrame, k: int, probes: int, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384) -> DataFrame:
    """(id, rank, neighbour, score) of many queries at once: each meets its `probes` nearest lists.

    Queries are dealt into blocks, and each block is sent the lists that any of its queries asks, in packs.
    """
    centres, listed = index
    queries = sound(queries, vector_col)
    blocks = blocks_of(queries.count(), queries, block_rows)

    def probed(points: np.ndarray) -> np.ndarray:
        named = np.zeros((len(points), len(centres)), bool)
        for a in range(0, len(points), 4096):
            near = np.argsort(-(points[a : a + 4096] @ centres.T), axis=1)[:, :probes]
            np.put_along_axis(named[a : a + 4096], near, True, axis=1)
        return named

    def lists_asked(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            own /= np.linalg.norm(own, axis=1, keepdims=True)
            block, named = batch.column(0).to_numpy(), probed(own)
            for b in np.unique(block).tolist():
                held[b] = named[block == b].any(0) | held.get(b, False)
        for b, named in held.items():
            lists = np.flatnonzero(named).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), b, np.int32)), pa.array(lists)], ["block", "key"])

    kind = listed.schema[id_col].dataType.simpleString()
    asked = queries.select(block_of(id_col, blocks).alias("block"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    # As many rows as blocks and lists, but sized by vectors; neither side is left to a guess.
    pairs = asked.select("block", "v").mapInArrow(lists_asked, "block int, key int").distinct()
    rows = listed.select(F.col("list").alias("key"), F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    sent = packs(rows.repartition("key").sortWithinPartitions("key"), kind).join(pairs.hint("merge"), "key")
    return nearest(asked, sent, blocks, k, probed).withColumnRenamed("id", id_col)


def upsert_vectors(base: DataFrame, new: DataFrame, dims: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """base with new vectors in place of those of the same id; of several of one id the last given counts. Faulty ones are left out."""
    good = new.where(vector_fault(F.col(vector_col), dims).isNull())
    one = good.withColumn("__at", F.monotonically_increasing_id()).groupBy(id_col).agg(F.max_by(vector_col, "__at").alias(vector_col))
    return base.select(id_col, vector_col).join(one.select(id_col), id_col, "left_anti").unionByName(one)


def delete_vectors(base: DataFrame, gone: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return base.join(gone.select(id_col), id_col, "left_anti")


def missing(flagged: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Flagged as embedded, but without a vector."""
    return flagged.join(stored.select(key), key, "left_anti")


def present(unflagged: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Not flagged, but with a vector."""
    return unflagged.join(stored.select(key), key, "left_semi")
