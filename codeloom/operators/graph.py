"""Graph operators: endpoint resolution, bounded breadth-first search, structural score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import checkpointed


def resolve(edges: DataFrame, symbols: DataFrame, same_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """edges(src, dst_name, kind, file, language), symbols(symbol_id, name, file, language) -> (resolved, pending).

    A name goes to a symbol of its file, else of its language, else (only without a language) to any; least id first.
    """
    names = symbols.select("symbol_id", F.col("name").alias("dst_name"), F.col("file").alias("s_file"), F.col("language").alias("s_language"))
    # At most two candidates a name and file or language, so popular names don't multiply edges.
    in_file = names.groupBy("dst_name", F.col("s_file").alias("file")).agg(F.min("symbol_id").alias("by_file"))
    in_language = names.groupBy("dst_name", F.col("s_language").alias("language")).agg(F.min("symbol_id").alias("by_language"))
    anywhere = names.groupBy("dst_name").agg(F.min("symbol_id").alias("by_name"))
    found = edges.join(in_language, ["dst_name", "language"], "left").join(anywhere, "dst_name", "left")
    found = found.join(in_file, ["dst_name", "file"], "left") if same_file else found.withColumn("by_file", F.lit(None).cast("long"))
    dst = F.coalesce("by_file", "by_language", F.when(F.coalesce("language", F.lit("")) == "", F.col("by_name")))
    found = found.select(*edges.columns, dst.alias("dst")).transform(lambda d: d)
    return found.where("dst is not null").select("src", "dst", "kind").distinct(), found.where("dst is null").drop("dst")


def lookup(names: DataFrame, symbols: DataFrame, pending: DataFrame) -> DataFrame:
    """names(name) -> (symbol_id, name, role): a name's definitions; only where no symbol has the name at all, its callers by
    pending edges(src, dst_name)."""
    names = names.distinct()
    defined = symbols.join(names, "name", "left_semi").select("symbol_id", "name", F.lit("definition").alias("role"))
    unknown = names.join(symbols.select("name"), "name", "left_anti")
    callers = pending.select(F.col("src").alias("symbol_id"), F.col("dst_name").alias("name")).join(unknown, "name", "left_semi").distinct()
    return defined.unionByName(callers.withColumn("role", F.lit("referenced_by")))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    """edges(src, dst), seeds(seed) -> (seed, node), distinct; a seed is its own neighbour where a cycle reaches it.

    One join a level for all seeds together; what a seed has reached isn't expanded again. `both` is the union of the
    closures along and against the edges, not of mixed paths.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction must be outgoing, incoming or both, not {direction!r}")
    if direction == "both":
        return neighbours(edges, seeds, depth, "outgoing").union(neighbours(edges, seeds, depth, "incoming")).distinct()
    depth = max(1, min(10, depth))
    step = edges.select("src", "dst") if direction == "outgoing" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = step.distinct()
    frontier, reached = seeds.select("seed", F.col("seed").alias("src")).distinct(), None
    for level in range(depth):
        new = frontier.join(step, "src").select("seed", F.col("dst").alias("node")).distinct()
        if reached is not None:
            new = new.join(reached, ["seed", "node"], "left_anti")
        if depth > 2:  # beyond that, a plan that repeats all levels before costs more than writing each once
            new = checkpointed(new)
            if new.isEmpty():
                break
        reached = new if reached is None else reached.union(new)
        frontier = new.select("seed", F.col("node").alias("src"))
    return reached if reached is not None else new


def structural_score(candidates: DataFrame, chunk_symbol: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """candidates(chunk_id), chunk_symbol(chunk_id, symbol_id) -> (chunk_id, overlap, score): n neighbours that are other
    candidates' symbols score n / (n + 1)."""
    own = candidates.join(chunk_symbol, "chunk_id")
    near = neighbours(edges, own.select(F.col("symbol_id").alias("seed")), depth, "both")
    others = own.select(F.col("chunk_id").alias("other"), F.col("symbol_id").alias("node"))
    hits = own.join(near, F.col("symbol_id") == F.col("seed")).join(others, "node").where("other <> chunk_id")
    return hits.groupBy("chunk_id").agg(F.count_distinct("node").alias("overlap")).select("chunk_id", "overlap", F.round(F.col("overlap") / (F.col("overlap") + 1), 6).alias("score"))


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
