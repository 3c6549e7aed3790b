"""Ranking: weights, their redistribution, the blend, level selection, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = {"semantic": 0.40, "structural": 0.20, "change": 0.15, "session": 0.15, "keyword": 0.10}


def weights(semantic: bool = True, session: bool = True) -> dict[str, float]:
    """Weights of signals that are there; those of missing ones are spread in proportion."""
    gone = {k for k, there in (("semantic", semantic), ("session", session)) if not there}
    left = sum(v for k, v in WEIGHTS.items() if k not in gone)
    return {k: 0.0 if k in gone else v / left for k, v in WEIGHTS.items()}


def blend(candidates: DataFrame, signals: dict[str, DataFrame], use: dict[str, float], id_col: str, limit: int, min_score: float = 0.0) -> DataFrame:
    """signals: name -> (id, name); a signal that a row lacks counts 0. Ties go to the smaller id; the floor comes last."""
    out = candidates
    for name, signal in signals.items():
        out = out.join(signal.select(id_col, name), id_col, "left")
    score = sum((F.lit(use[n]) * F.coalesce(F.col(n), F.lit(0.0)) for n in signals), F.lit(0.0))
    return out.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(limit).where(F.col("score") >= min_score)


def level(chunks: int, vectors: int, embedder_ready: bool = True) -> str:
    if not chunks:
        return "filesystem"
    if not embedder_ready or not vectors:
        return "keyword"
    ratio = vectors / chunks
    return "hybrid" if ratio >= 0.8 else "mixed" if ratio >= 0.2 else "keyword"


def metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """results(query, rank, item), expected(query, item) -> (query, recall, precision, rr). Recall counts results, 1 at most."""
    wanted = expected.groupBy("query").agg(F.count_distinct("item").alias("wanted"))
    return _measured(results.where(F.col("rank") <= k), expected.select("query", "item").distinct(), wanted, k)


def class_metrics(results: DataFrame, asked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """As `metrics`, where a query of asked(query, label) expects all items of judged(item, label) of its label but itself.

    Expected items are counted a label and looked up for results alone, so no pair of a query and an item is built; only
    queries of several labels, whose items may repeat, are joined with their items.
    """
    asked, judged = (x.where("label is not null").distinct() for x in (asked, judged))
    top = results.where(F.col("rank") <= k)
    hits = top.join(asked, "query").join(judged, ["item", "label"]).where("query <> item").select("query", "item").distinct()
    labels = asked.groupBy("query").agg(F.count("*").alias("labels"), F.min("label").alias("label"))
    counts = judged.groupBy("label").agg(F.count("item").alias("all"))
    itself = judged.select(F.col("item").alias("query"), "label", F.lit(1).alias("itself"))
    one = labels.where("labels = 1").join(counts, "label").join(itself, ["query", "label"], "left").select("query", (F.col("all") - F.coalesce("itself", F.lit(0))).alias("wanted"))
    several = asked.join(labels.where("labels > 1").select("query"), "query").join(judged, "label").where("query <> item").groupBy("query").agg(F.count_distinct("item").alias("wanted"))
    return _measured(top, hits, one.union(several).where("wanted > 0"), k)


def _measured(top: DataFrame, hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    marked = top.join(hits.withColumn("hit", F.lit(1)), ["query", "item"], "left")
    per = marked.groupBy("query").agg(F.count("hit").alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    hits = F.coalesce("hits", F.lit(0))
    return wanted.join(per, "query", "left").select(
        "query",
        F.round(F.least(hits / F.col("wanted"), F.lit(1.0)), 6).alias("recall"),
        F.round(F.when(F.col("n") > 0, hits / F.least(F.lit(k), F.col("n"))).otherwise(0.0), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
    )
