"""Chunks: splitting, merging, truncating, sibling merge, and packing into a token budget. All folds over one array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import token_estimate


def split_lines(df: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index, start_line, end_line, token_count): a line costs its tokens and one (the last one only its
    tokens); a chunk ends before the line that would bring it to the budget."""
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    part = "struct<start_line:int,end_line:int,token_count:int>"
    folded = F.aggregate(
        F.transform(lines, lambda x, i: F.struct((token_estimate(x) + F.when(i + 1 < F.size(lines), 1).otherwise(0)).alias("cost"), (i + 1).alias("line"))),
        F.struct(F.lit(1).alias("start"), F.lit(0).alias("running"), F.expr(f"cast(array() as array<{part}>)").alias("out")),
        lambda a, x: F.when(
            (a["running"] + x["cost"] >= budget) & (x["line"] > a["start"]),
            F.struct(x["line"].alias("start"), x["cost"].alias("running"), F.array_append(a["out"], F.struct(a["start"].alias("start_line"), (x["line"] - 1).alias("end_line"), a["running"].alias("token_count"))).alias("out")),
        ).otherwise(F.struct(a["start"].alias("start"), (a["running"] + x["cost"]).alias("running"), a["out"].alias("out"))),
        lambda a: F.array_append(a["out"], F.struct(a["start"].alias("start_line"), F.size(lines).alias("end_line"), a["running"].alias("token_count"))),
    )
    return df.select(id_col, F.posexplode(folded).alias("chunk_index", "c")).select(id_col, "chunk_index", "c.start_line", "c.end_line", "c.token_count")


def merge_small(chunks: Column, least: int = 20) -> Column:
    """chunks: array of (kind, token_count, end_line) in order; a small one that isn't a header joins the one before."""
    empty = F.expr("cast(array() as array<struct<kind:string,token_count:int,end_line:int>>)")

    def step(acc: Column, c: Column) -> Column:
        n = F.size(acc)
        last = F.element_at(acc, -1)
        joined = F.struct(last["kind"].alias("kind"), (last["token_count"] + c["token_count"]).alias("token_count"), c["end_line"].alias("end_line"))
        return F.when((c["token_count"] < least) & (c["kind"] != "header") & (n > 0), F.array_append(F.slice(acc, F.lit(1), n - 1), joined)).otherwise(F.array_append(acc, c))

    return F.aggregate(chunks, empty, step)


def truncate(text: Column, budget: int) -> Column:
    """struct(lines, used): whole lines of a quarter of their bytes and one each while they fit; the first always stays."""
    return F.aggregate(
        F.split(text, "\n"),
        F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"), F.lit(False).alias("over")),
        lambda a, x: F.when(a["over"], a)
        .when((a["lines"] > 0) & (a["used"] + token_estimate(x) + 1 > budget), F.struct(a["lines"].alias("lines"), a["used"].alias("used"), F.lit(True).alias("over")))
        .otherwise(F.struct((a["lines"] + 1).alias("lines"), (a["used"] + token_estimate(x) + 1).alias("used"), F.lit(False).alias("over"))),
        lambda a: F.struct(a["lines"].alias("lines"), a["used"].alias("used")),
    )


def merge_siblings(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of equal keys become one: contents by chunk_index, tokens summed, widest lines, best score."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy(*keys).agg(
        F.min("chunk_index").alias("chunk_index"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("token_count").cast("long").alias("token_count"), F.max("score").alias("score"), F.count("*").alias("parts"), F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content")
    )


#: So many of the best candidates are looked at.
MOST_CANDIDATES = 400


def pack_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """candidates(id, path, start_line, end_line, token_count, score), the best MOST_CANDIDATES of them -> (position, id, token_count).

    By falling score: one that lies by more than half of its lines within a chosen chunk of its path is left out; one that
    fits is taken; the first one is cut to the budget, a later one that doesn't fit is taken whole and ends the list.
    """
    item = F.struct((-F.col("score")).alias("o"), "id", "path", "start_line", "end_line", "token_count")
    best = candidates.orderBy(F.desc("score"), "id").limit(MOST_CANDIDATES)
    one = best.agg(F.array_sort(F.collect_list(item)).alias("all"))
    empty = F.expr("cast(array() as array<struct<id:bigint,path:string,start_line:int,end_line:int,token_count:int>>)")

    def step(a: Column, c: Column) -> Column:
        overlap = lambda s: F.greatest(F.lit(0), F.least(s["end_line"], c["end_line"]) - F.greatest(s["start_line"], c["start_line"]) + 1)
        covered = F.exists(a["out"], lambda s: (s["path"] == c["path"]) & (overlap(s) / (c["end_line"] - c["start_line"] + 1) > 0.5))
        first = F.size(a["out"]) == 0
        taken = F.when(first, F.least(c["token_count"], a["left"])).otherwise(c["token_count"])
        chosen = F.struct(c["id"].alias("id"), c["path"].alias("path"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), taken.alias("token_count"))
        return F.when((a["left"] <= 0) | covered, a).otherwise(F.struct((a["left"] - taken).alias("left"), F.array_append(a["out"], chosen).alias("out")))

    folded = F.aggregate("all", F.struct(F.lit(budget).alias("left"), empty.alias("out")), step, lambda a: a["out"])
    return one.select(F.posexplode(folded).alias("position", "c")).select("position", "c.id", "c.token_count")


def fallback(files: DataFrame, budget: int) -> DataFrame:
    """files(path, tok, ...) -> what fits the budget in the order of paths, the last one cut: with token_count, and score 0.1.

    A file of no tokens costs nothing, so only others bound how many can be taken: so many paths reach one task, the least first.
    """
    taken = files.where("tok > 0").orderBy("path").limit(budget + 1)
    before = F.coalesce(F.sum("tok").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return taken.withColumn("__before", before).where(F.col("__before") < budget).withColumn("token_count", F.least(F.col("tok"), budget - F.col("__before")).cast("int")).withColumn("score", F.lit(0.1)).drop("__before", "tok")


def merged_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits(chunk_id, score) hydrated, the parts of a split symbol (same path, symbol and kind) as one, with the best part's score.

    The first part's chunk_id stands for them.
    """
    keys = ["path", "symbol_name", "kind"]
    scored = chunks.join(hits, "chunk_id")
    named = scored.where("symbol_name is not null and symbol_name <> ''")
    parts = chunks.join(named.select(*keys).distinct(), keys, "left_semi").join(hits, "chunk_id", "left")
    merged = merge_siblings(parts, keys).join(parts.groupBy(*keys).agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id")), keys)
    columns = ["chunk_id", *keys, "start_line", "end_line", F.col("token_count").cast("int").alias("token_count"), "score", "content"]
    return scored.where("symbol_name is null or symbol_name = ''").select(*columns).unionByName(merged.select(*columns))


def expand(neighbours: DataFrame, left: int, share: int = 30) -> DataFrame:
    """neighbours(id, token_count, score) of what was packed -> (position, id): by falling score, each one that still fits
    into that share (per cent) of the tokens left."""
    one = neighbours.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "token_count"))).alias("all"))
    folded = F.aggregate(
        "all",
        F.struct(F.lit(left * share // 100).alias("left"), F.array().cast("array<bigint>").alias("out")),
        lambda a, c: F.when(c["token_count"] > a["left"], a).otherwise(F.struct((a["left"] - c["token_count"]).alias("left"), F.array_append(a["out"], c["id"]).alias("out"))),
        lambda a: a["out"],
    )
    return one.select(F.posexplode(folded).alias("position", "id"))
