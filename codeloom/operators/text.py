"""Full-text operators: postings, BM25, phrases."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import WORD, sanitize_query, tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf, len): one row a term and document."""
    split = df.select(id_col, tokens(F.col(text_col)).alias("t"))
    return split.select(id_col, F.size("t").alias("len"), F.explode("t").alias("term")).groupBy(id_col, "term", "len").agg(F.count("*").alias("tf"))


def counted(split: DataFrame) -> DataFrame:
    """Each row's array `t` of tokens -> a row a distinct one: the other columns, len, term, tf. Counted within the row, without a shuffle."""
    others = [c for c in split.columns if c != "t"]
    runs = split.select(*others, F.sort_array("t").alias("s"))
    runs = runs.select(*others, "s", F.expr("CASE WHEN size(s) > 0 THEN filter(sequence(0, size(s) - 1), i -> i = 0 OR s[i] <> get(s, i - 1)) ELSE array() END").alias("first"))
    terms = F.expr("transform(first, (i, j) -> struct(s[i] AS term, cast(coalesce(get(first, j + 1), size(s)) - i AS bigint) AS tf))")
    # An outer generator, as Spark filters before others by what they are given, which would cut texts into tokens twice.
    return runs.select(*others, F.size("s").alias("len"), F.inline_outer(terms)).where("term is not null")


#: Folders of stored postings: a query reads the files of its terms' buckets. Rows that a task sorts, about.
BUCKETS, TASK_ROWS = 64, 1 << 20


class Index:
    """Stored postings (bucket, term, id, tf, len), laid out by the hash of the term, and a one-row table of the documents' number and
    total length. A search reads its terms' postings, never a text. `keep` are further columns of the documents to filter by."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id"):
        self.spark, self.path, self.id_col = spark, path, id_col

    @classmethod
    def build(cls, df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> Index:
        split = df.select(id_col, *keep, F.col(text_col).isNotNull().alias("held"), F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")).alias("t"))
        split.agg(F.count("*").alias("n"), F.count_if("held").alias("texts"), F.sum(F.size("t")).alias("total")).write.mode("overwrite").parquet(f"{path}/statistics")
        rows = counted(split.select(id_col, *keep, "t"))
        if not df.groupBy(id_col).count().where("count > 1").isEmpty():
            rows = rows.groupBy(id_col, *keep, "len", "term").agg(F.sum("tf").alias("tf"))
        # Postings are exchanged once; a bucket has as many files as keep what a task sorts to some TASK_ROWS rows.
        total = df.sparkSession.read.parquet(f"{path}/statistics").first()["total"] or 0
        pieces = -(-max(1, total) // (BUCKETS * TASK_ROWS))
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        task = F.col("bucket") * pieces + F.pmod(F.xxhash64(id_col), F.lit(pieces)).cast("int")
        rows.repartitionById(BUCKETS * pieces, task).sortWithinPartitions("bucket", "term", id_col).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        return cls(df.sparkSession, path, id_col)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/postings")
        if terms is None:
            return rows
        # Buckets are found by the same hash, on the driver, so partitions are pruned before files are listed.
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")).distinct().collect()] if terms else []
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def statistics(self) -> tuple[int, float]:
        n, texts, total = self.spark.read.parquet(f"{self.path}/statistics").agg(F.sum("n"), F.sum("texts"), F.sum("total")).first()
        return n or 0, (total or 0) / texts if texts else 0.0

    def bm25(self, query: str, scope: Column | None = None) -> DataFrame:
        """(id, rank), as `bm25` gives; `scope` is over the kept columns."""
        terms = sorted({w.lower() for w in sanitize_query(query)})
        hits = self.postings(terms).withColumn("in_scope", scope if scope is not None else F.lit(True))
        return ranked(hits, *self.statistics(), self.id_col)

    def top(self, query: str, k: int, scope: Column | None = None) -> DataFrame:
        return self.bm25(query, scope).select(self.id_col, F.round("rank", 6).alias("rank")).orderBy("rank", self.id_col).limit(k)


def ranked(hits: DataFrame, n: int, average: float, id_col: str) -> DataFrame:
    """hits(id, term, tf, len, in_scope) of the query's terms -> (id, rank)."""
    idf = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", F.greatest(F.lit(LEAST_IDF), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (average or 1.0)))
    # As many rows as the query has words.
    return hits.where("in_scope").join(F.broadcast(idf), "term").groupBy(id_col).agg((-F.sum(part)).alias("rank"))


def bm25(df: DataFrame, query: str, scope: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank): rank is the negated BM25 of documents that hold any query word; document statistics are of all rows.

    Only the query's terms leave the scan; `scope` filters before scoring, statistics excepted.
    """
    terms = sorted({w.lower() for w in sanitize_query(query)})
    lower = F.lower(F.col(text_col))
    n, average = df.agg(F.count("*"), F.avg(F.regexp_count(lower, F.lit(WORD)))).first()
    # A text without any term as a substring holds none as a token and needn't be cut into tokens.
    possible = reduce(lambda a, b: a | b, [lower.contains(t) for t in terms], F.lit(False))
    split = df.where(possible).select(id_col, tokens(F.col(text_col)).alias("t"), (scope if scope is not None else F.lit(True)).alias("in_scope"))
    found = F.filter("t", lambda x: x.isin(*terms) if terms else F.lit(False))
    hits = split.select(id_col, "in_scope", F.size("t").alias("len"), F.explode(found).alias("term")).groupBy(id_col, "term", "len", "in_scope").agg(F.count("*").alias("tf"))
    return ranked(hits, n, average or 0.0, id_col)


def top_keyword(df: DataFrame, query: str, k: int, scope: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    ranked = bm25(df, query, scope, id_col).select(id_col, F.round("rank", 6).alias("rank"))
    return ranked.orderBy("rank", id_col).limit(k)


def phrase(df: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hits): how often the words occur one after another."""
    # Each token between spaces of its own; the look-ahead counts hits that overlap.
    wanted = "(?=" + "".join(f" {re.escape(w.lower())} " for w in words) + ")"
    spaced = F.concat(F.lit(" "), F.array_join(tokens(F.col(text_col)), "  "), F.lit(" "))
    return df.select(id_col, F.regexp_count(spaced, F.lit(wanted)).cast("long").alias("hits")).where("hits > 0")
