"""The benchmark tables seen as the index's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lineage import new_folder
from ..functions.scalar import token_estimate
from ..operators.text import Index

LINES = 4


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Texts are spread over all cores where their files make fewer splits than there are cores; large tables stay as they are."""
    df, cores = spark.read.parquet(f"{d}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def files(spark: SparkSession, d: str) -> DataFrame:
    test = F.col("doc_id") % 10 == 0
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.when(test, "_test").otherwise(""), F.lit(".txt"))
    return t(spark, d, "documents").select("doc_id", path.alias("path"), F.col("lang").alias("language"), test.alias("is_test"), "source", "text", "n_chars")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows of LINES lines; chunk_id = doc_id * 10000 + chunk_index. The window overlaps the next one by a line."""
    lines = F.split("text", "\n")
    first = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES).cast("int")), lambda i: F.slice(lines, i * LINES + 1, LINES + 1))).alias("chunk_index", "part")
    out = files(spark, d).select("doc_id", "path", "language", "is_test", "source", F.size(lines).alias("n"), first)
    content = F.array_join("part", "\n")
    start = F.col("chunk_index") * LINES + 1
    return out.select((F.col("doc_id") * 10000 + F.col("chunk_index")).alias("chunk_id"), "doc_id", "path", "language", "is_test", "source", "chunk_index", start.alias("start_line"), F.least(start + LINES, F.col("n")).alias("end_line"), token_estimate(content).alias("token_count"), content.alias("content"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), F.col("p_size").cast("long").alias("file"), F.when(F.col("p_partkey") % 2 == 0, "O").otherwise("F").alias("language"), (F.col("p_partkey") % 97).cast("int").alias("line"))


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, kind, language), repeats included."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = t(spark, d, "lineitem").where("l_quantity >= 48")
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("language")).where("dst is not null")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return raw_edges(spark, d).select("src", "dst", "kind").distinct()


def diffs(spark: SparkSession, d: str) -> DataFrame:
    kept = F.col("l_returnflag") == "N"
    lines = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(kept, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("added"), F.sum(F.when(kept, 0.0).otherwise(F.col("l_quantity"))).cast("long").alias("removed"))
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("diff_id"), F.col("o_custkey").alias("file_id"), F.col("o_orderdate").alias("ts"))
    return orders.join(lines, F.col("diff_id") == F.col("l_orderkey")).drop("l_orderkey")


#: Full-text indexes of this process: (application, folder, file's size and time) -> where it is stored.
INDEXES: dict[tuple, str] = {}


def text_index(spark: SparkSession, d: str) -> Index:
    """The stored full-text index over `documents`, built on first use, and again when the file changes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    key = spark.sparkContext.applicationId, d, status.getLen(), status.getModificationTime()
    if key not in INDEXES:
        path = new_folder(spark)
        Index.build(files(spark, d).select("doc_id", "path", "is_test", "text"), path, keep=["path", "is_test"])
        INDEXES[key] = path
    return Index(spark, INDEXES[key])


CTE = {
    "files": """files AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || CASE WHEN doc_id % 10 = 0 THEN '_test' ELSE '' END || '.txt' AS path,
 lang AS language, doc_id % 10 = 0 AS is_test, source, text, n_chars FROM documents)""",
    "lines": f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "chunks": f"""chunks AS (SELECT doc_id * 10000 + i AS chunk_id, doc_id, path, language, is_test, source, CAST(i AS INTEGER) AS chunk_index, CAST(i * {LINES} + 1 AS INTEGER) AS start_line,
 CAST(least(i * {LINES} + 1 + {LINES}, n) AS INTEGER) AS end_line, CAST(octet_length(encode(content)) // 4 AS INTEGER) AS token_count, content FROM (
 SELECT f.*, i, len(l) AS n, array_to_string(l[i * {LINES} + 1 : i * {LINES} + {LINES} + 1], chr(10)) AS content
 FROM files f JOIN lines USING (doc_id), unnest(range(0, (len(l) - 1) // {LINES} + 1)) AS u(i)))""",
    "symbols": """symbols AS (SELECT p_partkey AS symbol_id, p_brand AS name, p_type AS kind, CAST(p_size AS BIGINT) AS file,
 CASE WHEN p_partkey % 2 = 0 THEN 'O' ELSE 'F' END AS language, CAST(p_partkey % 97 AS INTEGER) AS line FROM part)""",
    "raw_edges": """raw_edges AS (SELECT src, dst, kind, language FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst, l_returnflag AS kind, l_linestatus AS language FROM lineitem WHERE l_quantity >= 48) WHERE dst IS NOT NULL)""",
    "edges": "edges AS (SELECT DISTINCT src, dst, kind FROM raw_edges)",
    "diffs": """diffs AS (SELECT o_orderkey AS diff_id, o_custkey AS file_id, o_orderdate AS ts, added, removed FROM orders JOIN (
 SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS added,
 CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_quantity END) AS BIGINT) AS removed FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "tok": r"tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)",
}
NEEDS = {"chunks": ["files", "lines"], "edges": ["raw_edges"]}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """The query over the named views; `body` may begin with further CTEs, parted from the query by a line `--`."""
    names = list(dict.fromkeys(n for v in views for n in [*NEEDS.get(v, []), v]))
    ctes = [CTE[n] for n in names]
    head, _, query = body.rpartition("\n--\n")
    ctes += [head] if head.strip() else []
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" if ctes else "") + query
