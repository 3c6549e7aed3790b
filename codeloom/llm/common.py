"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Texts are handed to native tokenizers in slices of at most this many characters (one text at least).
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer splits than there are cores; as it is otherwise, so large tables aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold: long texts make batches of 10,000 rows too large for a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a local session gets a temporary one; a cluster has to name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="codeloom-"))
    return sc.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written here go at once: its result lies in the shared folder, so nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # A plan reads the setting when its DataFrame is made, so this needs one of its own.
        return df.select("*").checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table of the shared folder, and its path; compressed, unlike a checkpoint, and `discard` removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark sizes what comes from an explode or from Python by the rows that
    went in, so it would broadcast tables many times larger than its limit; every side that grows with the input goes by key."""
    return df.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts that hold at most `limit` characters together, or one text."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def strings(column: pa.Array) -> list[str]:
    """Values of a string column, null as empty."""
    return [x or "" for x in column.to_pylist()]
