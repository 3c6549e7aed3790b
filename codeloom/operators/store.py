"""Snapshot tables: every change is a new DataFrame, committed by swapping a pointer."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "file_id") -> dict[str, DataFrame]:
    """Tables without the rows whose key is gone."""
    return {name: df.join(gone.select(key), key, "left_anti") if key in df.columns else df for name, df in tables.items()}


def mark_embedded(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    flag = done.select(key, F.lit(True).alias("__done")).distinct()
    return chunks.join(flag, key, "left").withColumn("embedded", F.col("embedded") | F.coalesce("__done", F.lit(False))).drop("__done")


def reset_embedded(chunks: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks, not embedded any more where their vectors are gone."""
    flag = gone.select(key, F.lit(True).alias("__gone")).distinct()
    return chunks.join(flag, key, "left").withColumn("embedded", F.col("embedded") & F.col("__gone").isNull()).drop("__gone")


def page(rows: DataFrame, key: str, after=None, limit: int = 256) -> DataFrame:
    """Keys beyond the last one seen, in order: a page of a scan that can be resumed."""
    return (rows if after is None else rows.where(F.col(key) > after)).select(key).orderBy(key).limit(limit)


def embedding_status(chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, remaining, embedding_status)."""
    left = F.count_if(~F.col("embedded"))
    return chunks.groupBy(key).agg(left.alias("remaining"), F.when(left == 0, "complete").when(F.count_if("embedded") > 0, "partial").otherwise("pending").alias("embedding_status"))


def changed(scanned: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    """Scanned files that are new or whose hash differs."""
    old = known.select(key, F.col("content_hash").alias("__old"))
    return scanned.join(old, key, "left").where(~F.col("content_hash").eqNullSafe(F.col("__old"))).drop("__old")


def update_parents(chunks: DataFrame, parents: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunks whose parent is taken from parents(key, parent) where that has one."""
    new = parents.groupBy(key).agg(F.min("parent").alias("__parent"))
    return chunks.join(new, key, "left").withColumn("parent", F.coalesce("__parent", "parent")).drop("__parent")


class Store:
    """Parquet tables under one root of any Hadoop file system, and a pointer file that names each table's folders.

    Tables with a path are kept in PARTS parts by its hash, so a commit writes the parts that changed alone; logs grow by a
    folder a commit. Folders that the pointer no longer names stay for one more commit, for those who still read them.
    """

    PARTS = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path())

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    @property
    def pointer(self) -> dict:
        """{"serial": number of commits, "tables": {name: {part: folder}}, "old": folders that went out of use last}"""
        if not self.fs.exists(self._path("CURRENT.json")):
            return {"serial": 0, "tables": {}, "old": []}
        stream = self.fs.open(self._path("CURRENT.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _point(self, pointer: dict) -> None:
        stream = self.fs.create(self._path("CURRENT.tmp"), True)
        stream.write(bytearray(json.dumps(pointer).encode()))
        stream.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self.fs.makeQualified(self._path("CURRENT.tmp")), self.fs.makeQualified(self._path("CURRENT.json")), how)

    def read(self, table: str, parts: list[int] | None = None) -> DataFrame | None:
        """The table, or some parts of it; None if there's none (an empty table if only the parts are missing)."""
        folders = self.pointer["tables"].get(table)
        if folders is None:
            return None
        chosen = [f for p, f in folders.items() if parts is None or p in {str(x) for x in parts}]
        if not chosen:
            return self.spark.read.parquet(f"{self.root}/{next(iter(folders.values()))}").limit(0)
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in chosen])

    @classmethod
    def part(cls, path: str = "path"):
        return F.pmod(F.xxhash64(path), F.lit(cls.PARTS)).cast("int")

    def commit(self, tables: dict[str, DataFrame], parts: list[int] | None = None, append: tuple[str, ...] = ()) -> None:
        """All or nothing: folders are written beside what is read, then the pointer is replaced.

        Tables are replaced whole; with `parts`, those with a path only in these parts, of which df holds all rows; those in
        `append` get df's rows besides what they have.
        """
        pointer = self.pointer
        serial, tables_now, out_of_use = pointer["serial"] + 1, {k: dict(v) for k, v in pointer["tables"].items()}, []
        for name, df in tables.items():
            own = tables_now.get(name, {})
            if name in append:
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{serial}")
                tables_now[name] = own | {f"v{serial}": f"{name}/v{serial}"}
            elif parts is not None and "path" in df.columns and name in tables_now and "whole" not in own:
                df.withColumn("__part", self.part()).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{self.root}/{name}/v{serial}")
                out_of_use += [f for p, f in own.items() if int(p) in parts]
                kept = {p: f for p, f in own.items() if int(p) not in parts}
                tables_now[name] = kept | self._parts(name, serial) or self._empty(name, serial, df.schema)
            elif "path" in df.columns:
                df.withColumn("__part", self.part()).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{self.root}/{name}/v{serial}")
                out_of_use += own.values()
                tables_now[name] = self._parts(name, serial) or self._empty(name, serial, df.schema)
            else:
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{serial}")
                out_of_use += own.values()
                tables_now[name] = {"whole": f"{name}/v{serial}"}
        self._point({"serial": serial, "tables": tables_now, "old": out_of_use})
        for folder in pointer["old"]:
            self.fs.delete(self._path(folder), True)

    def _parts(self, name: str, serial: int) -> dict[str, str]:
        return {str(p): f"{name}/v{serial}/__part={p}" for p in range(self.PARTS) if self.fs.exists(self._path(f"{name}/v{serial}/__part={p}"))}

    def _empty(self, name: str, serial: int, schema) -> dict[str, str]:
        """A table without rows still has its columns."""
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}/v{serial}/__part=0")
        return {"0": f"{name}/v{serial}/__part=0"}

    def purge(self) -> None:
        """No tables, and no files of them."""
        pointer = self.pointer
        self._point({"serial": pointer["serial"], "tables": {}, "old": []})
        for name in pointer["tables"]:
            self.fs.delete(self._path(name), True)
