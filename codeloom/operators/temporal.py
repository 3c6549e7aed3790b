"""Change history, sessions, and state over ordered logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def symbol_diff(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """(key, change) of rows with signature and line: added, removed, signature_changed, modified; unchanged ones have no row."""
    o = old.select(key, F.col("signature").alias("os"), F.col("line").alias("ol"), F.lit(True).alias("was"))
    n = new.select(key, F.col("signature").alias("ns"), F.col("line").alias("nl"), F.lit(True).alias("there"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("there").isNull(), "removed").when(~F.col("os").eqNullSafe(F.col("ns")), "signature_changed").when(F.col("ol") != F.col("nl"), "modified")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def bursts(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Debouncing: events of a key that follow within the gap are one burst; (key, burst_end, n, last of each)."""
    w = W.partitionBy(key).orderBy(ts, "event_id")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = events.withColumn("__new", (F.coalesce(at - F.lag(at).over(w), F.lit(1 << 60)) > int(gap_seconds * 1e6)).cast("int"))
    marked = marked.withColumn("burst", F.sum("__new").over(w))
    return marked.groupBy(key, "burst").agg(F.count("*").alias("n"), F.max(ts).alias("burst_end"), F.max_by("event_id", F.struct(ts, "event_id")).alias("last_event"))


def call_metrics(calls: DataFrame, tool: str, ts: str, took: str, slow_over: float) -> DataFrame:
    """(hour, tool, calls, slow, mean) of tool calls."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")
    return calls.groupBy(hour, F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), F.count_if(F.col(took) > slow_over).alias("slow"), F.round(F.avg(took), 6).alias("mean"))


def flush_batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """rows with the number of the batch of `size` in which a writer that gathers them by key would write each."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / size).cast("long"))


BREAKER = "struct<state:string,failures:int,cooldown:double,opened:double>"


def breaker(log, failures: int = 3, base: float = 5.0, most: float = 60.0):
    """log: ordered array of struct(minute double, ok boolean) -> array of the state after each call (a call while open is
    refused and counts for nothing). Cooldown doubles at every opening, the first included."""
    start = F.struct(F.lit("closed").alias("state"), F.lit(0).alias("failures"), F.lit(base).alias("cooldown"), F.lit(0.0).alias("opened"))

    def state(s, f, c, o):
        return F.struct(s.alias("state"), f.alias("failures"), c.alias("cooldown"), o.alias("opened"))

    def step(acc, e):
        a = acc["now"]
        cooled = (a["state"] == "open") & (e["minute"] - a["opened"] > a["cooldown"])
        probing = cooled | (a["state"] == "half_open")
        refused = (a["state"] == "open") & ~cooled
        opened = state(F.lit("open"), F.lit(0), F.least(a["cooldown"] * 2, F.lit(most)), e["minute"])
        failed = F.when(probing | (a["failures"] + 1 >= failures), opened).otherwise(state(F.lit("closed"), a["failures"] + 1, a["cooldown"], a["opened"]))
        now = F.when(refused, a).when(e["ok"], state(F.lit("closed"), F.lit(0), F.lit(base), F.lit(0.0))).otherwise(failed)
        return F.struct(now.alias("now"), F.array_append(acc["out"], now["state"]).alias("out"))

    return F.aggregate(log, F.struct(start.alias("now"), F.expr("cast(array() as array<string>)").alias("out")), step, lambda a: a["out"])
