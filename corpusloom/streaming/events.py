"""Structured Streaming forms: windows with late data, sessions, rates, and sinks that happen once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16, kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; how many a trigger takes bounds its work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def tumbling(rows: DataFrame, ts: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and key, over a table or a stream (late: how long rows are waited for)."""
    rows = rows.withWatermark(ts, late) if late else rows
    out = rows.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sliding(rows: DataFrame, ts: str, width: str, slide: str, by: list[str], value: str) -> DataFrame:
    out = rows.groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(rows: DataFrame, ts: str, gap: str, by: list[str]) -> DataFrame:
    """Runs of rows of a key with no gap that long."""
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "n")


def rolling_rate(rows: DataFrame, by: str, ts: str, value: str, seconds: int = 10, gap: int = 30) -> DataFrame:
    """Adds rate: value per second over the last `seconds`, begun anew after a gap."""
    when = F.unix_micros(F.col(ts).cast("timestamp"))
    own = Window.partitionBy(by).orderBy(when)
    fresh = (when - F.lag(when).over(own) > gap * 1_000_000).cast("int")
    run = rows.withColumn("__t", when).withColumn("__run", F.sum(F.coalesce(fresh, F.lit(0))).over(own))
    recent = Window.partitionBy(by, "__run").orderBy("__t").rangeBetween(-seconds * 1_000_000, 0)
    return run.withColumn("rate", F.sum(value).over(recent) / seconds).drop("__t", "__run")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose key has not come within the watermark: a rescan adds nothing twice."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Runs over all files there are, then stops. A batch done before a failure is not written again."""
    query = transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()


def each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str):
    """Calls action on every micro-batch with its number, which comes again if the batch is retried."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(done: int, total: int, seconds: float) -> dict[str, float | None]:
    """Share done, rate and seconds left, counted since the run resumed."""
    rate = done / seconds if seconds > 0 else None
    return {"share": done / total if total else None, "rate": rate, "left": (total - done) / rate if rate else None}


def token_timing(rows: DataFrame, request: str, ts: str, started: str) -> DataFrame:
    """Per request: milliseconds to the first token and between tokens; null where unmeasured."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = rows.groupBy(request).agg(F.min(us(ts)).alias("a"), F.max(us(ts)).alias("b"), F.count(ts).alias("n"), F.min(us(started)).alias("s"))
    between: Column = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / 1000 / (F.col("n") - 1))
    return out.select(request, ((F.col("a") - F.col("s")) / 1000).alias("first_ms"), between.alias("per_token_ms"), F.col("n").alias("n_tokens"))
