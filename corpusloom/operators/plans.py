"""Chunk plans over sources, storage budgets and audits."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources import tables as Z


def chunk_plan(sizes: list[int], target: int) -> list[tuple[int, int]]:
    """(first row, end row) of chunks: one closes before the first row that begins at or past its target."""
    out, begin, at, start = [], 0, 0, 0
    for k, n in enumerate(sizes):
        if k > begin and at - start >= target:
            out.append((begin, k))
            begin, start = k, at
        at += n
    return out + [(begin, len(sizes))] if sizes else []


def group_plan(rows: list[int], sizes: list[int], target: int) -> list[tuple[int, int]]:
    """(first row, end row) of chunks of whole row groups that don't exceed a footprint; an oversized group is one."""
    out, begin, end, used = [], 0, 0, 0
    for n, size in zip(rows, sizes, strict=True):
        if end > begin and used + size > target:
            out.append((begin, end))
            begin, used = end, 0
        end += n
        used += size
    return out + [(begin, end)] if end > begin else out


def fixed_chunks(rows: DataFrame, number: str, width: int) -> DataFrame:
    """Adds chunk_index of equal row counts; a plan that needs no scan in order."""
    return rows.withColumn("chunk_index", F.floor(F.col(number) / width).cast("int"))


def chunk_report(rows: DataFrame, tokens: str, most: int) -> DataFrame:
    """start, end, rows and tokens (each row's capped) of every chunk of a table with row_number."""
    return rows.groupBy("chunk_index").agg(
        F.min("row_number").alias("start"), (F.max("row_number") + 1).alias("end"), F.count("*").alias("n_rows"), F.sum(F.least(F.col(tokens), F.lit(most))).alias("tokens")
    )


def valid_bounds(bounds: list[int], rows: int) -> bool:
    """Whether recorded boundaries rise and end with the last row."""
    return bool(bounds) and bounds[-1] == rows and all(a < b for a, b in zip([0, *bounds], bounds, strict=False))


def plan_key(files: list[tuple[str, int, int]], **settings) -> str:
    """The identity of a plan: its files (path, size, time of change) and settings; another file is another plan."""
    return hashlib.sha256(json.dumps([sorted(files), sorted(settings.items())]).encode()).hexdigest()


def cached_plan(spark: SparkSession, folder: str, key: str, make) -> list:
    """The plan kept under a key, or the one that `make` gives, which is then kept: published by one rename."""
    path = f"{folder}/{key}.json"
    if not _exists(spark, path):
        Z.write_report(spark, path, {"plan": make()})
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))["plan"]  # a chunk plan, a row for each chunk


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def steps_left(rows: DataFrame, batch: int, cursor: tuple[int, int]) -> DataFrame:
    """Rows (chunk_index, number in it) that a reader has not taken when it stops at (chunk, step); adds step."""
    stepped = rows.withColumn("step", F.floor(F.col("number") / batch).cast("int"))
    chunk, step = cursor
    return stepped.where((F.col("chunk_index") > chunk) | ((F.col("chunk_index") == chunk) & (F.col("step") >= step)))


def may_resume(old: dict, new: dict, free: tuple[str, ...] = ("path",)) -> list[str]:
    """What forbids going on with another run's state: settings that differ. The same corpus in another
    container is the same corpus; free settings may differ."""
    odd = [] if Z.source_key(old["path"]) == Z.source_key(new["path"]) else ["path"]
    return odd + sorted(k for k in {*old, *new} - {*free, "path"} if old.get(k) != new.get(k))


def paused(spark: SparkSession, marker: str) -> bool:
    """Whether a pause is asked for: a file with this name."""
    return _exists(spark, marker)


def stop_when_paused(query, marker: str, every: float = 1.0) -> bool:
    """Waits for a streaming query, and stops it between batches when a pause is asked for; True if it was."""
    while query.isActive:
        if paused(query.sparkSession if hasattr(query, "sparkSession") else SparkSession.active(), marker):
            query.stop()
            return True
        query.awaitTermination(every)
    return False


def must_stream(footprint: int, budget: int, factor: int = 4) -> bool:
    return footprint * factor > budget


def evict(files: DataFrame, budget: int) -> DataFrame:
    """Files to delete so that the rest fits a budget: by priority class, then the longest unused.

    files: path, size, priority, last_access, active. Active files stay.
    """
    order = Window.orderBy("priority", "last_access", "path")
    over = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] - budget
    idle = files.where(~F.col("active")).withColumn("freed", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return idle.where(F.coalesce("freed", F.lit(0)) < over).drop("freed")


def reserve(files: DataFrame, incoming: int, budget: int) -> DataFrame:
    """The files to delete so that incoming bytes fit a budget; an error if what may be deleted is not enough."""
    sums = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(F.col("active"), F.col("size"))), F.lit(0)).alias("active")).first()
    if sums["active"] + incoming > budget:
        raise ValueError(f"{incoming} bytes don't fit: active files hold {sums['active']} of {budget}")
    return evict(files, budget - incoming)


def cache_path(base: str, **config) -> str:
    """The place of a derived table: its name is the digest of what it is derived by."""
    return f"{base}/{hashlib.sha256(json.dumps(sorted(config.items())).encode()).hexdigest()[:32]}"


def cached_table(df: DataFrame, path: str) -> DataFrame:
    """The table at a path, written there if it is not: under another name first, so that it is whole once it is there."""
    spark = df.sparkSession
    if not _exists(spark, path):
        df.write.mode("overwrite").parquet(path + ".part")
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = jvm.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(jvm.Path(path + ".part"), where)
    return spark.read.parquet(path)


def quota_allows(used, incoming, total, ratio: float, reserved):
    return used + incoming <= total * ratio - reserved


def uploads(chunks: DataFrame, size: int) -> DataFrame:
    """Per file: parts received, whether any part came with different hashes, and whether all are there.

    chunks: file, index, length, sha, total.
    """
    parts = chunks.groupBy("file", "index").agg(F.count_distinct("sha").alias("k"), F.max("length").alias("length"), F.max("total").alias("total"))
    whole = parts.groupBy("file").agg(F.count("*").alias("n_parts"), F.sum("length").alias("bytes"), F.max("total").alias("total"), F.max("k").alias("k"))
    return whole.select("file", "n_parts", "bytes", (F.col("k") > 1).alias("conflict"), ((F.col("bytes") == F.col("total")) & (F.col("n_parts") == F.ceil(F.col("total") / size))).alias("complete"))


def best_source(parts: DataFrame, source: str, folder: str, tokens: str) -> DataFrame:
    """Of each source the folder that holds most of its tokens (ties: the least name), to recover it from."""
    sums = parts.groupBy(source, folder).agg(F.sum(tokens).alias(tokens))
    best = sums.groupBy(source).agg(F.max(tokens).alias(tokens))
    return sums.join(best, [source, tokens]).groupBy(source, tokens).agg(F.min(folder).alias(folder))


def audit(rows: DataFrame, checks: dict) -> dict[str, int]:
    """How many rows break each named condition, in one pass; nulls break it."""
    found = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]).first()
    return found.asDict()


def require(rows: DataFrame, checks: dict) -> None:
    bad = {k: v for k, v in audit(rows, checks).items() if v}
    if bad:
        raise ValueError(f"rows that fail: {bad}")
