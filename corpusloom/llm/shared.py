"""What the operators share: tables in the cluster's shared folder, and the reading of inputs."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.staging import drop_stored, forget, shared_dir, stored, stored_count  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def text_slices(batch, column: str = "text", most: int = 4_000_000):
    """Cuts an Arrow batch into slices of about `most` bytes of text, one row at least."""
    ends = np.cumsum([x or 0 for x in pc.binary_length(batch[column]).to_pylist()])
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, side="right"))
        end = max(begin + 1, end)
        yield batch.slice(begin, end - begin)
        begin = end


def keep_marked(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """The rows of docs that marks (id, digest, kept; a row for each of docs) keep, columns unchanged.

    Rows are told apart by id, null or not, and by the digest of their text. Of several rows equal in
    both one stays if a mark keeps one.
    """
    keys = stored(marks.groupBy("id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("times")), "marks")
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("i"), digest.alias("d"), F.char_length(text_or_empty(text_col)).alias("size"))
    same = lambda t: F.col("i").eqNullSafe(t["id"]) & (F.col("d") == t["digest"])
    gone, again = keys.where(~F.col("kept")), keys.where(F.col("kept") & (F.col("times") > 1))
    rest = own.join(gone, same(gone), "left_anti")
    if again.isEmpty():
        return rest.select("row.*")
    once = rest.join(again, same(again), "left_anti")
    more = rest.join(again, same(again), "left_semi").groupBy("i", "d").agg(F.max_by("row", "size").alias("row"))
    return once.select("row.*").unionByName(more.select("row.*"))


def trimmed(run):
    """A function of Arrow batches that, when a task ends, gives the worker's freed memory back to the machine."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(ctypes.CDLL(None), "malloc_trim"):
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
