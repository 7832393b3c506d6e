"""Tables written once and read several times: in the cluster's shared folder, or on local[n] in one of our own."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on local[n], where it may be unset, one of our own.

    On a cluster there is no folder that we could set: executors would not share it, so that is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for df in tables:
        if df.stored_at in _WRITTEN:
            _WRITTEN.remove(df.stored_at)
            _delete(df.sparkSession, df.stored_at)


def stored_count() -> int:
    """How many stored tables there are: a mark for drop_stored."""
    return len(_WRITTEN)


def drop_stored(spark: SparkSession, since: int = 0, but: DataFrame | None = None) -> int:
    """Deletes the tables stored after a mark, but one; results that still read them are lost. Returns how many."""
    kept = getattr(but, "stored_at", None)
    gone = [path for path in _WRITTEN[since:] if path != kept]
    for path in gone:
        _WRITTEN.remove(path)
        _delete(spark, path)
    return len(gone)
