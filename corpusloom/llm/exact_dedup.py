"""Exact deduplication through cuckoo-filter indexes over text digests."""

from __future__ import annotations

from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.cuckoo import CuckooIndex
from corpusloom.llm.shared import keep_marked, stored, table, text_or_empty, trimmed

#: Digests that one index holds: some 100 MB of a worker.
MOST_LIVE = 200_000
SPACES = r"[\x20\x09-\x0D]"
INDEX_SCHEMA = "digest binary, norm_len long, n_rows long, best_len long, best_id long, best_uid long"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row per document: uid (a number of the row), its id, length, and normalised digest."""
    text = text_or_empty(text_col)
    norm = _normalised(text_col)
    return docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("long").alias("id"),
        F.char_length(text).cast("long").alias("n_chars"),
        F.char_length(norm).cast("long").alias("norm_len"),
        _digest(text_col).alias("digest"),
    )


def _normalised(text_col: str):
    return F.regexp_replace(text_or_empty(text_col), SPACES, "")


def _digest(text_col: str):
    return F.unhex(F.sha2(_normalised(text_col), 256))


def _better(a: tuple, b: tuple) -> bool:
    """(length, id, uid): the longer original stays, then the smaller id (null last), then the earlier row."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _index_part(batches, most: int = MOST_LIVE):
    """Feeds one partition to a cuckoo index and returns its live entries.

    An index of `most` entries is returned and another begun, between two different digests: where
    equal digests are neighbours this splits no group, and elsewhere a later index merges the parts.
    """
    index, last = CuckooIndex(), None
    for batch in batches:
        for digest, norm_len, n, *best in zip(*(batch.column(c).to_pylist() for c in ("digest", "norm_len", "n_rows", "best_len", "best_id", "best_uid")), strict=True):
            if index.size >= most and digest != last:
                yield from _entries(index)
                index = CuckooIndex()
            best, last = tuple(best), digest
            live = index.find(digest, norm_len)
            if live is None:
                index.insert(digest, norm_len, [n, best])
            elif _better(best, live[1]):
                index.delete(digest, norm_len)
                index.insert(digest, norm_len, [live[0] + n, best])
            else:
                live[0] += n
    yield from _entries(index)


def _entries(index: CuckooIndex):
    rows = ((d, w, n, *best) for d, w, (n, best) in index.entries())
    schema = pa.schema([("digest", pa.binary()), *((c, pa.int64()) for c in ("norm_len", "n_rows", "best_len", "best_id", "best_uid"))])
    while part := list(islice(rows, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def live_index(marks: DataFrame, most: int = MOST_LIVE) -> DataFrame:
    """The distinct digests with their row counts and the row that stays.

    Each input partition is indexed first, so a text with many copies sends one entry per partition
    to the partition of its digest, where a second index, fed in the order of digests, merges the
    entries. No index holds more than `most` digests.
    """
    own = marks.select("digest", "norm_len", F.lit(1).cast("long").alias("n_rows"), F.col("n_chars").alias("best_len"), F.col("id").alias("best_id"), F.col("uid").alias("best_uid"))
    part = lambda batches: _index_part(batches, most)
    return own.mapInArrow(trimmed(part), INDEX_SCHEMA).repartition("digest").sortWithinPartitions("digest").mapInArrow(trimmed(part), INDEX_SCHEMA)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: uid, id, n_chars, digest, keep_id, keep_uid, group_size, kept.

    Null texts count as empty and all empty texts are equal. Rows that repeat an id are rows of
    their own; exactly one row of each group is kept. An empty table gives no rows.
    """
    marks = stored(digests(docs, id_col, text_col), "digests")
    index = live_index(marks).select("digest", F.col("best_id").alias("keep_id"), F.col("best_uid").alias("keep_uid"), F.col("n_rows").alias("group_size"))
    return marks.join(index, "digest").withColumn("kept", F.col("uid") == F.col("keep_uid"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with exactly one row of each group of equal texts, columns unchanged whatever their names.

    Null texts count as empty, and empty texts are one group. Of rows equal in id and normalised text
    any one may stay if one of them does. No rows give no rows.
    """
    return keep_marked(docs, groups(docs, id_col, text_col), id_col, text_col, _digest(text_col))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""
