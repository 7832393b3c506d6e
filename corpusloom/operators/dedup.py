"""Keep-first deduplication, caps and components. The kept row is chosen by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.staging import forget, stored


def keep_first(rows: DataFrame, keys: list[Column | str], order: list[Column | str], most: int = 1) -> DataFrame:
    """The first `most` rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def keep_one(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the least order value, by partial aggregation: no key's rows meet in one task.

    `order` is unique within a key. Only (key, order) is aggregated; the rows are then filtered.
    """
    least = rows.groupBy(key).agg(F.min(order).alias("__least"))
    return rows.join(least, key).where(F.col(order) == F.col("__least")).drop("__least")


def mark_duplicates(rows: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """Adds seen_before: whether an earlier row has the same key."""
    return rows.withColumn("seen_before", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def cap(rows: DataFrame, keys: list[Column | str], order: list[Column | str], most: int) -> DataFrame:
    """At most `most` rows of each key; rows with a null key are not capped."""
    nothing = F.lit(False)
    for k in keys:
        nothing = nothing | (F.col(k) if isinstance(k, str) else k).isNull()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__rank", F.when(nothing, 0).otherwise(rank)).where(F.col("__rank") <= most).drop("__rank")


def either_key_unique(rows: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Rows that are the first of both of their keys."""
    one = F.row_number().over(Window.partitionBy(first).orderBy(order))
    two = F.row_number().over(Window.partitionBy(second).orderBy(order))
    return rows.withColumn("__one", one).withColumn("__two", two).where("__one = 1 and __two = 1").drop("__one", "__two")


def problems_once(rows: DataFrame, problem: Column, title: Column, description: Column, order: str) -> DataFrame:
    """Rows whose problem id, or without one whose title, and whose description come for the first time.

    The first stage keeps the least order of each problem, the second of each description among these.
    """
    named = F.coalesce(F.when(problem != "", F.concat(F.lit("id:"), problem)), F.concat(F.lit("title:"), F.md5(title)))
    first = keep_one(rows.withColumn("__problem", named), "__problem", order)
    return keep_one(first.withColumn("__text", F.md5(description)), "__text", order).drop("__problem", "__text")


def distinct_in_order(items: Column, most: int) -> Column:
    return F.slice(F.array_distinct(items), 1, most)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it is joined to) over edges a, b.

    Roots spread to neighbours and jump to their root's root until none moves; each round is stored, and
    the one before it deleted.
    """
    ways = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    now = stored(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = ways.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        then = stored(spread.join(now.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", "old", F.col("far").alias("root")), "roots")
        still = then.where("old != root").isEmpty()
        forget(now)
        now = then
        if still:
            forget(ways)
            return now.select("node", "root")
