"""Whole corpus builds, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators import joins as J
from corpusloom.operators import sampling as S
from corpusloom.sources.staging import stored


def screened(docs: DataFrame, bench: DataFrame, prior_keys: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with outcome: the first of text_quality, duplicate_text, prior_corpus, benchmark_overlap, or keep.

    Copies and prior texts are told by the digest of the stripped text; of copies the least key stays.
    `prior_keys` has one column, stripped_key. Marks are made once and stored; the dearest test, the
    overlap, reads only what all others have let through.
    """
    marks = stored(docs.select(key, P.clean_text(F.col(text)).alias("__ok"), H.stripped_key(F.col(text)).alias("stripped_key")), "marks")
    first = marks.where("__ok").groupBy("stripped_key").agg(F.min(key).alias("__first"))
    both = marks.join(first, "stripped_key", "left")
    rules: list[tuple[str, Column]] = [("text_quality", ~F.col("__ok")), ("duplicate_text", F.col(key) != F.col("__first"))]
    if prior_keys is not None:
        both = both.join(prior_keys.distinct().withColumn("__old", F.lit(True)), "stripped_key", "left")
        rules.append(("prior_corpus", F.col("__old")))
    known = stored(both.select(key, P.first_reason(*rules).alias("__why")), "reasons")
    rest = docs.select(key, text).join(known.where("__why IS NULL").select(key), key, "left_semi")
    met = J.gram_overlap(rest, key, F.col(text), bench, F.col(text)).withColumn("__met", F.lit(True))
    outcome = known.join(met, key, "left").select(key, F.coalesce("__why", F.when(F.col("__met"), "benchmark_overlap"), F.lit("keep")).alias("outcome"))
    return docs.join(outcome, key)


def mixture(kept: DataFrame, by: str, key: str, size: str, budgets: dict[str, int], seed: int) -> DataFrame:
    """Rows that fill each category's budget in a random order, with their place in the shuffled whole."""
    own = kept.withColumn("__fill", H.priority(seed, F.col(key)))
    taken = S.greedy_fill(own, by, key, "__fill", size, budgets).drop("__fill")
    placed = taken.withColumn("__p", H.priority(seed + 1, F.col(key))).withColumn("__one", F.lit(1))
    return S.running_total(placed, [], "__p", "__one", "position").withColumn("position", F.col("position") - 1).drop("__p", "__one")


def rescued(rows: DataFrame, first: Column, second: Column) -> DataFrame:
    """old_reason and new_reason where a second policy lets rows through that a first one dropped."""
    both = rows.withColumn("old_reason", first).withColumn("new_reason", second)
    return both.where(F.col("old_reason").isNotNull() & F.col("new_reason").isNull())


def leak_free_split(rows: DataFrame, roots: DataFrame, key: str, parts: int = 100, held: int = 1) -> DataFrame:
    """Adds held_out by the hash of each row's component (roots: node, root), so that no component is split."""
    joined = rows.join(roots.withColumnRenamed("node", key), key, "left")
    group = F.coalesce("root", F.col(key)).cast("string")
    return joined.withColumn("held_out", H.hash_bucket(F.sha2(group, 256), parts) < held).drop("root")


def next_fit(sizes: list[int], most: int, rows: int) -> list[int]:
    """The batch of each item of a short list: a batch ends before an item that would overfill it."""
    out, batch, used, n = [], 0, 0, 0
    for s in sizes:
        if n and (used + s > most or n >= rows):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + s, n + 1
    return out


def token_report(rows: DataFrame, by: str, text: str) -> DataFrame:
    """Rows, words and share of all words of each category."""
    sums = rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.sum(F.size(T.words(F.col(text)))).alias("tokens"))
    return sums.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))
