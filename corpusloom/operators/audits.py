"""Audits of published corpora: each recomputes what a table claims and counts the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import code as K
from corpusloom.functions import hashing as H
from corpusloom.operators import chat as C
from corpusloom.operators import filters as P
from corpusloom.operators.joins import gram_overlap


def report(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """check and n_bad, a row for each rule: how many rows break it, or leave it undecided. One pass."""
    counted = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.unpivot([], [F.col(n) for n in rules], "check", "n_bad")


def repeats(rows: DataFrame, *keys: str) -> DataFrame:
    """check and n_bad for each key: the rows beyond the first of each of its values (null is no value)."""
    counted = rows.agg(*[(F.count(k) - F.count_distinct(k)).alias(f"repeated_{k}") for k in keys])
    return counted.unpivot([], [F.col(f"repeated_{k}") for k in keys], "check", "n_bad")


def total_rules(rows: DataFrame, by: str, value: str, published: dict[str, int]) -> DataFrame:
    """check and n_bad for each published total: 0 if it is right, 1 if not; and the groups nobody published."""
    spark = rows.sparkSession
    claimed = spark.createDataFrame(list(published.items()), f"{by} string, __claimed long")
    sums = rows.groupBy(by).agg(F.sum(value).alias("__sum"))
    both = sums.join(F.broadcast(claimed), by, "full_outer")  # a row for each group
    return both.select(F.concat(F.lit("total_"), by).alias("check"), (~F.col("__sum").eqNullSafe(F.col("__claimed"))).cast("long").alias("n_bad"))


def pretrain_audit(rows: DataFrame, bench: DataFrame, sources: list[str], tokens: Column, most: int = 4096) -> DataFrame:
    """Rows doc_id, text, source, text_id, token_count, language: known sources, right ids, sizes and counts,
    Python that parses, no benchmark overlap, no text twice."""
    rules = {
        "known_source": F.col("source").isin(*sources),
        "text_not_empty": F.col("text") != "",
        "text_id": F.col("text_id") == H.stripped_key(F.col("text")),
        "token_count": F.col("token_count") == tokens,
        "token_range": F.col("token_count").between(1, most),
        "python_syntax": F.when(F.col("language") == "python", K.over("text", K.parses, "boolean")).otherwise(F.lit(True)),
    }
    met = gram_overlap(rows, "doc_id", F.col("text"), bench, F.col("text"))
    overlap = met.agg(F.lit("benchmark_overlap").alias("check"), F.count("*").alias("n_bad"))
    return report(rows, rules).unionByName(repeats(rows, "text_id")).unionByName(overlap)


def mix_audit(rows: DataFrame, prior: DataFrame, published: dict[str, int], least_quality: float) -> DataFrame:
    """The rules of a mixture: right tiers and totals, no credential, nothing of a prior corpus (text_id)."""
    rules = {"credential": ~P.credential(F.col("text")), "tier": F.col("quality") >= least_quality, "text_id": F.col("text_id") == H.stripped_key(F.col("text"))}
    old = rows.join(prior.select("text_id").distinct(), "text_id", "left_semi").agg(F.lit("prior_corpus").alias("check"), F.count("*").alias("n_bad"))
    return report(rows, rules).unionByName(repeats(rows, "text_id")).unionByName(old).unionByName(total_rules(rows, "source", "token_count", published))


def chat_audit(rows: DataFrame, tokens: Column, most: int = 3072, cap: int = 3) -> DataFrame:
    """Rows conv_id, messages, chat_id, reasoning (whether the row says it has some): ids, structure, sizes,
    repeated chats, prompts that come more often than the cap, and a majority with reasoning."""
    messages = F.col("messages")
    rules = {"valid": C.valid(messages), "chat_id": F.col("chat_id") == C.chat_key(messages), "tokens": tokens <= most, "reasoning": F.col("reasoning") == C.has_reasoning(messages)}
    often = rows.groupBy(C.first_prompt(messages).alias("p")).agg(F.count("*").alias("n")).agg(F.lit("prompt_cap").alias("check"), F.count_if(F.col("n") > cap).alias("n_bad"))
    half = rows.agg(F.lit("reasoning_majority").alias("check"), (F.count_if(F.col("reasoning")) * 2 <= F.count("*")).cast("long").alias("n_bad"))
    return report(rows, rules).unionByName(repeats(rows, "chat_id")).unionByName(often).unionByName(half)


def split_audit(train: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    """check and n_bad for each key: its values on both sides of a split."""
    out = None
    for k in keys:
        both = train.select(k).distinct().join(held.select(k).distinct(), k, "left_semi").agg(F.lit(f"leak_{k}").alias("check"), F.count("*").alias("n_bad"))
        out = both if out is None else out.unionByName(both)
    return out


def labels_audit(rows: DataFrame, most: int) -> DataFrame:
    """Training rows (input_ids, labels): as many labels as ids, within the length, some loss, and labels that are their ids."""
    pairs = F.arrays_zip(F.col("input_ids").alias("i"), F.col("labels").alias("l"))
    rules = {
        "same_length": F.size("input_ids") == F.size("labels"),
        "length": F.size("input_ids") <= most,
        "supervised": F.exists("labels", lambda x: x != -100),
        "labels": F.forall(pairs, lambda p: (p["l"] == -100) | (p["l"] == p["i"])),
    }
    return report(rows, rules)


def handoff_audit(batches: DataFrame, results: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Review results against what was handed out: all rows decided once, none unknown, decisions as allowed, texts unchanged."""
    counts = results.groupBy(key).agg(F.count("*").alias("n"), F.max("decision").alias("decision"), F.max("sha256").alias("got"))
    both = batches.select(key, F.col("sha256").alias("sent")).join(counts, key, "full_outer")
    rules = {
        "decided": F.col("sent").isNull() | F.col("n").isNotNull(),
        "once": F.coalesce("n", F.lit(1)) <= 1,
        "known": F.col("sent").isNotNull(),
        "allowed": F.col("n").isNull() | F.col("decision").isin(*allowed),
        "unchanged": F.col("n").isNull() | F.col("sent").isNull() | (F.col("sent") == F.col("got")),
    }
    return report(both, rules)
