"""Reports: counts, shares, percentiles, mixtures, pass rates and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the length report.
LENGTH_BOUNDS = [512, 1024, 2048, 4096, 8192, 16384, 32768, 65536]


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def with_share(rows: DataFrame, value: str, by: list[str] | None = None, into: str = "share") -> DataFrame:
    """Adds each row's part of the whole (or of its group's whole)."""
    return rows.withColumn(into, F.col(value) / F.sum(value).over(Window.partitionBy(*(by or [F.lit(1)]))))


def component_report(rows: DataFrame, by: str, text: str, tokens: Column) -> DataFrame:
    """Rows, tokens and bytes of each component."""
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), F.sum(tokens).alias("tokens"), F.sum(F.octet_length(text)).alias("bytes"))


def ranked_value(rows: DataFrame, by: str, value: str, share: float, into: str) -> DataFrame:
    """The value at place floor(n * share), from 0, of each group's sorted values; nothing is interpolated.

    Values are counted first, so a group's repeated values are one row each.
    """
    times = rows.groupBy(by, value).agg(F.count("*").alias("__n"))
    own = Window.partitionBy(by).orderBy(value)
    upto = times.withColumn("__c", F.sum("__n").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(by)))
    return upto.where(F.col("__c") > F.floor(F.col("__all") * share)).groupBy(by).agg(F.min(value).alias(into))


def length_bin(length: Column, bounds: list[int] | None = None) -> Column:
    """The least bound that holds a length; null above all."""
    out = F.lit(None).cast("int")
    for b in reversed(bounds or LENGTH_BOUNDS):
        out = F.when(length <= b, F.lit(b)).otherwise(out)
    return out


def length_census(rows: DataFrame, by: str, length: Column, most: int) -> DataFrame:
    below = F.sum((length <= most).cast("long"))
    return rows.groupBy(by).agg(F.count("*").alias("n_rows"), below.alias("n_below"), (F.count("*") - below).alias("n_above"))


def term_totals(rows: DataFrame, text: Column, pattern: str) -> DataFrame:
    found = rows.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("term"))
    return found.groupBy("term").agg(F.count("*").alias("n"))


def gram_frequency(rows: DataFrame, row_id: str, grams: Column, least: int) -> DataFrame:
    """Grams in `least` rows or more."""
    each = rows.select(row_id, F.explode(F.array_distinct(grams)).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)


def pass_at_k(rows: DataFrame, task: str, passed: str, k: int) -> DataFrame:
    """task, n, c and the unbiased chance that one of k samples passes; null where n < k."""
    per = rows.groupBy(task).agg(F.count("*").alias("n"), F.sum(F.col(passed).cast("long")).alias("c"))
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (F.col("n") - F.col("c") - i) / (F.col("n") - i))
    value = F.when(F.col("n") < k, F.lit(None).cast("double")).when(F.col("n") - F.col("c") < k, F.lit(1.0)).otherwise(1.0 - miss)
    return per.withColumn("pass_at_k", value)


def macro_accuracy(rows: DataFrame, task: str, passed: str) -> DataFrame:
    per = rows.groupBy(task).agg(F.avg(F.col(passed).cast("double")).alias("ratio"))
    return per.agg(F.count("*").alias("n_tasks"), F.avg("ratio").alias("accuracy"))


def failure_report(rows: DataFrame, task: str, passed: str, kind: str, output: str, examples: int = 2) -> DataFrame:
    """Of each task's failures by kind: how many, how many different outputs, and the commonest ones."""
    bad = rows.where(~F.col(passed)).groupBy(task, kind, F.sha2(output, 256).alias("h")).agg(F.count("*").alias("n"), F.min(output).alias("out"))
    ranked = bad.withColumn("r", F.row_number().over(Window.partitionBy(task, kind).orderBy(F.desc("n"), "h")))
    return ranked.groupBy(task, kind).agg(
        F.sum("n").alias("n_failed"), F.count("*").alias("n_outputs"), F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("out")))).alias("examples")
    )


def group_advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """Adds (reward - mean) / (population deviation + 1e-4) within each group.

    Mean and deviation are aggregated by partial sums and joined back.
    """
    stats = rows.groupBy(group).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__d"))
    return rows.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("__m")) / (F.col("__d") + 1e-4)).drop("__m", "__d")


def timing_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("max")
    )


def log_metrics(lines: DataFrame, order: str, text: str) -> DataFrame:
    """step, name, value of the last run in a training log: what follows the last line with `start`."""
    last = lines.where(F.col(text).contains("start")).agg(F.max(order)).first()[0]
    own = lines.where(F.col(order) > (last if last is not None else -1))
    step = F.regexp_extract(text, r"step\s*[:=]?\s*(\d+)", 1)
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]+)\s*[:=]\s*(-?\d+(?:\.\d+)?(?:e-?\d+)?)"), F.lit(0))
    each = own.where(step != "").select(step.cast("long").alias("step"), F.explode(pairs).alias("p"))
    return each.select("step", F.regexp_extract("p", r"^([A-Za-z_]+)", 1).alias("name"), F.regexp_extract("p", r"(-?[\d.]+(?:e-?\d+)?)$", 1).cast("double").alias("value"))


def profile(rows: DataFrame, checks: dict[str, Column], *by: str) -> DataFrame:
    """Rows of each group, and how many of them each named condition holds for."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])


def within_budgets(rows: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Of each domain: rows and sizes up to a budget, in the order of a hex key, and what there is in all."""
    from corpusloom.operators.sampling import running_total

    total = running_total(rows, [by], order, size, "__total")
    inside = F.col("__total") <= budget
    return total.groupBy(by).agg(F.count_if(inside).alias("n_rows"), F.coalesce(F.sum(F.when(inside, F.col(size))), F.lit(0)).alias("used"), F.sum(size).alias("available"))
