"""Samples, budgets, mixtures, shuffles and splits. Random choices follow hashes of row keys."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.sources.staging import forget, stored


def top_by_hash(rows: DataFrame, k: int, seed: int | str, *key: Column, by: list[str] | None = None) -> DataFrame:
    """k rows, uniform over all (or over each group): the least priorities."""
    rows = rows.withColumn("__p", H.priority(seed, *key))
    if not by:
        return rows.orderBy("__p").limit(k).drop("__p")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__p"))
    return rows.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r", "__p")


def exact_share(rows: DataFrame, share: float, seed: int | str, *key: Column) -> DataFrame:
    """round(n * share) rows, uniform."""
    return top_by_hash(rows, round(rows.count() * share), seed, *key)


def running_total(rows: DataFrame, by: list[str], order: str, value: str, into: str, slices: int = 64) -> DataFrame:
    """Adds the sum of value up to each row in the order of a hex key, without one task for a group.

    The key's first byte cuts a group into slices; sums within slices and sums of earlier slices add
    up to the running total. Rows without a key come last.
    """
    cut = F.coalesce(F.floor(F.conv(F.substring(order, 1, 2), 16, 10).cast("int") * slices / 256).cast("int"), F.lit(slices))
    rows = rows.withColumn("__s", cut)
    own = F.sum(value).over(Window.partitionBy(*by, "__s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    totals = rows.groupBy(*by, "__s").agg(F.sum(value).alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*by, "__s", before.alias("__before"))
    return rows.withColumn("__own", own).join(totals, [*by, "__s"]).withColumn(into, F.col("__own") + F.col("__before")).drop("__s", "__own", "__before")


def nearest_boundary(rows: DataFrame, by: str, order: str, size: str, target: int) -> DataFrame:
    """Whole rows in order up to a size target; the crossing row counts only if that ends nearer to it."""
    total = running_total(rows, [by], order, size, "__total")
    before = F.col("__total") - F.col(size)
    crossing = (before <= target) & (F.col("__total") > target)
    nearer = F.abs(F.col("__total") - target) < F.abs(before - target)
    return total.where((F.col("__total") <= target) | (crossing & nearer)).drop("__total")


def greedy_fill(rows: DataFrame, by: str, key: str, order: str, size: str, budgets: dict[str, int]) -> DataFrame:
    """Rows of each category that fit its budget, taken in the order of a hex key; one that doesn't fit is skipped.

    All rows before the first that doesn't fit are taken, and running totals by slice tell which these
    are. Later ones depend on every choice before, so those that can fit the room that is left pass one
    task a category, as (category, key, order, size); rows are fetched by these afterwards, as many of
    like ones as were taken. Rows without a size or a category are not taken, those without an order come
    last, and a size below 0 gives room back.
    """
    row = [by, key, order, size]

    def take(batches):
        left: dict = {}
        for batch in batches:
            keep = []
            for b, n, room in zip(*(batch.column(c).to_pylist() for c in (by, size, "room")), strict=True):
                room = left.setdefault(b, room)
                keep.append(n <= room)
                if keep[-1]:
                    left[b] = room - n
            yield batch.select(row).filter(pa.array(keep, pa.bool_()))

    budgets = {k: v for k, v in budgets.items() if k is not None}
    if not budgets:
        return rows.limit(0)
    budget = F.element_at(F.create_map(*[x for k, v in budgets.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col(by))
    own = rows.select(*row).where(F.col(by).isin(*budgets) & F.col(size).isNotNull())
    whole = own.schema[size].dataType.typeName() in ("byte", "short", "integer", "long")
    own = own.withColumn("__wide", F.col(size).cast("decimal(38,0)") if whole else F.col(size))  # sums may pass 2**63, choices don't
    total = running_total(own, [by], order, "__wide", "__total").drop("__wide").withColumn("__budget", budget)
    totals = stored(total, "totals")
    total = totals.withColumn("__at", F.coalesce(order, F.lit("~")))
    # Broadcast, because a join that hashes by category itself would do away with the repartition below, and
    # adaptive execution may then deal a category to several tasks, each with the whole room.
    cross = total.groupBy(by).agg(F.min(F.when(F.col("__total") > F.col("__budget"), F.col("__at"))).alias("__cross"))
    early = F.col("__cross").isNull() | (F.col("__at") < F.col("__cross"))
    total = total.join(F.broadcast(cross), by).withColumn("__early", early)
    used = F.coalesce(F.sum(F.when(F.col("__early"), F.col(size))), F.lit(0))
    back = F.coalesce(F.sum(F.when(~F.col("__early") & (F.col(size) < 0), -F.col(size))), F.lit(0))
    rooms = total.groupBy(by).agg((F.first("__budget") - used).alias("room"), back.alias("__back"))
    rest = total.where(~F.col("__early")).join(F.broadcast(rooms), by).where(F.col(size) <= F.col("room") + F.col("__back"))
    narrow = rest.select(*row, "__at", "room").repartition(by).sortWithinPartitions(by, "__at", size, key)
    later = narrow.select(*row, "room").mapInArrow(take, own.select(*row).schema)
    taken = total.where("__early").select(*row).unionByName(later)
    taken = stored(taken.groupBy(F.struct(*row).alias("__row")).agg(F.count("*").alias("__taken")), "taken")  # a small one is then broadcast
    forget(totals)
    like = F.row_number().over(Window.partitionBy("__row").orderBy("__taken"))
    found = rows.withColumn("__row", F.struct(*row)).join(taken, "__row").withColumn("__like", like)
    return found.where(F.col("__like") <= F.col("__taken")).drop("__row", "__taken", "__like")


def chosen_then_rest(rows: DataFrame, by: str, key: str, chosen: Column, order: str, size: str, budgets: dict[str, int]) -> DataFrame:
    """Fills budgets with chosen rows first and then with the others, each in the order of a hex key."""
    own = rows.withColumn("__o", F.concat(F.when(F.coalesce(chosen, F.lit(False)), "0").otherwise("f"), F.col(order)))
    return greedy_fill(own, by, key, "__o", size, budgets).drop("__o")


def balanced_then_fill(rows: DataFrame, by: str, key: str, order: str, size: str, each: int, target: int) -> DataFrame:
    """Adds pass: 1 for rows within the same budget for every domain, 2 for those that then fill the target.

    Both passes go in the order of a hex key and skip what does not fit.
    """
    domains = {r[0]: each for r in rows.select(by).distinct().collect()}  # a row for each domain
    first = stored(greedy_fill(rows, by, key, order, size, domains).withColumn("pass", F.lit(1)), "first-pass")
    used = first.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    rest = rows.join(first.select(key), key, "left_anti").withColumn("__all", F.lit("all"))
    second = greedy_fill(rest, "__all", key, order, size, {"all": max(0, target - used)}).drop("__all").withColumn("pass", F.lit(2))
    return first.unionByName(second)


def banded_fill(rows: DataFrame, key: str, length: str, order: str, size: str, bounds: list[int], target: int, special: Column, most_special: float) -> DataFrame:
    """Rows up to a target, those of the longer bands first and special ones only up to their share of it.

    bounds are the least lengths of the bands, longest first; order is a hex key within a band. Special
    rows have a budget of their own, so that the others fill what it leaves.
    """
    band = F.lit(len(bounds))
    for n, least in reversed(list(enumerate(bounds))):
        band = F.when(F.col(length) >= least, F.lit(n)).otherwise(band)
    own = rows.withColumn("__o", F.concat(F.lpad(F.hex(band.cast("long") * F.lit(256 // (len(bounds) + 1))), 2, "0"), F.col(order))).withColumn("__kind", F.when(special, "special").otherwise("plain"))
    some = int(target * most_special)
    first = stored(greedy_fill(own, "__kind", key, "__o", size, {"special": some}), "special")
    used = first.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    plain = greedy_fill(own, "__kind", key, "__o", size, {"plain": target - used})
    return first.unionByName(plain).drop("__o", "__kind")


def capped_candidates(rows: DataFrame, flag: Column, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` flagged rows, and the counts of all rows and all flagged ones: the cap stops no count."""
    some = F.coalesce(flag, F.lit(False))
    return rows.where(some).orderBy(order).limit(most), rows.agg(F.count("*").alias("n_rows"), F.count_if(some).alias("n_flagged"))


def same_rows(a: DataFrame, b: DataFrame, size: str) -> bool:
    """Whether two orders of a corpus have as many rows, the same sizes in all, and the same rows as a set of hashes."""
    sums = lambda df: df.agg(F.count("*"), F.sum(size), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(20,0)"))).first()
    return sums(a) == sums(b)


def placed(rows: DataFrame, into: str = "position") -> DataFrame:
    """Adds the place of each row in the order of the partitions: (partition, number in it), as one struct."""
    marked = rows.withColumn("__id", F.monotonically_increasing_id())
    where = F.struct(F.shiftright("__id", 33).alias("part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("number"))
    return marked.withColumn(into, where).drop("__id")


def balanced_pairs(one: DataFrame, two: DataFrame, order: str, size: str, base_rows: int, base_one: int, target: int) -> tuple[DataFrame, DataFrame]:
    """First a surplus of `one`, then equal pairs up to a size target, so that `one` ends above half."""
    surplus = max(1, math.ceil((11 * base_rows - 20 * base_one) / 9))
    rank = lambda df: running_total(df.withColumn("__one", F.lit(1)), [], order, "__one", "__n").drop("__one")
    a, b = rank(one), rank(two)
    used = a.where(F.col("__n") <= surplus).agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    pairs = a.where(F.col("__n") > surplus).select((F.col("__n") - surplus).alias("__n"), F.col(size).alias("x")).join(b.select("__n", F.col(size).alias("y")), "__n")
    total = total_by_number(pairs.withColumn("xy", F.col("x") + F.col("y")), "__n", "xy", "t").withColumn("t", F.col("t") + used)
    inside = (F.col("t") <= target) | (F.abs(F.col("t") - target) < F.abs(F.col("t") - F.col("x") - F.col("y") - target)) & (F.col("t") - F.col("x") - F.col("y") <= target)
    n = total.where(inside).count()
    return a.where(F.col("__n") <= surplus + n).drop("__n"), b.where(F.col("__n") <= n).drop("__n")


def quotas(available: dict[str, int], weights: dict[str, float], target: int, favoured: tuple[str, ...], least: float) -> dict[str, int]:
    """Weighted quotas; what sources lack goes to those with spare rows, favoured ones and larger spares first.

    The shortfall is laid along the spares in that order: each takes the part of it that falls on its
    own stretch. A surplus from rounding is taken off the first.
    """
    if sum(available.values()) < target:
        raise ValueError("not enough available for the target")
    t = pd.DataFrame({"name": list(weights), "have": [available.get(k, 0) for k in weights], "want": [round(target * w) for w in weights.values()]})
    t["quota"] = t[["have", "want"]].min(axis=1)
    t["spare"], t["late"] = t["have"] - t["quota"], ~t["name"].isin(favoured)
    t = t.sort_values(["late", "spare"], ascending=[True, False], kind="stable")
    lacking = target - t["quota"].sum()
    t["quota"] += (lacking - (t["spare"].cumsum() - t["spare"])).clip(lower=0, upper=t["spare"])
    if len(t):
        t.iloc[0, t.columns.get_loc("quota")] += min(lacking, 0)
    if t.loc[~t["late"], "quota"].sum() / target < least:
        raise ValueError("the favoured sources can't reach their share")
    return {k: int(t.loc[t["name"] == k, "quota"].iloc[0]) for k in weights}


def replay_rows(n: int, share: float) -> int:
    """Rows to add to n so that they are a share of the whole."""
    return round(n * share / (1 - share))


def common_unit(available: dict[str, int], ratio: dict[str, int]) -> int:
    """The largest unit so that every source gives its ratio of units."""
    return min(available[k] // r for k, r in ratio.items())


def shard_budget(target: int, index: int, count: int) -> int:
    """The cumulative budget after a shard."""
    return target * (index + 1) // count


def spaced(n: int, k: int, used: frozenset[int] = frozenset()) -> list[int]:
    """k evenly spaced numbers below n that are not used yet."""
    free = [i for i in range(n) if i not in used]
    k = min(k, len(free))
    return [free[i * len(free) // k] for i in range(k)] if k else []


def stride_order(n: int, step: int = 37) -> list[int]:
    """All numbers below n, each `step` after the last; n and the step must share no factor."""
    while math.gcd(n, step) != 1:
        step += 1
    return [i * step % n for i in range(n)]


def alternate(rows: DataFrame, by: str, order: str, first: list[str]) -> DataFrame:
    """Adds turn: rows of the groups in turn, the k-th of each (by a hex key) before any k+1-th."""
    place = F.array_position(F.array(*[F.lit(x) for x in first]), F.col(by))
    ranked = running_total(rows.withColumn("__one", F.lit(1)), [by], order, "__one", "__n")
    return ranked.withColumn("turn", (F.col("__n") - 1) * len(first) + place).drop("__one", "__n")


def shuffled(rows: DataFrame, seed: int | str, *key: Column) -> DataFrame:
    """All rows in a random order that is the same on every run: a range-partitioned external sort."""
    return rows.withColumn("__p", H.priority(seed, *key)).orderBy("__p").drop("__p")


def shuffled_parts(rows: DataFrame, seed: int | str, parts: int, *key: Column) -> DataFrame:
    """The same order over a number of sorted partitions."""
    return rows.withColumn("__p", H.priority(seed, *key)).repartitionByRange(parts, "__p").sortWithinPartitions("__p").drop("__p")


def numbered(rows: DataFrame, order: str, parts: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds row_number, from 0, in the order of a numeric column without ties, over all rows or within groups.

    Fixed cuts part the range; rows are numbered inside a part and offset by the counts before it, so
    neither the table nor a large group is numbered in one task.
    """
    cuts = sorted(set(rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)))
    part = F.lit(0)
    for c in cuts:
        part = part + (F.col(order) > c).cast("int")
    rows = rows.withColumn("__part", part)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over the parts' counts
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n")).select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__b"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(order)) - 1
    found = rows.withColumn("__i", inside).join(counts if by else F.broadcast(counts), [*by, "__part"])
    return found.withColumn("row_number", F.col("__i") + F.col("__b")).drop("__part", "__i", "__b")


def total_by_number(rows: DataFrame, number: str, value: str, into: str, width: int = 100_000) -> DataFrame:
    """Adds the sum of value up to each row in the order of a row number, slice by slice."""
    rows = rows.withColumn("__s", F.floor(F.col(number) / width))
    own = F.sum(value).over(Window.partitionBy("__s").orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("__t").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("__s").agg(F.sum(value).alias("__t")).select("__s", before.alias("__b"))
    return rows.withColumn("__o", own).join(totals, "__s").withColumn(into, F.col("__o") + F.col("__b")).drop("__s", "__o", "__b")


def mixing_windows(rows: DataFrame, position: str, category: str, tokens: str, total: int, windows: int, width: int) -> DataFrame:
    """Token shares by category in evenly spaced windows of contiguous rows."""
    step = max(1, (total - width) // max(1, windows - 1))
    n = F.least(F.floor(F.col(position) / step), F.lit(windows - 1)).cast("int")
    inside = rows.withColumn("window", n).where(F.col(position) < F.col("window") * step + width)
    sums = inside.groupBy("window", category).agg(F.sum(tokens).alias("tokens"))
    return sums.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("window")))


def stratified(rows: DataFrame, by: str, k: int, seed: int | str, key: str) -> DataFrame:
    return top_by_hash(rows, k, seed, F.col(key), by=[by])


def units_in_budget(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Of a small table of units (unit, tokens) in order, those that fit a budget, each whole."""
    keep, left = [], budget
    for n in rows["tokens"]:
        keep.append(n <= left)
        left -= n * keep[-1]
    return rows[keep]
