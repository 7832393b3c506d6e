"""Fixed-length training blocks: bucket choice, packing of whole examples, batches and compact rows."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sampling import running_total
from corpusloom.sources.staging import stored

#: A measured step of 28 rows of 1,024 tokens takes 0.56 s, of which 0.03 s are there for any step and a fifth of the rest is attention.
STEP_ROWS, STEP_LENGTH, STEP_SECONDS, STEP_FIXED, STEP_ATTENTION = 28, 1024, 0.56, 0.03, 0.20


def align(length: int, step: int) -> int:
    return -(-length // step) * step


class Rooms:
    """Blocks by the room that is left in them. A bit for each room that some block has finds the tightest fit."""

    def __init__(self):
        self.some, self.blocks = 0, defaultdict(list)

    def put(self, room: int, block: int) -> None:
        heapq.heappush(self.blocks[room], block)
        self.some |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The room and the lowest block of the least room that holds the size."""
        fitting = self.some >> size
        if not fitting:
            return None
        room = size + (fitting & -fitting).bit_length() - 1
        block = heapq.heappop(self.blocks[room])
        if not self.blocks[room]:
            self.some &= ~(1 << room)
        return room, block


def pack_lengths(lengths: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(block, segment, offset) of each whole example: longest first, each where the least room is left."""
    rooms, segments = Rooms(), []
    spots = {}
    for length, example in sorted(((n, k) for k, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
        room, block = rooms.take(length) or (capacity, len(segments))
        if block == len(segments):
            segments.append(0)
        spots[example] = (block, segments[block], capacity - room)
        segments[block] += 1
        rooms.put(room - length, block)
    return [spots[k] for k in range(len(lengths))]


def count_blocks(histogram: list[tuple[int, int]], capacity: int) -> int:
    """Blocks that best fit needs for (length, count) pairs."""
    rooms, total = {}, 0
    for n, count in sorted(histogram, reverse=True):
        while count:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                per = capacity // n
                full, part = divmod(count, per)
                total += full + (part > 0)
                for left, k in ((capacity - per * n, full), (capacity - part * n, int(part > 0))):
                    if k:
                        rooms[left] = rooms.get(left, 0) + k
                break
            put = min(count, rooms[room])
            count -= put
            rooms[room] -= put
            if not rooms[room]:
                del rooms[room]
            rooms[room - n] = rooms.get(room - n, 0) + put
    return total


def step_seconds(rows: int, length: int) -> float:
    """Time of one step, scaled from the measured one: attention grows with the square of the length."""
    times = (STEP_SECONDS - STEP_FIXED) * rows * length / (STEP_ROWS * STEP_LENGTH)
    return STEP_FIXED + times * (1 - STEP_ATTENTION + STEP_ATTENTION * length / STEP_LENGTH)


def bucket_seconds(blocks: int, length: int, batch: int) -> float:
    """Time of all steps of a bucket; the last one, if partial, counts at its own size."""
    whole, rest = divmod(blocks, batch)
    return whole * step_seconds(batch, length) + (step_seconds(rest, length) if rest else 0.0)


def bucket_bounds(histogram: dict[int, int], buckets: int, step: int = 16, budget: int = 28 * 1024) -> list[int]:
    """Upper length bounds of the buckets with the least estimated time.

    histogram has counts by length and comes from one aggregation, so its size is bounded by the
    number of different lengths.
    """
    merged: dict[int, int] = {}
    for n, c in histogram.items():
        merged[align(n, step)] = merged.get(align(n, step), 0) + c
    sizes = sorted(merged)
    if not sizes:
        return []
    buckets = min(buckets, len(sizes))
    cost: dict[tuple[int, int], float] = {}

    def interval(a: int, b: int) -> float:
        if (a, b) not in cost:
            top = sizes[b - 1]
            cost[a, b] = bucket_seconds(count_blocks([(s, merged[s]) for s in sizes[a:b]], top), top, max(1, budget // top))
        return cost[a, b]

    best = {0: (0.0, [])}
    for _ in range(buckets):
        then = {}
        for b in range(1, len(sizes) + 1):
            options = [(best[a][0] + interval(a, b), best[a][1] + [sizes[b - 1]]) for a in best if a < b]
            if options:
                then[b] = min(options, key=lambda o: o[0])
        best = then
    return best[len(sizes)][1]


def bucketed(rows: DataFrame, length: str, buckets: int, step: int = 16, into: str = "bucket") -> DataFrame:
    """Adds the bound of each row's bucket."""
    counts = {r[0]: r[1] for r in rows.groupBy(length).count().collect()}
    out = F.lit(None).cast("int")
    for b in reversed(bucket_bounds(counts, buckets, step)):
        out = F.when(F.col(length) <= b, F.lit(b)).otherwise(out)
    return rows.withColumn(into, out)


def pack_blocks(rows: DataFrame, key: str, length: str, order: str, capacity: int, group_rows: int = 2048) -> DataFrame:
    """key, length, pack_group, block, segment, offset: whole examples packed within groups of rows.

    Rows are dealt to groups by hash of the order column, about group_rows to each, so a group is
    bounded and groups are packed apart. Empty and longer examples are left out whole.
    """
    fit = stored(rows.where(F.col(length).between(1, capacity)).select(F.col(key), F.col(length).cast("int").alias("length"), F.col(order).alias("__order")), "lengths")
    groups = max(1, -(-fit.count() // group_rows))
    dealt = fit.withColumn("pack_group", F.pmod(F.xxhash64("__order"), F.lit(groups)).cast("int"))
    return _packed(dealt, key, ["pack_group"], lambda f: capacity)


def pack_buckets(rows: DataFrame, key: str, length: str, bucket: str, order: str, group_rows: int = 2048) -> DataFrame:
    """The same within buckets, whose bounds are the capacities: the rows of a bucket are taken in the
    order of a hex key, group_rows at a time."""
    fit = rows.where(F.col(length).between(1, F.col(bucket))).select(key, F.col(length).cast("int").alias("length"), F.col(bucket).alias("bucket"), F.col(order).alias("__order"))
    ranked = running_total(fit.withColumn("__one", F.lit(1)), ["bucket"], "__order", "__one", "__n").drop("__one")
    dealt = ranked.withColumn("pack_group", F.floor((F.col("__n") - 1) / group_rows).cast("int")).drop("__n")
    return _packed(dealt, key, ["bucket", "pack_group"], lambda f: int(f["bucket"].iloc[0]))


def _packed(dealt: DataFrame, key: str, groups: list[str], capacity) -> DataFrame:
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["__order", key])
        spots = pack_lengths(f["length"].tolist(), capacity(f))
        places = {name: [s[k] for s in spots] for k, name in enumerate(("block", "segment", "offset"))}
        return pd.DataFrame({key: f[key], "length": f["length"], **{g: f[g] for g in groups}, **places})

    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, "length", *groups)) + ", block int, segment int, offset int"
    return dealt.groupBy(*groups).applyInPandas(run, schema)


def loss_labels(ids: Column, mask: Column) -> Column:
    """Token ids where the mask holds, -100 elsewhere; the first token of each row never counts."""
    return F.transform(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda x, k: F.when(x["m"] & (k > 0), x["i"]).otherwise(F.lit(-100)))


def compact(segments: Column, labels: Column) -> Column:
    """Segment lengths and a loss mask instead of one segment number and label for each token."""
    kinds = F.array_distinct(segments)
    return F.struct(
        F.transform(kinds, lambda s: F.size(F.filter(segments, lambda x: x == s))).alias("segment_lengths"),
        F.transform(labels, lambda v: v != -100).alias("loss_mask"),
    )


def restore_segments(lengths: Column) -> Column:
    """The segment number of every token, from segment lengths."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def segment_positions(lengths: Column) -> Column:
    """Positions that begin at 0 in each segment."""
    return F.flatten(F.transform(lengths, lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))


def batches(rows: DataFrame, bucket: str, order: str, size: int) -> DataFrame:
    """Adds batch: the number of the batch within a bucket, in the order of a hex key, and batch_order: larger buckets first.

    Ranks come from running totals by slice, so no bucket is numbered in one task.
    """
    ranked = running_total(rows.withColumn("__one", F.lit(1)), [bucket], order, "__one", "__n").drop("__one")
    out = ranked.withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")
    counts = rows.groupBy(bucket).agg(F.ceil(F.count("*") / size).alias("__k"))  # a row for each bucket
    before = F.coalesce(F.sum("__k").over(Window.orderBy(F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(counts.select(bucket, before.alias("__b")))
    return out.join(first, bucket).withColumn("batch_order", F.col("__b") + F.col("batch") + 1).drop("__b")


def within(rows: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows of at most `most` tokens, whole; a count has the begin and end marks in it."""
    return rows.where(tokens <= most)
