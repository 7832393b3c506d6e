"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.codepoints import joined, mix, word_keys
from corpusloom.llm.shared import forget, keep_marked, stored, table, text_or_empty, text_slices, trimmed

SHINGLE = 5
SIMILARITY = 0.8
#: At a similarity of 0.8 a pair shares no band with a chance of (1 - 0.8**5)**32, 3 in a million.
BANDS, ROWS = 32, 5
#: Shingles of a bucket's rows that are compared at once; a row counts as ROW_COST more.
BLOCK, ROW_COST = 1_000_000, 50
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STRIP = np.uint64(0xD1B54A32D192ED03)


def shingle_weights(texts: list[str], size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct 64-bit hashes of each text's word shingles, ascending, and their weights.

    Words are lower-cased and parted by white space. A text of fewer words than a shingle, but not
    none, has one shingle of all its words; a text without words has none. A shingle weighs 1, and 1
    more for each doubling of how often it comes: 1, 2, 2, 3, 3, 3, 3, 4 and so on.
    """
    points, bounds = joined([t.lower() for t in texts])
    points = points[1:]
    blank = (points == 32) | ((points >= 9) & (points <= 13)) | ((points >= 0x1C) & (points <= 0x1F)) | (points == 0x85) | (points == 0xA0) | (points == 0x3000) | ((points >= 0x2000) & (points <= 0x200A)) | (points == 0x2028) | (points == 0x2029)
    start, keys = word_keys(points, blank)
    at = np.searchsorted(start, bounds)
    rolled = np.zeros(max(0, len(keys) - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled * GOLDEN + keys[k : k + len(rolled)])
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            found, times = np.unique(rolled[a : b - size + 1], return_counts=True)
            out.append((found, np.frexp(times.astype(float))[1].astype(np.int64)))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for key in keys[a:b]:
                one = mix(one * GOLDEN + key)
            out.append((mix(one + np.uint64(b - a)), np.ones(1, np.int64)))
        else:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    return out


def units(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight of each shingle: the Jaccard similarity of such sets is the weighted one."""
    if not len(found) or weight.max() == 1:
        return found
    unit = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(found, weight) + unit.astype(np.uint64) * STRIP


def _times(n: int) -> np.uint64:
    return np.uint64(n * int(GOLDEN) % 2**64)


def dart_minhash(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """Signatures of weighted sets, k 64-bit numbers each (0 for an empty set).

    The chance that two signatures agree in a coordinate is the weighted Jaccard similarity. Every
    element owns a strip of the plane for each unit of weight; hashed darts fall into it at rate one
    per unit area, each with a height in the unit, a rank, and a coordinate of the signature. A set
    takes the darts below its elements' weights and keeps the earliest of each coordinate. It need
    only look at ranks up to t / (total weight), where t darts are expected, enough to reach all
    coordinates; a set with a coordinate left empty looks twice as far.
    """
    n = len(sets)
    sig = np.zeros(n * k, np.uint64)
    total = np.array([len(s) if weights is None else weights[i].sum() for i, s in enumerate(sets)], dtype=float)
    todo = np.flatnonzero(total > 0)
    reach = k * (np.log(k) + 4) / np.maximum(total, 1e-12)
    while len(todo):
        element = np.concatenate([sets[i] for i in todo])
        owner = np.repeat(todo, [len(sets[i]) for i in todo])
        if weights is None:
            strip, top = element, np.ones(len(element))
        else:  # one strip for each unit of weight begun
            weight = np.concatenate([np.asarray(weights[i], float) for i in todo])
            units = np.ceil(weight).astype(np.int64)
            unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
            top = np.minimum(np.repeat(weight, units) - unit, 1.0)
            strip, owner = np.repeat(element, units) + unit.astype(np.uint64) * STRIP, np.repeat(owner, units)
        strip = mix(strip + _times(seed))
        rank, limit = np.zeros(len(strip)), reach[owner]
        best = np.full(n * k, np.inf)
        seen = []
        throw = 0
        while len(strip):
            throw += 1
            dart = mix(strip + _times(throw))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank < limit
            strip, owner, rank, limit, top, dart = (x[live] for x in (strip, owner, rank, limit, top, dart))
            place = mix(dart ^ np.uint64(0xA0761D6478BD642F))
            below = (place >> np.uint64(32)).astype(np.float64) * 2.0**-32 < top
            slot = owner[below] * k + ((place[below] & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(best, slot, rank[below])
            seen.append((slot, rank[below], dart[below]))
        for slot, r, dart in seen:
            first = r == best[slot]
            sig[slot[first]] = dart[first]
        empty = np.isinf(best.reshape(n, k)[todo]).any(axis=1)
        todo = todo[empty]
        reach[todo] *= 2
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; equal keys mean equal rows of the same band."""
    keys = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    parts = sig.reshape(len(sig), bands, rows)
    for r in range(rows):
        keys = mix(keys * GOLDEN + parts[:, :, r])
    return keys.view(np.int64)


def _short(full: np.ndarray) -> np.ndarray:
    """64-bit hashes as distinct 32-bit ones, ascending."""
    return np.unique((full >> np.uint64(32)).astype(np.uint32))


def banding(similarity: float) -> tuple[int, int]:
    """Bands and rows by which a pair of this similarity shares no band with a chance of 3 in a million at most."""
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity must be above 0 and at most 1, not {similarity}")
    if similarity >= SIMILARITY:
        return BANDS, ROWS
    for rows in range(ROWS, 0, -1):
        bands = int(np.ceil(BANDS * np.log1p(-(SIMILARITY**ROWS)) / np.log1p(-(similarity**rows))))
        if bands <= 4 * BANDS:
            break
    return bands, rows


def _signed(batches, bands: int = BANDS, rows: int = ROWS):
    for batch in batches:
        for part in text_slices(batch, most=1_000_000):
            sets, weights = zip(*shingle_weights(part["text"].to_pylist()), strict=True)
            keys = band_keys(dart_minhash(sets, weights, bands * rows), bands, rows)
            some = [[] if not len(s) else k.tolist() for s, k in zip(sets, keys, strict=True)]
            short = [_short(units(s, w)) for s, w in zip(sets, weights, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in short])]).astype(np.int32)
            flat = pa.array(np.concatenate(short).view(np.int32) if short else np.zeros(0, np.int32), pa.int32())
            cols = [part["uid"], part["id"], part["digest"], pa.array(some, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", "digest", "keys", "shingles"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """uid, id, digest of the text, band keys and 32-bit hashes of the weighted shingles of every row."""
    bands, rows = banding(similarity)
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), _digest(text_col).alias("digest"), text_or_empty(text_col).alias("text"))
    return own.mapInArrow(trimmed(lambda batches: _signed(batches, bands, rows)), "uid long, id long, digest binary, keys array<bigint>, shingles array<int>")


def _digest(text_col: str):
    return F.unhex(F.md5(text_or_empty(text_col)))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingles (uid, shingles) have at least this weighted Jaccard similarity."""
    left = pairs.join(sets.select(F.col("uid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("uid").alias("b"), F.col("shingles").alias("sb")), "b")
    na, nb = F.size("sa"), F.size("sb")
    near = F.least(na, nb) >= F.lit(similarity) * F.greatest(na, nb)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.when(near, common >= F.lit(similarity) * (na + nb - common)).otherwise(F.lit(False))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node it is joined to) for every node of the edges (a, b).

    Labels spread over edges and then jump to the label of their label; each round is written to the
    shared folder, and rounds end when no label moves.
    """
    ways = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    now = stored(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = ways.join(now.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = stored(now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("far"))
        then = stored(spread.join(jump, "label").select("node", "old", F.col("far").alias("label")), "labels")
        still = then.where("old != label").isEmpty()
        forget(now, spread)
        if still:
            forget(ways)
            return then.select("node", "label")
        now = then


def candidates(sets: list[np.ndarray], ask: np.ndarray, similarity: float):
    """For each asking row, the rows that may reach the similarity with it: an exact prefix filter.

    Shingles are put in an order, the rarest of these rows first. Two sets of similarity s share one
    of the first n - ceil(s * n) + 1 shingles of each (n: its size), so an index over those finds all.
    """
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(times), np.int64)
    place[np.argsort(times, kind="stable")] = np.arange(len(times))
    code = place[code]
    order = np.lexsort((code, row))
    code = code[order]
    first = np.cumsum(sizes) - sizes
    ahead = np.arange(len(code)) - first[row] < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[row]
    code, row = code[ahead], row[ahead]
    other = ~ask[row]
    by_code = np.lexsort((row[other], code[other]))
    listed, owner = code[other][by_code], row[other][by_code]
    begin, end = np.searchsorted(listed, code, "left"), np.searchsorted(listed, code, "right")
    bounds = np.searchsorted(row, np.arange(len(sets) + 1))
    for n in np.flatnonzero(ask):
        spans = [owner[a:b] for a, b in zip(begin[bounds[n] : bounds[n + 1]], end[bounds[n] : bounds[n + 1]], strict=True) if b > a]
        yield n, np.unique(np.concatenate(spans)) if spans else np.zeros(0, np.int64)


def _compare(similarity: float):
    """Compares the asking rows of each group with its other rows of other components.

    A pair is taken in the first band only whose key it shares; there one of the two is outside, and
    asks. Candidates that can reach the similarity by their sizes are verified until a row is linked
    to the other's component.
    """

    def links_of(rows):
        ask = np.array([r[1] for r in rows], bool)
        if not ask.any() or ask.all():
            return
        own, keys, sets = np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), [r[5] for r in rows]
        sizes = np.array([len(s) for s in sets])
        for n, near in candidates(sets, ask, similarity):
            band, _, uid, comp, _, mine = rows[n]
            fits = (own[near] != comp) & (np.minimum(sizes[near], len(mine)) >= similarity * np.maximum(sizes[near], len(mine)))
            near = near[fits]
            near = near[(keys[near] == keys[n]).argmax(axis=1) == band]
            met = set()
            for j in near:
                if own[j] not in met:
                    common = len(np.intersect1d(mine, sets[j], assume_unique=True))
                    if common >= similarity * (len(mine) + len(sets[j]) - common):
                        met.add(own[j])
                        yield max(uid, rows[j][2]), min(uid, rows[j][2])

    def run(batches):
        group, rows = None, []
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("key", "bx", "by", "band", "ask", "uid", "own")]
            for n, (key, bx, by, band, ask, uid, own) in enumerate(zip(*columns, strict=True)):
                if (key, bx, by) != group:
                    out += links_of(rows)
                    group, rows = (key, bx, by), []
                keys = batch["keys"][n].values.to_numpy(zero_copy_only=False)
                rows.append((band, ask, uid, own, keys, batch["shingles"][n].values.to_numpy(zero_copy_only=False).view(np.uint32)))
            yield _pairs(out)
        yield _pairs(list(links_of(rows)))

    return run


def _pairs(out: list) -> pa.RecordBatch:
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(signed: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Verified pairs that join all rows that banding brings together, from stored signatures.

    Of rows of equal text one stands for all. In each bucket every row is first paired with the
    bucket's least row, so a bucket of m rows gives m - 1 pairs. Rows that this leaves outside their
    bucket's component, the few that only another member resembles, are then looked up among the rows
    of the bucket's other components: in blocks of bounded size, by an index over their rarest
    shingles, so that unlike rows never meet. Only links come out. So no link between two components
    is missed, and the rows of a component are not paired among themselves.
    """
    ones = signed.groupBy("digest").agg(F.min("uid").alias("uid")).select("uid")
    stand = stored(signed.join(ones, "uid", "left_semi").select("uid", (F.size("shingles") + ROW_COST).alias("cost"), F.posexplode("keys").alias("band", "key")), "bands")
    hubs = stand.groupBy("key").agg(F.min("uid").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stored(stand.join(hubs, "key"), "members")
    forget(stand)
    pairs = members.where("uid != hub").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
    first = stored(verified(pairs, signed.select("uid", "shingles"), similarity), "links")
    label = components(first)
    placed = members.where("n > 2").join(label.select(F.col("node").alias("uid"), F.col("label").alias("own")), "uid", "left")
    placed = placed.join(label.select(F.col("node").alias("hub"), F.col("label").alias("main")), "hub", "left")
    placed = stored(placed.select("key", "band", "cost", "uid", F.coalesce("own", "uid").alias("own"), (F.coalesce("own", "uid") != F.coalesce("main", "hub")).alias("outside")), "placed")
    forget(members)
    parts = lambda cost: F.ceil(cost / block).cast("int")
    asked = placed.groupBy("key").agg(parts(F.sum(F.when(F.col("outside"), F.col("cost")))).alias("nx"), parts(F.sum("cost")).alias("ny")).where("nx > 0")
    near = placed.join(asked, "key")
    spot = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = near.where("outside").select("key", "band", "uid", "own", F.lit(True).alias("ask"), spot("nx").alias("bx"), every("ny").alias("by"))
    others = near.select("key", "band", "uid", "own", F.lit(False).alias("ask"), every("nx").alias("bx"), spot("ny").alias("by"))
    full = asking.unionByName(others).join(signed.select("uid", "keys", "shingles"), "uid")
    second = full.repartition("key", "bx", "by").sortWithinPartitions("key", "bx", "by").mapInArrow(trimmed(_compare(similarity)), "a long, b long")
    out = stored(first.unionByName(second), "links")
    forget(first, placed)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: uid, id, digest, class_id (its least id), class_size, kept.

    Classes are the connected components of rows of equal text or of verified similarity. Null
    texts count as empty; empty texts are equal to each other, texts without words to nothing else.
    Rows that repeat an id are rows of their own; the row kept has the least id (null last), then
    the first place. No rows give no rows; further columns are not read.
    """
    signed = stored(signatures(docs, id_col, text_col, similarity), "signed")
    joined_by = links(signed, similarity)
    label = components(joined_by)
    one = signed.groupBy("digest").agg(F.min("uid").alias("stand"))
    named = one.join(label.select(F.col("node").alias("stand"), "label"), "stand", "left").select("digest", F.coalesce("label", "stand").alias("class"))
    rows = stored(signed.select("uid", "id", "digest").join(named, "digest"), "classes")
    forget(signed, joined_by)
    heads = rows.groupBy("class").agg(F.count("*").alias("class_size"), F.min("id").alias("class_id"))
    first = rows.join(heads, "class").where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("uid").alias("head"))
    return rows.join(heads.join(first, "class"), "class").select("uid", "id", "digest", "class_id", "class_size", (F.col("uid") == F.col("head")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with exactly one row of each class, columns unchanged whatever their names.

    The row that stays has the least id (null last). Of rows equal in id and text any one may stay.
    Null texts count as empty, all empty texts are one class, no rows give no rows.
    """
    return keep_marked(docs, classes(docs, id_col, text_col, similarity), id_col, text_col, _digest(text_col))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")
