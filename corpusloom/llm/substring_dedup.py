"""Removal of repeated word passages by suffix automata over reference shards.

Broadcasting the automata of all shards to all documents would read the corpus once for every shard,
and the shards grow with the corpus. Here each passage goes to the one shard that can know it. The
anchor of a window is its least-hashed GRAM words, so equal windows have equal anchors; neighbouring
windows with one anchor are a span, and a shard holds the spans of its anchors. Spans that are equal
as a whole are settled by order alone, before the shuffle where they lie in one partition. Only
different spans of one anchor can still share some of their windows: their words are read again and
streamed, in order, through the automaton of the spans before them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.automaton import SuffixAutomaton
from corpusloom.llm.codepoints import joined, mix, word_keys
from corpusloom.llm.shared import release, stored, table, text_or_empty, text_slices, trimmed

WINDOW, GRAM = 20, 6
#: Anchors with more different spans than this are settled window by window, by aggregation.
MOST_SPANS = 64
#: Text that a map task combines at once.
COMBINE_BYTES = 48_000_000
PLACE_BITS = np.uint64(30)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))

FOUND = "kind int, anchor long, span long, key long, id long, at int, n int"
PARTS = "big boolean, anchor long, span long, key long, id long, at int, n int, words array<int>"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]))


class Words:
    """Word hashes of many texts, and where each text's words begin and the last ones end."""

    def __init__(self, texts: list[str]):
        points, bounds = joined(texts)
        points = points[1:]
        start, self.keys = word_keys(points, (points == 32) | ((points >= 9) & (points <= 13)))
        self.at = np.searchsorted(start, bounds)

    def segments(self, begin: np.ndarray, size: np.ndarray, salt: np.uint64 = np.uint64(0)) -> np.ndarray:
        """64-bit hashes of word sequences; those of another salt are independent of them."""
        n = len(self.keys)
        keys = mix(self.keys ^ salt) if salt else self.keys
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * _powers(BASE, n)[:n], dtype=np.uint64)])
        return mix((sums[begin + size] - sums[begin]) * _powers(BACK, n)[begin] + size.astype(np.uint64))

    def spans(self, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
        """Anchor hash, whole hash, text number, first window and number of windows of every span."""
        n = len(self.keys)
        if n < window:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        g = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            g = mix(g * GOLDEN + self.keys[k : k + len(g)])
        least, wide, size = (g >> PLACE_BITS << PLACE_BITS) | np.arange(len(g), dtype=np.uint64), window - gram + 1, 1
        while size * 2 <= wide:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < wide:
            least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])
        anchor = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
        owner = np.searchsorted(self.at, np.arange(len(anchor)), side="right") - 1
        own = np.flatnonzero(np.arange(len(anchor)) + window <= self.at[owner + 1])
        if not len(own):
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        begins = np.flatnonzero(np.concatenate([[True], (anchor[own][1:] != anchor[own][:-1]) | (owner[own][1:] != owner[own][:-1])]))
        first, count = own[begins], np.diff(np.concatenate([begins, [len(own)]]))
        return g[anchor[first]], self.segments(first, count + window - 1), owner[first], first - self.at[owner[first]], count


def _local(window: int):
    """Spans of a partition. Of equal ones only the earliest goes on; later ones are settled (kind 0).

    An anchor with more than MOST_SPANS different spans here is crowded. Its spans (kind 3) go to tasks
    of their own choice, and one row (kind 4) tells the task of the anchor, so no task gets them all.
    """

    def flush(held):
        anchor, span, key, doc, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, span, anchor))
        anchor, span, key, doc, at, n = (x[order] for x in (anchor, span, key, doc, at, n))
        same = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (span[1:] == span[:-1])])
        head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        later = (doc != doc[head]) | (at != at[head])
        group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])]) if len(anchor) else np.zeros(0, int)
        many = np.bincount(group, weights=~same) > MOST_SPANS
        kind = np.where(later, 0, np.where(many[group], 3, 1)) if len(anchor) else np.zeros(0, int)
        told = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]) & many[group]) if len(anchor) else np.zeros(0, int)
        columns = [np.concatenate([x, x[told]]) for x in (kind, anchor, span, key, doc, at, n)]
        kind, anchor, span, key, doc, at, n = columns
        kind[len(kind) - len(told) :] = 4
        span[len(span) - len(told) :] = np.uint64(1 << 63)  # the least as a signed number: before the anchor's spans
        anchor = np.where(kind == 0, mix(key.view(np.uint64) + at.astype(np.uint64)), np.where(kind == 3, mix(anchor ^ mix(span)), anchor))
        for begin in range(0, len(kind), 50_000):
            k = slice(begin, begin + 50_000)
            cols = [kind[k].astype(np.int32), anchor[k].view(np.int64), span[k].view(np.int64), key[k], doc[k], at[k].astype(np.int32), n[k].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "anchor", "span", "key", "id", "at", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, most=2_000_000):
                anchor, span, owner, at, n = Words(part["text"].to_pylist()).spans(window)
                key, doc = part["key"].to_numpy(), part["id"].to_numpy()
                held.append((anchor, span, key[owner], doc[owner], at, n))
                size += part["text"].nbytes
                if size > COMBINE_BYTES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


COLUMNS = ("anchor", "span", "key", "id", "at", "n")


def _found(rows: dict[str, np.ndarray], kind: np.ndarray | int) -> pa.RecordBatch:
    kinds = np.broadcast_to(np.asarray(kind, np.int32), len(rows["key"]))
    return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(rows[c]) for c in COLUMNS)], names=["kind", *COLUMNS])


def _settle(batches):
    """Of rows sorted by anchor, span, id and place: later equal spans (kind 0) and the firsts of
    anchors with several spans (kind 1, or 2 for those with more than MOST_SPANS, or told to be crowded).
    Spans of other documents at the id and place of the first are firsts too."""
    held = {c: np.zeros(0, np.int32 if c in ("at", "n") else np.int64) for c in COLUMNS}  # firsts of the anchor that may go on
    head = None  # the first of the last span
    crowded = None  # an anchor known to have many spans
    for batch in batches:
        rows, kinds = {c: batch[c].to_numpy() for c in COLUMNS}, batch["kind"].to_numpy()
        if (kinds == 0).any():
            yield _found({c: v[kinds == 0] for c, v in rows.items()}, 0)
        forced = rows["anchor"][kinds >= 3]
        if crowded is not None:
            forced = np.append(forced, crowded)
        spans = np.flatnonzero((kinds == 1) | (kinds == 3))
        told = rows["anchor"][kinds == 4]
        if len(told) and (not len(spans) or told[-1] > rows["anchor"][spans[-1]]):
            crowded = told[-1]  # its spans come in the next batch
        rows = {c: v[spans] for c, v in rows.items()}
        if not len(rows["key"]):
            continue
        fresh = np.concatenate([[head is None or (rows["anchor"][0], rows["span"][0]) != head[:2]], (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["span"][1:] != rows["span"][:-1])])
        place = np.cumsum(fresh) - 1
        firsts = np.flatnonzero(fresh)
        of = np.where(place >= 0, firsts[np.maximum(place, 0)] if len(firsts) else 0, 0)
        first_id, first_at, first_key = rows["id"][of], rows["at"][of], rows["key"][of]
        if head is not None:
            first_id, first_at, first_key = (np.where(place < 0, x, own) for x, own in zip(head[2:], (first_id, first_at, first_key), strict=True))
        later = ~fresh & ((rows["id"] != first_id) | (rows["at"] != first_at))
        if later.any():
            yield _found({c: v[later] for c, v in rows.items()}, 0)
        if len(firsts):
            k = firsts[-1]
            head = (rows["anchor"][k], rows["span"][k], rows["id"][k], rows["at"][k], rows["key"][k])
        on = fresh | ~later & (rows["key"] != first_key)
        new = {c: np.concatenate([held[c], v[on]]) for c, v in rows.items()}
        if not len(new["key"]):
            continue
        begins = np.flatnonzero(np.concatenate([[True], new["anchor"][1:] != new["anchor"][:-1]]))
        counts = np.diff(np.concatenate([begins, [len(new["key"])]]))
        kind = np.where(counts > MOST_SPANS, 2, np.where(counts > 1, 1, 0))
        kind = np.where(np.isin(new["anchor"][begins], forced), 2, kind)
        end = int(begins[-1])
        if kind[-1] == 2:  # known to be many: nothing of it need be held
            end = len(new["key"])
            if not len(told) or told[-1] <= new["anchor"][-1]:
                crowded = new["anchor"][-1]
        else:
            kind[-1] = 0
        each = np.repeat(kind, counts)
        out = np.flatnonzero((each > 0) & (np.arange(len(each)) < end))
        if len(out):
            yield _found({c: v[out] for c, v in new.items()}, each[out])
        held = {c: v[end:] for c, v in new.items()}
    if len(held["key"]) > 1:
        yield _found(held, 1)


def _parts(window: int):
    """The words of candidate spans; those of crowded anchors window by window, under two hashes of the window."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, most=2_000_000):
                words = Words(part["text"].to_pylist())
                short = (words.keys >> np.uint64(32)).astype(np.uint32).view(np.int32)
                spans, sizes = part["spans"].flatten(), part["spans"].value_lengths().to_numpy()
                kind, anchor, at, n = (spans.field(c).to_numpy() for c in ("kind", "anchor", "at", "n"))
                doc = np.repeat(np.arange(part.num_rows), sizes)
                keys, ids = part["key"].to_numpy()[doc], part["id"].to_numpy()[doc]
                base = words.at[doc].astype(np.int64)
                few, many = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
                long = n[few].astype(np.int64) + window - 1
                ends = np.concatenate([[0], np.cumsum(long)])
                flat = np.repeat(base[few] + at[few] - ends[:-1], long) + np.arange(ends[-1])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(short[flat]))
                yield _part(False, anchor[few], np.zeros(len(few), np.int64), keys[few], ids[few], at[few], n[few], lists)
                if len(many):
                    times = n[many].astype(np.int64)
                    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    wide, where = np.repeat(many, times), np.repeat(at[many], times) + step
                    size = np.full(len(wide), window)
                    one, two = (words.segments(base[wide] + where, size, salt).view(np.int64) for salt in (np.uint64(0), GOLDEN))
                    yield _part(True, one, two, keys[wide], ids[wide], where.astype(np.int32), np.ones(len(wide), np.int32), pa.nulls(len(wide), pa.list_(pa.int32())))

    return run


def _part(big: bool, anchor, span, key, doc, at, n, words) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(key), big)), *(pa.array(c) for c in (anchor, span, key, doc, at, n)), words]
    return pa.RecordBatch.from_arrays(cols, names=["big", "anchor", "span", "key", "id", "at", "n", "words"])


def _stream(window: int):
    """Streams the spans of each anchor, sorted by id and place, through the automaton of those before.

    Documents that share an id know those of lesser ids; among them a window is earlier by its place.
    """

    def run(batches):
        anchor, doc, known, group, waiting = None, None, None, [], []

        def begins_before(words):
            nonlocal known, waiting
            if waiting and known is None:
                known = SuffixAutomaton()
            for x in waiting:
                known.add(x)
            waiting = []
            return [k - window + 1 for k, size in enumerate(known.matching(words)) if size >= window] if known is not None else []

        def settled():
            """The windows that go of the spans of one id, which are known from then on."""
            several, first, new = any(key != group[0][0] for key, _, _ in group), {}, []
            windows = lambda words: (tuple(words[k : k + window]) for k in range(len(words) - window + 1))
            if several:
                for _, at, words in group:
                    for k, w in enumerate(windows(words)):
                        first[w] = min(first.get(w, at + k), at + k)
            for key, at, words in group:
                gone = begins_before(words)
                whole = len(gone) == len(words) - window + 1
                if several:
                    gone = sorted({*gone, *(k for k, w in enumerate(windows(words)) if first[w] < at + k)})
                yield from ((key, at + k, 1) for k in gone)
                if not whole:
                    (new if several else waiting).append(words)
            waiting.extend(new)

        for batch in batches:
            out = []
            for own, i, key, at, words in zip(*(batch[c].to_pylist() for c in ("anchor", "id", "key", "at", "words")), strict=True):
                if (own, i) != (anchor, doc):
                    out += settled()
                    group = []
                    if own != anchor:
                        known, waiting = None, []
                    anchor, doc = own, i
                group.append((key, at, words))
            yield _runs(out)
        yield _runs(list(settled()))

    return run


def _runs(out: list) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["key", "at", "n"])


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, at, n: runs of n windows from place at that also start earlier. docs: key, id, text."""
    sent = docs.mapInArrow(trimmed(_local(window)), FOUND)
    spread = sent.repartition("anchor").sortWithinPartitions("anchor", "span", "id", "at")
    found = stored(spread.mapInArrow(_settle, FOUND), "spans")
    release(docs.sparkSession)
    spans = found.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("kind", "anchor", "at", "n")).alias("spans"))
    parts = stored(docs.join(spans, "key").select("key", "id", "text", "spans").mapInArrow(_parts(window), PARTS), "parts")
    release(docs.sparkSession)
    small = parts.where("not big").select("anchor", "id", "key", "at", "words")
    streamed = small.repartition("anchor").sortWithinPartitions("anchor", "id", "at").mapInArrow(_stream(window), "key long, at int, n int")
    crowd = parts.where("big").select("anchor", "span", "id", "key", "at")  # two hashes of a window: 128 bits
    first = crowd.groupBy("anchor", "span").agg(F.min(F.struct("id", "at")).alias("first"))
    later = crowd.join(first, ["anchor", "span"]).where(F.struct("id", "at") > F.col("first")).select("key", "at", F.lit(1).alias("n"))
    return found.where("kind = 0").select("key", "at", "n").unionByName(streamed).unionByName(later)


def _kept(window: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, most=2_000_000):
                total, removed, texts = [], [], []
                for text, runs in zip(part["text"].to_pylist(), part["runs"].to_pylist(), strict=True):
                    words = text.encode("utf-8", "surrogatepass").split()  # at [ \t-\r], as the contract has it
                    gone = 0
                    if runs:
                        mask = np.zeros(len(words) + 1, np.int64)
                        at = np.array([(r["at"], r["at"] + r["n"] + window - 1) for r in runs])
                        np.add.at(mask, at[:, 0], 1)
                        np.add.at(mask, at[:, 1], -1)
                        out = np.cumsum(mask)[:-1] > 0
                        gone = int(out.sum())
                        kept = b" ".join([words[k] for k in np.flatnonzero(~out)])
                    else:
                        kept = b" ".join(words)
                    total.append(len(words))
                    removed.append(gone)
                    texts.append(kept)
                names = [c for c in part.schema.names if c not in ("text", "runs")]
                cols = [*(part[c] for c in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256, kept_text.

    Null and empty texts have no words. Documents are ordered by id, null last; rows that repeat an
    id are documents of their own, and of equal windows at the same id and place none is earlier
    than the other. No rows give no rows; further columns are not read.
    """
    last = docs.agg(F.max(F.col(id_col).cast("long"))).first()[0]
    own = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    own = own.withColumn("id", F.coalesce("doc", F.lit((last or 0) + 1)))
    if own.groupBy("id").count().where("count > 1").isEmpty():
        own = own.withColumn("key", F.col("id"))
    else:
        own = stored(own.withColumn("key", F.monotonically_increasing_id()), "rows")
    runs = repeated(own.select("key", "id", "text"), window).groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    both = own.select("key", "doc", "text").join(runs, "key", "left").select("doc", "text", "runs")
    return both.mapInArrow(_kept(window), "doc long, n_words long, n_removed long, kept_sha256 string, kept_text string").withColumnRenamed("doc", "id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
  FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM v) WHERE n > 1),
g AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, k: gone IS NULL OR NOT list_contains(gone, k)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
