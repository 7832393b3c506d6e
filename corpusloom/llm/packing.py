"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import struct
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.bin_plan import best_plan
from corpusloom.llm.shared import stored, table, text_or_empty, text_slices, trimmed

CAPACITY = 4096
END_ID = 1
END = struct.pack("<I", END_ID)
#: Rows that are numbered together; a length with more rows is dealt over more buckets.
ROWS_PER_BUCKET = 4096
#: Word cache of a worker: entries, and the longest word kept. Texts bring rare words without end, and
#: each costs a call of the tokenizer, so the cache is large and drops its younger half when it is full.
CACHE_WORDS, CACHE_CHARS = 1_200_000, 64

PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds(dict):
    """Ids by blank-free word, as little-endian bytes. The vocabulary never joins across blanks."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)

    def __missing__(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.forget()
            self[word] = found
        return found

    def forget(self) -> None:
        """Drops the younger half: common words come early."""
        kept = list(islice(self.items(), CACHE_WORDS // 2))
        self.clear()
        self.update(kept)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts, and where each text's ids begin and the last ones end.

        Blanks here are the space, tab and line feed; other white space stays in a word, where the
        tokenizer itself treats it.
        """
        for blank in "\n\t":
            texts = pc.replace_substring(texts, blank, " ")
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        codes = coded.indices.to_numpy()
        own = [self[w] for w in coded.dictionary.to_pylist()]
        size = np.array([len(x) // 4 for x in own], dtype=np.int64)
        pool = np.frombuffer(b"".join(own), dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(size[codes])])
        first = np.cumsum(size) - size
        at = np.repeat(first[codes] - ends[:-1], size[codes]) + np.arange(ends[-1])
        bounds = words.offsets.to_numpy().astype(np.int64)
        return pool[at], ends[bounds - bounds[0]]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(where: str) -> WordIds:
    """One cache for each worker process and vocabulary."""
    if where not in _WORD_IDS:
        _WORD_IDS[where] = WordIds(where)
    return _WORD_IDS[where]


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces_of(folder: str | None, capacity: int):
    def run(batches):
        ids = word_ids(tokenizer_path(folder=folder))
        for batch in batches:
            out: list[tuple] = []
            for part in text_slices(batch):
                found, bounds = ids.encode(part["text"])
                for k, (uid, doc) in enumerate(zip(part["uid"].to_pylist(), part["doc_id"].to_pylist(), strict=True)):
                    own = found[bounds[k] : bounds[k + 1]]
                    for piece, at in enumerate(range(0, len(own) + 1, capacity)):
                        some = own[at : at + capacity]
                        crc, last = zlib.crc32(some), int(at + capacity > len(own))
                        out.append((uid, doc, piece, at, len(some) + last, zlib.crc32(END, crc) if last else crc))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return run


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Every document's ids, an end id after them, cut into pieces of at most capacity ids."""
    own = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return own.mapInArrow(trimmed(_pieces_of(folder, capacity)), PIECES)


def _slots(classes: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan as sorted runs: of each length, ranks from `base` on go `per` to a sequence from `first`."""
    rows, used, first = [], {}, 0
    flat: list[int] = []
    for count, content in classes:
        offset = 0
        for length in sorted(content, reverse=True):
            per = content[length]
            rows.append((length, used.get(length, 0), per, first, len(flat)))
            flat.extend(range(offset, offset + per * length, length))
            offset += per * length
            used[length] = used.get(length, 0) + per * count
        first += count
    rows.sort()
    length, base, per, seq, at = (np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
    return {"key": (length << 44) + base, "base": base, "per": per, "seq": seq, "at": at, "flat": np.array(flat, dtype=np.int64)}


def _placed(plan):
    def run(frames):
        p = plan.value
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            k = np.searchsorted(p["key"], (length << 44) + rank, side="right") - 1
            n = rank - p["base"][k]
            f["sequence_id"] = p["seq"][k] + n // p["per"][k]
            f["offset"] = p["flat"][p["at"][k] + n % p["per"][k]]
            yield f.drop(columns=["rank"])

    return run


def ranked(pieces: DataFrame, counts: dict[int, int], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds rank: a number from 0 within each length, without bringing a length to one task."""
    buckets = [max(1, -(-counts.get(n, 0) // rows_per_bucket)) for n in range(max(counts, default=0) + 1)]
    spread = F.element_at(F.lit(buckets), F.col("length").cast("int") + 1)
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("uid", "piece"), spread.cast("long")))
    own = Window.partitionBy("length", "bucket")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    numbered = salted.withColumn("rn", F.row_number().over(own.orderBy("uid", "piece")))
    return numbered.join(starts, ["length", "bucket"]).withColumn("rank", F.col("from") + F.col("rn") - 1).drop("bucket", "rn", "from")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (uid, piece, length, ...).

    Only the counts by length, at most `capacity` rows, come to the driver; the plan made of them is
    bounded by the capacity too and is broadcast. Equal lengths are interchangeable, so a piece finds
    its place from its rank among those of its length. No rows give no rows.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(_slots(best_plan(counts, capacity)))
    out = ranked(pieces, counts)
    kept = [f for f in out.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"
    order = [f.name for f in kept] + ["rank"]
    return out.select(*order).mapInPandas(_placed(plan), schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Tokenises, cuts and packs whole documents.

    Null and empty texts are the end id alone. Rows that repeat an id are packed each on its own
    (`uid` tells them apart). An empty table gives no rows; further columns are not read.
    """
    return pack(stored(token_pieces(docs, id_col, text_col, capacity, folder), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def utilisation(packed: pd.DataFrame, capacity: int = CAPACITY) -> float:
    """Used share of the sequences of a small packed table."""
    return packed["length"].sum() / (packed["sequence_id"].nunique() * capacity)
