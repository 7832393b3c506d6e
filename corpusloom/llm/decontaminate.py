"""Benchmark decontamination by a broadcast set of hashed test windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import stored, table, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Windows whose texts and item lists take more bytes than this are not broadcast but joined by their hash.
MAX_BROADCAST_BYTES = 32_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows of the items: size, hash, text, the ids of the items that have it, and an anchor.

    An item of fewer words than a window is one window of its own size; one without words has none.
    The anchor is the window's word that fewest windows have (the longest of these): its hash and its
    place in the window, from 0.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(text_or_empty(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = items.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    found = at.select("item", "size", F.slice("w", F.col("at"), F.col("size")).alias("part"))
    distinct = found.groupBy("part").agg(F.collect_set("item").alias("items")).withColumn("n", F.monotonically_increasing_id())
    distinct = stored(distinct, "tests")
    each = distinct.select("n", F.posexplode("part").alias("place", "word"))
    rare = each.groupBy("word").agg(F.count("*").alias("times"))
    ranked = each.join(rare, "word").groupBy("n").agg(F.min(F.struct("times", -F.length("word"), "word", "place")).alias("best"))
    return distinct.join(ranked, "n").select(
        F.size("part").alias("size"), F.xxhash64("part").alias("hash"), F.array_join("part", " ").alias("window_text"), "items", F.xxhash64("best.word").alias("anchor"), F.col("best.place").alias("place")
    )


def _hashed_windows(tokens: Column, size: int) -> Column:
    """All windows of this size: place, size and hash."""
    n = F.size(tokens)
    each = F.transform(
        F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice(tokens, i, size)).alias("hash"))
    )
    return F.when(n >= size, each).otherwise(F.array().cast("array<struct<at:int,size:int,hash:bigint>>"))


def _covered(hits: Column) -> Column:
    """How many words the hits (at, size), sorted, cover together."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(F.lit(0), h["at"] + h["size"] - F.greatest(acc["end"], h["at"]))).cast("long").alias("n"),
        F.greatest(acc["end"], h["at"] + h["size"]).alias("end"),
    )
    return F.aggregate(hits, start, step, lambda acc: acc["n"])


def _met_in_place(own: DataFrame, tests: DataFrame) -> DataFrame:
    """row, kept, n_words, hits, items, where the windows are small enough for every task.

    A document's words are looked up among the anchors as they are read; only where one is met is the
    window around it hashed, looked at, and its text compared. Place 0 stands for the document itself.
    """
    each = own.select("row", "kept", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "word"))
    start, size = F.col("at") - F.col("place"), F.col("size")
    part = F.slice("w", start, size)
    real = F.when((start >= 1) & (start + size - 1 <= F.size("w")), (F.xxhash64(part) == F.col("hash")) & (F.array_join(part, " ") == F.col("window_text"))).otherwise(F.lit(False))
    met = each.join(F.broadcast(tests), (F.xxhash64("word") == F.col("anchor")) & real, "left").where((F.col("at") == 0) | F.col("hash").isNotNull())
    rows = met.select(
        "row",
        F.when(F.col("at") == 0, F.col("kept")).alias("kept"),
        F.when(F.col("at") == 0, F.size("w").cast("long")).alias("n_words"),
        F.when(F.col("at") > 0, F.struct(start.alias("at"), size.alias("size"))).alias("hit"),
        F.when(F.col("at") > 0, F.col("items")).alias("items"),
    )
    return rows.groupBy("row").agg(
        F.first("kept", ignorenulls=True).alias("kept"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def _met_by_hash(own: DataFrame, tests: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for any number of windows: places and hashes alone are shuffled, and words are fetched for hits."""
    own = stored(own, "words")
    each = own.select("row", F.explode(F.concat(*[_hashed_windows(F.col("w"), size) for size in sizes])).alias("p")).select("row", "p.*")
    met = each.join(tests.select("size", "hash", "window_text", "items"), ["size", "hash"])
    met = met.groupBy("row").agg(F.collect_list(F.struct("at", "size", "window_text", "items")).alias("met"))
    real = F.filter("met", lambda m: F.array_join(F.slice("w", m["at"], m["size"]), " ") == m["window_text"])
    both = own.join(met, "row", "left").withColumn("real", F.coalesce(real, F.array().cast("array<struct<at:int,size:int,window_text:string,items:array<string>>>")))
    hits = F.array_sort(F.array_distinct(F.transform("real", lambda m: F.struct(m["at"].alias("at"), m["size"].alias("size")))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("real", lambda m: m["items"]))))
    return both.select("row", "kept", F.size("w").cast("long").alias("n_words"), hits.alias("hits"), items.alias("items"))


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = ("doc_id",), most_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per document: the `keep` columns, n_words, n_hit, hits (word place from 1, size), items.

    Windows that take `most_bytes` at most are broadcast; more are joined by their hash. A hit counts
    if the words are equal too. Null and empty texts have no words and no hits. Repeated rows are
    documents of their own, told apart by the number of the row. An empty benchmark hits nothing;
    windows of items without id count, but name no item.
    """
    tests = stored(benchmark_windows(benchmark, window, item_col), "windows")
    cost = F.octet_length("window_text") + F.coalesce(F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 32), F.lit(0)) + 96
    summary = tests.agg(F.coalesce(F.sum(cost), F.lit(0)).alias("bytes"), F.collect_set("size").alias("sizes")).first()
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), words(text_or_empty(text_col)).alias("w"))
    if summary["bytes"] <= most_bytes:
        found = _met_in_place(own, tests)
    else:
        found = _met_by_hash(own, tests, sorted(summary["sizes"]) or [window])  # at most `window` sizes
    return found.select("kept.*", "n_words", _covered(F.col("hits")).alias("n_hit"), "hits", "items")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """docs without the documents that hold a test window, columns unchanged whatever their names.

    The text alone decides, so rows fare alike whose texts are equal, whatever their ids. Null and
    empty texts stay, no rows give no rows, and an empty benchmark drops nothing.
    """
    digest = F.unhex(F.md5(text_or_empty(text_col)))
    own = docs.select(digest.alias("digest"), F.col(text_col).alias("text"))
    gone = overlap(own, benchmark, window, keep=("digest",)).where("n_hit > 0").select("digest").distinct()
    return docs.select(F.struct("*").alias("doc"), digest.alias("digest")).join(gone, "digest", "left_anti").select("doc.*")


def clean_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, clean_text and n_hit: each document's other words, lower-cased and joined by a space.

    Null and empty texts give an empty one, repeated rows are rows of their own, no rows give no
    rows, and an empty benchmark cuts nothing; further columns are not read.
    """
    kept = F.filter(
        F.transform(words(F.col("text")), lambda w, i: F.when(~F.exists("hits", lambda h: (i + 1 >= h["at"]) & (i + 1 < h["at"] + h["size"])), w)),
        lambda w: w.isNotNull(),
    )
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return overlap(own, benchmark, window, keep=("id", "text")).select(F.col("id").alias(id_col), F.array_join(kept, " ").alias("clean_text"), "n_hit")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS part
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS part
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
h AS (SELECT DISTINCT doc_id, i, size, item FROM dw JOIN bw USING (size, part)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       coalesce(t.items_sha256, sha256('')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
