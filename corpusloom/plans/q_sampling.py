"""Sampling, budget, shuffle, split and block queries."""

from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.functions import text as T
from corpusloom.operators import blocks as B
from corpusloom.operators import sampling as S
from corpusloom.plans.registry import query, read

P = "sha256('{seed}' || chr(31) || CAST({key} AS VARCHAR))"
U = "CAST('0x' || substr(" + P + ", 1, 8) AS BIGINT)"


@query("sample_top", f"SELECT o_orderkey FROM orders ORDER BY {P.format(seed=7, key='o_orderkey')} LIMIT 100")
def top(spark, sf):
    return S.top_by_hash(read(spark, sf, "orders").select("o_orderkey"), 100, 7, F.col("o_orderkey"))


@query("sample_top_each", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {P.format(seed=7, key='o_orderkey')}) AS n FROM orders) WHERE n <= 50")
def top_each(spark, sf):
    return S.stratified(read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 50, 7, "o_orderkey").select("o_orderkey")


@query("sample_share", f"SELECT o_orderkey FROM orders ORDER BY {P.format(seed=8, key='o_orderkey')} LIMIT (SELECT CAST(round_even(count(*) * 0.1, 0) AS BIGINT) FROM orders)")
def share(spark, sf):
    return S.exact_share(read(spark, sf, "orders").select("o_orderkey"), 0.1, 8, F.col("o_orderkey"))


@query("sample_hash", f"SELECT o_orderkey FROM orders WHERE {U.format(seed=9, key='o_orderkey')} < CAST(0.25 * 4294967296 AS BIGINT)")
def hashed(spark, sf):
    return read(spark, sf, "orders").where(H.chosen(9, 0.25, F.col("o_orderkey"))).select("o_orderkey")


@query("sample_bands", f"SELECT o_orderkey, CAST(floor({U.format(seed=9, key='o_orderkey')} / (0.125 * 4294967296)) AS INTEGER) AS band FROM orders")
def bands(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", H.band(9, 0.125, F.col("o_orderkey")).alias("band"))


@query("split_hash", "SELECT doc_id, CAST(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 20 AS INTEGER) AS bucket FROM documents")
def split(spark, sf):
    return read(spark, sf, "documents").select("doc_id", H.hash_bucket(F.sha2("text", 256), 20).alias("bucket"))


@query(
    "budget_nearest",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, t, t - s AS b FROM (SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS s, sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY {P.format(seed=3, key='o_orderkey')}) AS t FROM orders))
WHERE t <= 50000000 OR (b <= 50000000 AND abs(t - 50000000) < abs(b - 50000000))""",
)
def nearest(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.bround("o_totalprice").cast("long").alias("size"), H.priority(3, F.col("o_orderkey")).alias("p"))
    return S.nearest_boundary(o, "o_orderpriority", "p", "size", 50_000_000).select("o_orderkey")


@query("budget_running", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY {P.format(seed=3, key='o_orderkey')}) AS BIGINT) AS total FROM orders")
def running(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.bround("o_totalprice").cast("long").alias("size"), H.priority(3, F.col("o_orderkey")).alias("p"))
    return S.running_total(o, ["o_orderpriority"], "p", "size", "total").select("o_orderkey", "total")


@query(
    "budget_greedy",
    f"""WITH RECURSIVE o AS (SELECT o_orderpriority AS b, o_orderkey AS k, CAST(o_totalprice AS BIGINT) AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {P.format(seed=5, key='o_orderkey')}) AS n FROM orders),
r(b, n, room, k, took) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST(3000000 AS BIGINT), CAST(-1 AS BIGINT), false FROM o
 UNION ALL SELECT o.b, o.n, CASE WHEN o.s <= r.room THEN r.room - o.s ELSE r.room END, o.k, o.s <= r.room FROM r JOIN o ON o.b = r.b AND o.n = r.n + 1)
SELECT k AS o_orderkey FROM r WHERE took""",
)
def greedy(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.bround("o_totalprice").cast("long").alias("size"), F.when(F.col("o_orderkey").isNotNull(), H.priority(5, F.col("o_orderkey"))).alias("p"))
    budgets = {r[0]: 3_000_000 for r in o.select("o_orderpriority").distinct().collect()}
    return S.greedy_fill(o, "o_orderpriority", "o_orderkey", "p", "size", budgets).select("o_orderkey")


@query("order_alternate", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1) * 4 + CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS turn FROM documents")
def alternate(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("h"))
    return S.alternate(d, "lang", "h", ["en", "de", "fr", "es"]).select("doc_id", F.col("turn").cast("long").alias("turn"))


@query("order_ranked", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 64")
def ranked(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return read(spark, sf, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(64).select("o_orderkey")


@query("order_longest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 32")
def longest(spark, sf):
    return read(spark, sf, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(32).select("doc_id", "n_chars")


@query("order_dates", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' ORDER BY o_orderkey LIMIT 100")
def dates(spark, sf):
    o = read(spark, sf, "orders").where(F.to_date("o_orderdate").between("1995-01-01", "1995-12-31"))
    return o.orderBy("o_orderkey").limit(100).select("o_orderkey")


@query("blocks_pack")
def pack(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.size(T.words(F.col("text"))) + 2).alias("length"))
    return B.pack_blocks(d, "doc_id", "length", "doc_id", 2048)


@query("blocks_buckets")
def buckets(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.size(T.words(F.col("text"))) + 2).alias("length"))
    return B.bucketed(d, "length", 4, 128).groupBy("bucket").agg(F.count("*").alias("n"), F.max("length").alias("longest"))


@query("blocks_batches", "SELECT doc_id, bucket, CAST((row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1) // 8 AS INTEGER) AS batch FROM (SELECT doc_id, CASE WHEN n_chars <= 1000 THEN 1000 WHEN n_chars <= 4000 THEN 4000 ELSE 1000000 END AS bucket FROM documents)")
def batched(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") <= 1000, 1000).when(F.col("n_chars") <= 4000, 4000).otherwise(1000000).alias("bucket"), F.md5(F.col("doc_id").cast("string")).alias("h"))
    return B.batches(d, "bucket", "h", 8).select("doc_id", "bucket", "batch")


@query("blocks_compact", "SELECT doc_id, CAST(n_chars % 7 + 1 + n_chars % 5 + 1 AS BIGINT) AS n, n_chars % 7 + 1 AS one, n_chars % 5 + 1 AS two FROM documents")
def compact(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.array((F.col("n_chars") % 7 + 1).cast("int"), (F.col("n_chars") % 5 + 1).cast("int")).alias("lengths"))
    out = d.select("doc_id", B.restore_segments(F.col("lengths")).alias("s"), B.segment_positions(F.col("lengths")).alias("p"))
    back = B.compact(F.col("s"), F.col("p"))["segment_lengths"]
    return out.select("doc_id", F.size("p").cast("long").alias("n"), back[0].cast("long").alias("one"), back[1].cast("long").alias("two"))
