"""Deduplication queries."""

from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.operators import dedup as D
from corpusloom.plans.registry import query, read


@query("dedup_keep_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def keep_first(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", H.text_key(F.col("text")).alias("key"))
    return D.keep_one(d, "key", "doc_id").select("doc_id")


@query("dedup_collapsed", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(trim(regexp_replace(text, '\s+', ' ', 'g')))")
def collapsed(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", H.collapsed_key(F.col("text")).alias("key"))
    return D.keep_one(d, "key", "doc_id").select("doc_id")


@query("dedup_prompt", r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))")
def prompt(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", H.prompt_key(F.col("text")).alias("key"))
    return D.keep_one(d, "key", "doc_id").select("doc_id")


@query("dedup_record", "SELECT min(l_orderkey * 10 + l_linenumber) AS id, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount")
def record(spark, sf):
    d = read(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return d.groupBy(H.record_key("l_returnflag", "l_linestatus", "l_quantity", "l_discount")).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n")


@query(
    "dedup_mark",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS seen_before FROM events",
)
def mark(spark, sf):
    return D.mark_duplicates(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "seen_before")


@query(
    "dedup_cap",
    "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 2",
)
def cap(spark, sf):
    return D.cap(read(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], ["o_orderkey"], 2).select("o_orderkey")


@query(
    "dedup_shortest",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY length(text), doc_id) AS n FROM documents) WHERE n = 1",
)
def shortest(spark, sf):
    d = read(spark, sf, "documents").select("source", "lang", "doc_id", F.char_length("text").alias("n"))
    return D.keep_first(d, ["source", "lang"], ["n", "doc_id"]).select("source", "doc_id")


@query(
    "dedup_either_key",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) AS b FROM documents) WHERE a = 1 AND b = 1""",
)
def either_key(spark, sf):
    d = read(spark, sf, "documents").withColumn("key", F.md5("text"))
    return D.either_key_unique(d, "key", "n_chars", "doc_id").select("doc_id")


@query("dedup_list", "SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS kinds FROM orders GROUP BY o_custkey")
def in_list(spark, sf):
    g = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("all"))
    return g.select("o_custkey", D.distinct_in_order(F.col("all"), 100).alias("kinds"))


@query(
    "components_documents",
    """WITH RECURSIVE e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY n_chars) AS b FROM documents UNION SELECT doc_id, min(doc_id) OVER (PARTITION BY source, substr(text, 1, 12)) FROM documents),
w AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM w UNION SELECT w.b, r.root FROM r JOIN w ON w.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""",
)
def components(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars", "source", F.substring("text", 1, 12).alias("head"))
    edges = None
    for keys in (["n_chars"], ["source", "head"]):
        least = d.groupBy(*keys).agg(F.min("doc_id").alias("b"))
        found = d.join(least, keys).select(F.col("doc_id").alias("a"), "b")
        edges = found if edges is None else edges.unionByName(found)
    return D.components(edges)
