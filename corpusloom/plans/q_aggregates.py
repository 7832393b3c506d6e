"""Aggregate and window queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import plans
from corpusloom.operators import sampling as S
from corpusloom.plans.q_filters import WORDS_SQL
from corpusloom.plans.registry import query, read


@query("report_components", f"SELECT source, count(*) AS n_rows, CAST(sum(len({WORDS_SQL.format('text')}) + 2) AS BIGINT) AS tokens, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def components(spark, sf):
    return A.component_report(read(spark, sf, "documents"), "source", "text", F.size(T.words(F.col("text"))) + 2)


@query("report_shares", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def shares(spark, sf):
    out = A.with_share(A.counts(read(spark, sf, "documents"), "lang"), "n")
    return out.withColumn("share", F.round("share", 6))


@query(
    "report_percentiles",
    """SELECT source, max(CASE WHEN i = n // 2 THEN v END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95) AS BIGINT) THEN v END) AS p95, max(v) AS top
FROM (SELECT source, n_chars AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source""",
)
def percentiles(spark, sf):
    d = read(spark, sf, "documents").select("source", "n_chars")
    out = A.ranked_value(d, "source", "n_chars", 0.5, "p50").join(A.ranked_value(d, "source", "n_chars", 0.95, "p95"), "source")
    return out.join(d.groupBy("source").agg(F.max("n_chars").alias("top")), "source")


@query(
    "report_length_bins",
    "SELECT CASE WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 1024 THEN 1024 WHEN n_chars <= 2048 THEN 2048 WHEN n_chars <= 4096 THEN 4096 WHEN n_chars <= 8192 THEN 8192 WHEN n_chars <= 16384 THEN 16384 WHEN n_chars <= 32768 THEN 32768 WHEN n_chars <= 65536 THEN 65536 END AS bin, count(*) AS n FROM documents GROUP BY bin",
)
def length_bins(spark, sf):
    return A.counts(read(spark, sf, "documents").select(A.length_bin(F.col("n_chars")).alias("bin")), "bin")


@query("report_census", "SELECT lang, count(*) AS n_rows, count(*) FILTER (n_chars <= 2000) AS n_below, count(*) FILTER (n_chars > 2000) AS n_above FROM documents GROUP BY lang")
def census(spark, sf):
    return A.length_census(read(spark, sf, "documents"), "lang", F.col("n_chars"), 2000)


@query("report_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), 'the|und|les')) AS term FROM documents) GROUP BY term")
def terms(spark, sf):
    return A.term_totals(read(spark, sf, "documents"), F.col("text"), "the|und|les")


@query(
    "report_gram_frequency",
    f"""SELECT gram, count(*) AS n_rows FROM (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], chr(31)) AS gram FROM
(SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents) WHERE len(w) >= 13)) GROUP BY gram HAVING count(*) >= 3""",
)
def gram_frequency(spark, sf):
    return A.gram_frequency(read(spark, sf, "documents"), "doc_id", T.ngrams(T.words(F.col("text")), 13), 3)


@query("report_group_max", "SELECT max(n) AS top, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority)")
def group_max(spark, sf):
    return A.counts(read(spark, sf, "orders"), "o_custkey", "o_orderpriority").agg(F.max("n").alias("top"), F.count("*").alias("groups"))


@query(
    "report_mixture",
    """SELECT w AS "window", lang, CAST(sum(n_chars) AS BIGINT) AS tokens FROM (SELECT *, least(doc_id // s, 7) AS w FROM
(SELECT doc_id, lang, n_chars, (SELECT greatest(1, (count(*) - 50) // 7) FROM documents) AS s FROM documents)) WHERE doc_id < w * s + 50 GROUP BY w, lang""",
)
def mixture(spark, sf):
    d = read(spark, sf, "documents").withColumn("doc_id", F.col("doc_id").cast("int"))
    return S.mixing_windows(d, "doc_id", "lang", "n_chars", d.count(), 8, 50).select("window", "lang", "tokens")


@query(
    "report_chunks",
    "SELECT CAST(doc_id // 100 AS INTEGER) AS chunk_index, min(doc_id) AS start, max(doc_id) + 1 AS \"end\", count(*) AS n_rows, CAST(sum(least(n_chars, 4096)) AS BIGINT) AS tokens FROM documents GROUP BY 1",
)
def chunks(spark, sf):
    d = S.numbered(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return plans.chunk_report(plans.fixed_chunks(d, "row_number", 100), "n_chars", 4096)


@query(
    "grade_pass_at_k",
    """WITH t AS (SELECT o_custkey AS task, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS c FROM orders GROUP BY o_custkey)
SELECT task, n, c, round(CASE WHEN n < 5 THEN NULL WHEN n - c < 5 THEN 1.0 ELSE 1.0 - list_product(list_transform(range(0, 5), lambda i: (n - c - i) / (n - i))) END, 9) AS pass_at_k FROM t""",
)
def pass_at_k(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderstatus") == "F").alias("passed"))
    return A.pass_at_k(o, "task", "passed", 5).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query("grade_accuracy", "SELECT count(*) AS n_tasks, round(avg(r), 9) AS accuracy FROM (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM orders GROUP BY o_custkey)")
def accuracy(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").alias("passed"))
    return A.macro_accuracy(o, "o_custkey", "passed").withColumn("accuracy", F.round("accuracy", 9))


@query(
    "grade_failures",
    """SELECT o_orderpriority AS task, o_orderstatus AS kind, CAST(sum(n) AS BIGINT) AS n_failed, count(*) AS n_outputs FROM
(SELECT o_orderpriority, o_orderstatus, o_custkey % 10 AS out, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) GROUP BY 1, 2""",
)
def failures(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("kind"), (F.col("o_orderstatus") == "F").alias("ok"), (F.col("o_custkey") % 10).cast("string").alias("out"))
    return A.failure_report(o, "task", "ok", "kind", "out").drop("examples")


@query(
    "group_advantage",
    "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-4), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)",
)
def advantage(spark, sf):
    return A.group_advantage(read(spark, sf, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("report_timing", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS \"max\" FROM events GROUP BY event_type")
def timing(spark, sf):
    out = A.timing_summary(read(spark, sf, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p95")})


@query("window_parity", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id)) % 2 AS side FROM documents")
def parity(spark, sf):
    d = S.numbered(read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", by=("lang",))
    return d.select("doc_id", F.pmod(F.col("row_number") + 1, F.lit(2)).cast("long").alias("side"))


@query("window_adjacent", "SELECT conv_id, turn, role, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def adjacent(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("window_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_number FROM orders")
def numbers(spark, sf):
    return S.numbered(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("audit_tables", "SELECT count(*) FILTER (NOT l_quantity BETWEEN 1 AND 50) AS quantity, count(*) FILTER (NOT l_discount < 0.1) AS discount, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS flag FROM lineitem")
def audit(spark, sf):
    checks = {"quantity": F.col("l_quantity").between(1, 50), "discount": F.col("l_discount") < 0.1, "flag": F.col("l_returnflag").isin("A", "N")}
    found = plans.audit(read(spark, sf, "lineitem"), checks)
    return spark.createDataFrame([tuple(found[k] for k in checks)], ", ".join(f"{k} long" for k in checks))
