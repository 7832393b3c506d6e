"""Whole builds."""

from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.operators import recipes as R
from corpusloom.plans.q_filters import LADDER_SQL, WORDS_SQL
from corpusloom.plans.registry import query, read

SCREEN_SQL = f"""SELECT doc_id, CASE WHEN outcome IN ('text_quality', 'duplicate_text') THEN outcome WHEN md5(trim(text, ' ' || chr(10))) IN (SELECT md5(trim(text, ' ' || chr(10))) FROM benchmark UNION ALL SELECT md5(trim(text, ' ' || chr(10))) FROM documents WHERE source = 'src3')
 THEN 'prior_corpus' ELSE outcome END AS outcome FROM ({LADDER_SQL}) JOIN documents USING (doc_id)"""


def screened(spark, sf):
    docs, bench = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    old = bench.select("text").unionByName(docs.where("source = 'src3'").select("text"))
    return R.screened(docs, bench, old.select(H.stripped_key(F.col("text")).alias("stripped_key")))


@query("build_screened", SCREEN_SQL)
def build_screened(spark, sf):
    return screened(spark, sf).select("doc_id", "outcome")


@query(
    "build_mixture",
    f"""WITH RECURSIVE k AS (SELECT doc_id, lang AS b, n_chars AS s, row_number() OVER (PARTITION BY lang ORDER BY sha256('11' || chr(31) || CAST(doc_id AS VARCHAR))) AS n FROM ({SCREEN_SQL}) JOIN documents USING (doc_id) WHERE outcome = 'keep'),
r(b, n, room, doc_id, took) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST(100000 AS BIGINT), CAST(-1 AS BIGINT), false FROM k
 UNION ALL SELECT k.b, k.n, CASE WHEN k.s <= r.room THEN r.room - k.s ELSE r.room END, k.doc_id, k.s <= r.room FROM r JOIN k ON k.b = r.b AND k.n = r.n + 1)
SELECT doc_id, row_number() OVER (ORDER BY sha256('12' || chr(31) || CAST(doc_id AS VARCHAR))) - 1 AS position FROM r WHERE took""",
)
def build_mixture(spark, sf):
    kept = screened(spark, sf).where("outcome = 'keep'").select("doc_id", "lang", "n_chars")
    budgets = {r[0]: 100_000 for r in read(spark, sf, "documents").select("lang").distinct().collect()}
    return R.mixture(kept, "lang", "doc_id", "n_chars", budgets, 11).select("doc_id", "position")


@query(
    "split_leak_free",
    """WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n_chars) AS root FROM documents)
SELECT doc_id, CAST('0x' || substr(sha256(CAST(root AS VARCHAR)), 1, 8) AS BIGINT) % 20 < 2 AS held_out FROM g""",
)
def split_leak_free(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "n_chars")
    roots = d.join(d.groupBy("n_chars").agg(F.min("doc_id").alias("root")), "n_chars").select(F.col("doc_id").alias("node"), "root")
    return R.leak_free_split(d, roots, "doc_id", 20, 2).select("doc_id", "held_out")


@query("report_tokens", f"WITH t AS (SELECT lang, count(*) AS n_rows, CAST(sum(len({WORDS_SQL.format('text')})) AS BIGINT) AS tokens FROM documents GROUP BY lang) SELECT *, round(tokens / sum(tokens) OVER (), 6) AS share FROM t")
def report_tokens(spark, sf):
    return R.token_report(read(spark, sf, "documents"), "lang", "text").withColumn("share", F.round("share", 6))
