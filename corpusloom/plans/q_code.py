"""Queries over generated code, markup and exercises."""

from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.functions import markup as M
from corpusloom.plans.registry import query, read


def _programs(spark, sf):
    """A small Python program for each part: some are clones of each other, some are broken."""
    k = F.col("p_partkey") % 4
    body = (
        F.when(k == 0, F.concat(F.lit("def f(x):\n    '''doc'''\n    return x + "), F.col("p_size").cast("string")))
        .when(k == 1, F.concat(F.lit("def g(y):\n    return y + "), F.col("p_size").cast("string")))
        .when(k == 2, F.concat(F.lit("def h(:\n    "), F.col("p_name")))
        .otherwise(F.lit("def f(x):\n    raise NotImplementedError"))
    )
    return read(spark, sf, "part").select("p_partkey", "p_size", k.alias("k"), body.alias("code"))


@query(
    "code_clones",
    "SELECT count(*) AS n, count(DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 3 THEN -1 END) AS n_clones, count(DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1000 + p_size WHEN 3 THEN -1 END) AS n_syntax FROM part",
)
def clones(spark, sf):
    p = _programs(spark, sf).select(C.over("code", C.clone_key, "string").alias("c"), C.over("code", C.syntax_key, "string").alias("s"))
    return p.agg(F.count("*").alias("n"), F.count_distinct("c").alias("n_clones"), F.count_distinct("s").alias("n_syntax"))


@query("code_reasons", "SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'syntax' END AS reason, p_partkey % 4 = 3 AS unfinished FROM part")
def reasons(spark, sf):
    return _programs(spark, sf).select("p_partkey", C.over("code", C.short_functions, "string").alias("reason"), C.over("code", C.only_raises, "boolean").alias("unfinished"))


@query("code_answers", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS answer, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS wrong FROM part")
def answers(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit(r"so \boxed{1} then \boxed{{ "), size, F.lit("}.} and "), size, F.lit(" + 1 = "), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string"))
    p = read(spark, sf, "part").select("p_partkey", text.alias("t"))
    return p.select("p_partkey", F.rtrim(F.regexp_replace(C.over(C.over("t", C.boxed, "string"), C.math_answer, "string"), "[{}.]", "")).alias("answer"), C.over("t", C.wrong_equations, "int").alias("wrong"))


@query("markup_text")
def markup_text(spark, sf):
    x = read(spark, sf, "pages").select("page_id", M.html_text("html").alias("x"), M.html_markdown("html").alias("markdown"))
    return x.select("page_id", "x.text", "x.n_images", F.md5("markdown").alias("markdown_md5"))


@query("text_folded", "SELECT doc_id, md5(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def folded(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(M.folded("text")).alias("digest"))


@query(
    "code_values",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '3' || chr(10) || p_size || ' 2 -1' || chr(10) WHEN 1 THEN p_name || chr(10) WHEN 2 THEN '1' || chr(10) WHEN 3 THEN '2' || chr(10) || 'a b' || chr(10) || chr(10)
WHEN 4 THEN '1' || chr(10) || 'size' || chr(10) || '1' || chr(10) || p_size || chr(10) ELSE 'int' || chr(10) || p_size || chr(10) END AS text FROM part""",
)
def values(spark, sf):
    """Examples as a program reads them, where both ways of writing give them back."""
    from corpusloom.functions import values as V

    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    examples = (
        F.when(k == 0, F.concat(F.lit("[["), size, F.lit(", 2, -1], []]"))).when(k == 1, F.concat(F.lit('["'), "p_name", F.lit('", ""]'))).when(k == 2, F.lit("[true, false]"))
        .when(k == 3, F.lit('[["a b", ""], []]')).when(k == 4, F.concat(F.lit('[{"size": ['), size, F.lit("]}, {}]"))).otherwise(F.concat(F.lit("["), size, F.lit(', "x\\ny", null, [1, true, {"a": 2.5}]]')))
    )
    return read(spark, sf, "part").select("p_partkey", C.over(examples, V.round_trip, "string").alias("text"))
