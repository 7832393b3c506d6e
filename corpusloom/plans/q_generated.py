"""Generated rows, whose answers SQL works out again."""

from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.operators import generators as G
from corpusloom.operators import sampling as S
from corpusloom.plans.registry import query


def draw(k: int, size: int, n: str = "id") -> str:
    return f"CAST((({n} + 1) * 7919 + {k} * ({n} + 13) * 31 + {k * 17}) % {size} AS INTEGER)"


LIST = f"[{', '.join(draw(k, 31) for k in range(1, 9))}][1:{draw(0, 6)} + 3]"
RANGE = "(SELECT range AS id FROM range({n}))"


@query(
    "generate_strict",
    f"""SELECT id, kind, CAST(CASE kind WHEN 'sum' THEN list_sum(v) WHEN 'maximum' THEN list_max(v) WHEN 'minimum' THEN list_min(v) WHEN 'spread' THEN list_max(v) - list_min(v) WHEN 'count' THEN len(v)
 WHEN 'distinct' THEN len(list_distinct(v)) WHEN 'even' THEN len(list_filter(v, lambda x: x % 2 = 0)) WHEN 'above' THEN len(list_filter(v, lambda x: x > 15)) WHEN 'first' THEN v[1] WHEN 'last' THEN v[-1] WHEN 'second' THEN list_sort(v)[2]
 WHEN 'alternating' THEN list_sum(list_transform(v, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE -x END)) WHEN 'remainder' THEN list_sum(v) % 7 WHEN 'divisor' THEN list_reduce(v, lambda a, b: gcd(a, b))
 WHEN 'rises' THEN len(list_filter(range(2, len(v) + 1), lambda i: v[i] > v[i - 1])) END AS INTEGER) AS answer
FROM (SELECT id, ['sum', 'maximum', 'minimum', 'spread', 'count', 'distinct', 'even', 'above', 'first', 'last', 'second', 'alternating', 'remainder', 'divisor', 'rises'][id % 15 + 1] AS kind, {LIST} AS v FROM {RANGE.format(n=3000)})""",
)
def strict(spark, sf):
    return G.strict_questions(spark, 3000).select("id", "kind", "answer")


@query(
    "generate_chains",
    f"""SELECT id, family, CASE family WHEN 'two_sums' THEN a + b + c WHEN 'price' THEN a * b + c WHEN 'change' THEN 100 - b - c WHEN 'perimeter' THEN 2 * (a + b) WHEN 'area' THEN a * b WHEN 'distance' THEN a * (c - b)
 WHEN 'difference' THEN a - b - c WHEN 'shares' THEN c WHEN 'squares' THEN a * a + b * b ELSE 10 * a + b END AS answer, CAST(0 AS INTEGER) AS wrong
FROM (SELECT id, ['two_sums', 'price', 'change', 'perimeter', 'area', 'distance', 'difference', 'shares', 'squares', 'tens'][id % 10 + 1] AS family, {draw(1, 20)} + 1 AS a, {draw(2, 20)} + 1 AS b, {draw(3, 20)} + 1 AS c FROM {RANGE.format(n=2000)})""",
)
def chains(spark, sf):
    """Every equation is worked out again, exactly, and the last one gives the answer."""
    out = G.worked_chains(spark, 2000)
    last = F.regexp_extract("steps", r"= (-?\d+)$", 1).cast("int")
    return out.where(last == F.col("answer")).select("id", "family", "answer", C.over("steps", C.wrong_equations, "int").alias("wrong"))


@query("generate_rule_pairs", f"SELECT id AS pair, count(*) AS n, string_agg(answer, ',' ORDER BY answer) AS answers FROM (SELECT id, unnest(['mail', 'ship']) AS answer FROM {RANGE.format(n=500)}) GROUP BY id")
def pairs(spark, sf):
    out = G.rule_pairs(spark, 500)
    weight, limit = F.regexp_extract("prompt", r"weighs (\d+)", 1).cast("int"), F.regexp_extract("prompt", r"above (\d+)", 1).cast("int")
    right = out.where(F.when(weight > limit, "ship").otherwise("mail") == F.col("answer"))
    return right.groupBy("pair").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("answer")), ",").alias("answers"))


ENTRY = "'Entry ' || k || ': ' || CASE WHEN a >= 0 THEN '+' ELSE '' END || a || chr(10)"


@query(
    "generate_ledgers",
    f"""SELECT id, CAST(count(*) AS INTEGER) AS n_entries, CAST(sum(n) AS INTEGER) AS n_chars, CAST(sum(a) AS INTEGER) AS balance, md5(string_agg(t, '' ORDER BY k)) AS digest FROM (
 SELECT *, sum(n) OVER (PARTITION BY id ORDER BY k) AS upto FROM (SELECT id, k, a, {ENTRY} AS t, length({ENTRY}) AS n FROM (
  SELECT id, k, CAST(((id + 1) * 7919 + k * (id + 13) * 31 + k * 17) % 199 - 99 AS INTEGER) AS a FROM {RANGE.format(n=60)}, range(1, 400) t(k)))) WHERE upto <= 3000 GROUP BY id""",
)
def ledgers(spark, sf):
    return G.ledgers(spark, 60, 3000).select("id", "n_entries", "n_chars", "balance", F.md5("text").alias("digest"))


def _choice(names: list[str], k: int) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][{draw(k, len(names))} + 1]"


@query("generate_templates", f"SELECT id, {_choice(G.WHO, 1)} || ' buys ' || ({draw(2, 90)} + 10) || ' ' || {_choice(G.WHAT, 3)} || ' in ' || {_choice(G.WHERE, 4)} || '.' AS text FROM {RANGE.format(n=1000)}")
def templates(spark, sf):
    return G.template_sentences(spark, 1000)


@query(
    "generate_curriculum",
    f"""SELECT id, family, CASE WHEN family = 'multi_turn' THEN 4 ELSE 2 END AS n, CASE family WHEN 'sequence' THEN array_to_string(list_filter(v, lambda x: x % 2 = 0), ', ') WHEN 'entity' THEN city WHEN 'condition' THEN CASE WHEN age > other THEN 'yes' ELSE 'no' END
 WHEN 'protocol' THEN '{{"name":"' || who || '","age":' || age || '}}' WHEN 'boundary' THEN '0' WHEN 'multi_turn' THEN CAST(list_min(v) AS VARCHAR) WHEN 'missing' THEN 'That is not told.' ELSE CAST(len(v) AS VARCHAR) END AS answer
FROM (SELECT id, ['sequence', 'entity', 'condition', 'protocol', 'boundary', 'multi_turn', 'missing', 'code'][id % 8 + 1] AS family, {LIST} AS v, {_choice(G.WHO, 11)} AS who, {_choice(G.WHERE, 12)} AS city, {draw(13, 60)} + 18 AS age, {draw(14, 60)} + 18 AS other FROM {RANGE.format(n=1600)})""",
)
def curriculum(spark, sf):
    return G.curriculum(spark, 1600).select("id", "family", F.size("messages").alias("n"), F.element_at("messages", -1)["content"].alias("answer"))


@query("generate_exercises", "SELECT count(*) AS n, 8 AS families, 4000 AS n_right, 4000 AS n_different FROM range(4000)")
def exercises(spark, sf):
    """Exercises over lists, all answers found right by other means than they were made."""
    out = G.exercises(spark, 4000)
    check = F.udf(lambda family, prompt, answer: G.check(family, prompt, answer), "boolean", useArrow=True)
    return out.agg(F.count("*").alias("n"), F.count_distinct("family").cast("int").alias("families"), F.count_if(check("family", "prompt", "answer")).cast("int").alias("n_right"), F.count_distinct("id").cast("int").alias("n_different"))


@query("generate_anchors", "SELECT q AS prompt, a AS answer, CAST(r AS INTEGER) AS round FROM (VALUES ('Who are you?', 'A model.'), ('What can you do?', 'Answer.')) t(q, a), range(5) s(r)")
def anchors(spark, sf):
    return G.anchors(spark, [("Who are you?", "A model."), ("What can you do?", "Answer.")], 5)


@query("generate_units", "SELECT * FROM (VALUES (1, 30), (3, 60), (4, 10)) t(unit, tokens)")
def units(spark, sf):
    """Pairs stay together in a budget of 100: one that doesn't fit is left out whole."""
    import pandas as pd

    return spark.createDataFrame(S.units_in_budget(pd.DataFrame({"unit": [1, 2, 3, 4], "tokens": [30, 80, 60, 10]}), 100).astype("int32"), "unit int, tokens int")
