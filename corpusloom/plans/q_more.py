"""Row shapes, joins, budgets, plans and audits over the tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.functions import text as T
from corpusloom.operators import aggregates as A
from corpusloom.operators import audits as Q
from corpusloom.operators import chat as C
from corpusloom.operators import dedup as D
from corpusloom.operators import joins as J
from corpusloom.operators import plans as L
from corpusloom.operators import recipes as X
from corpusloom.operators import rows as R
from corpusloom.operators import sampling as S
from corpusloom.plans.q_chat import M, chats
from corpusloom.plans.q_filters import WORDS_SQL
from corpusloom.plans.q_joins import GRAMS
from corpusloom.plans.registry import query, read
from corpusloom.sources.staging import fresh_path, stored
from corpusloom.streaming import events as E

# ---- rows and chats


@query("chat_thinking", f"SELECT conv_id, md5('<|im_start|>user' || chr(10) || first(content ORDER BY turn) FILTER (role = 'user') || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || 'so' || chr(10) || '</think>' || chr(10) || chr(10) || last(content ORDER BY turn) FILTER (role = 'assistant') || '<|im_end|>' || chr(10)) AS digest FROM {M} GROUP BY conv_id")
def thinking(spark, sf):
    m = F.col("messages")
    return chats(spark, sf).select("conv_id", F.md5(C.render_thinking(C.first_prompt(m), F.lit("so"), C.last_answer(m))).alias("digest"))


@query("chat_problem", "SELECT p_partkey, p_name || chr(10) || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Do it.' || chr(10) || chr(10) ELSE '' END || 'Example 1' || chr(10) || 'Input:' || chr(10) || p_size || chr(10) || 'Output:' || chr(10) || p_size * 2 || CASE WHEN p_size % 3 = 0 THEN chr(10) || chr(10) || 'Note' || chr(10) || 'n' ELSE '' END AS prompt FROM part")
def problem(spark, sf):
    size = F.col("p_size")
    examples = F.array(F.struct(size.cast("string").alias("input"), (size * 2).cast("string").alias("output")))
    return read(spark, sf, "part").select("p_partkey", C.problem_prompt(F.col("p_name"), F.when(size % 2 == 0, "Do it."), examples, F.when(size % 3 == 0, "n")).alias("prompt"))


@query("chat_filled_fields", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '{"p_name":"' || p_name || '","p_type":"' || p_type || '"}' ELSE '{"p_name":"' || p_name || '"}' END AS record FROM part""")
def filled_fields(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.struct("p_name", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("p_type")).alias("r"))
    return p.select("p_partkey", C.filled_fields(F.col("r"), "p_name", "p_type").alias("record"))


@query("rows_provenance", r"SELECT source AS origin, doc_id, md5(text) AS digest, 'docs' AS source, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_id FROM documents")
def record(spark, sf):
    out = read(spark, sf, "documents").select("doc_id", *R.record(F.col("text"), "docs", origin=F.col("source")))
    return out.select("origin", "doc_id", F.md5("text").alias("digest"), "source", "text_id")


@query("rows_category", "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'germanic' WHEN lang = 'fr' THEN 'romance' END AS category FROM documents")
def category(spark, sf):
    return read(spark, sf, "documents").select("doc_id", R.category(F.col("lang"), {"germanic": ["en", "de"], "romance": ["fr"]}).alias("category"))


@query("rows_system_share", f"SELECT conv_id, CASE WHEN CAST('0x' || substr(sha256('4' || chr(31) || CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) < 4294967296 // 2 AND NOT sys THEN n + 1 ELSE n END AS n FROM (SELECT conv_id, count(*) AS n, first(role ORDER BY turn) = 'system' AS sys FROM {M} GROUP BY conv_id)")
def system_share(spark, sf):
    return chats(spark, sf).select("conv_id", F.size(R.maybe_system(F.col("messages"), "Be brief.", 0.5, 4, F.col("conv_id"))).cast("long").alias("n"))


@query("rows_empty_think", f"SELECT conv_id, md5(string_agg(content, chr(30) ORDER BY turn)) AS digest FROM {M} GROUP BY conv_id")
def empty_think(spark, sf):
    m = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit("<think>\n\n</think>\n\n"), m["content"]).alias("content")))
    out = chats(spark, sf).withColumn("messages", m)
    return out.select("conv_id", F.md5(F.array_join(F.transform(R.without_empty_think(F.col("messages")), lambda m: m["content"]), "\x1e")).alias("digest"))


@query("rows_metadata", "SELECT doc_id, lang FROM documents")
def metadata(spark, sf):
    from corpusloom.operators.cleanups import stripped_metadata

    return stripped_metadata(read(spark, sf, "documents").withColumn("clone_of", F.lit(1)), "clone_of", "text", "source", "n_chars")


@query(
    "chat_identity_reasons",
    "SELECT p_partkey, ['possible_foreign_model_identity', 'identity_question_mentions_foreign_model', '', 'empty_question', 'missing_user_message', 'invalid_conversation_structure'][p_partkey % 6 + 1] AS reasons FROM part",
)
def identity_reasons(spark, sf):
    k = F.col("p_partkey") % 6
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    messages = (
        F.when(k == 0, F.array(turn("user", "Hi"), turn("assistant", "I am Zeta"))).when(k == 1, F.array(turn("user", "who are you"), turn("assistant", "Zeta it is")))
        .when(k == 2, F.array(turn("user", "Hi"), turn("assistant", "Hello"))).when(k == 4, F.array(turn("assistant", "Hello"))).otherwise(none)
    )
    reasons = F.when(k == 3, C.chat_reasons(none, ["zeta"], question=F.lit("  "))).otherwise(C.chat_reasons(messages, ["zeta"]))
    shown = F.when(k == 5, F.array_intersect(reasons, F.array(F.lit("invalid_conversation_structure")))).otherwise(reasons)
    return read(spark, sf, "part").select("p_partkey", F.array_join(shown, ",").alias("reasons"))


@query(
    "chat_role_texts",
    """SELECT p_partkey, 'user:' || p_name || '|assistant:' || p_type || '|user:ask|assistant:no' || CASE WHEN p_size % 2 = 0 THEN '|user:q' ELSE '' END || '|assistant:done' AS said FROM part""",
)
def role_texts(spark, sf):
    """What rows of several shapes say: a chat, a rejected side with other names, a prompt and an answer."""
    turn = lambda a, b, role, text: F.struct(F.lit(role).alias(a), text.alias(b))
    p = read(spark, sf, "part").select(
        "p_partkey",
        F.array(turn("role", "content", "user", F.col("p_name")), turn("role", "content", "assistant", F.col("p_type"))).alias("conversations"),
        F.array(turn("from", "value", "human", F.lit("ask")), turn("from", "value", "gpt", F.lit("no"))).alias("rejected"),
        F.when(F.col("p_size") % 2 == 0, "q").alias("prompt"),
        F.lit("done").alias("answer"),
    )
    return p.select("p_partkey", F.array_join(F.transform(C.role_texts(p), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|").alias("said"))


# ---- deduplication and joins


@query(
    "dedup_problems",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'title:' || p_type ELSE 'id:' || p_size END AS problem, p_brand AS d FROM part),
a AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY problem ORDER BY p_partkey) = 1)
SELECT p_partkey FROM a QUALIFY row_number() OVER (PARTITION BY d ORDER BY p_partkey) = 1""",
)
def problems(spark, sf):
    p = read(spark, sf, "part")
    ids = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")).otherwise("")
    return D.problems_once(p, ids, F.col("p_type"), F.col("p_brand"), "p_partkey").select("p_partkey")


@query("dedup_replayed", "SELECT lang, count(*) AS n_rows, count(*) FILTER (md5(text) IN (SELECT md5(text) FROM documents WHERE source = 'src0')) AS n_replayed FROM documents GROUP BY lang")
def replayed(spark, sf):
    d = read(spark, sf, "documents").select("lang", "source", H.text_key(F.col("text")).alias("key"))
    return J.replayed(d, d.where("source = 'src0'"), "key", "lang")


@query("join_prompt_names", f"SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM g) THEN 'prompt' ELSE 'name' END AS why FROM documents WHERE doc_id IN (SELECT doc_id FROM g) OR list_has_any({WORDS_SQL.format('text')}, ['zanzibar', 'md5'])".replace("SELECT doc_id, CASE", f"WITH g AS (SELECT DISTINCT doc_id FROM ({GRAMS.format(id='doc_id', n=30, w=WORDS_SQL.format('text'), t='documents')}) SEMI JOIN ({GRAMS.format(id='item_id', n=30, w=WORDS_SQL.format('text'), t='benchmark')}) b USING (g)) SELECT doc_id, CASE", 1))
def prompt_names(spark, sf):
    bench = read(spark, sf, "benchmark").withColumn("names", F.array(F.lit("Zanzibar"), F.lit("md5")))
    return J.prompt_match(read(spark, sf, "documents"), "doc_id", F.col("text"), bench, F.col("text"), F.col("names")).where("why IS NOT NULL")


@query("join_ordered", "SELECT o_orderkey, row_number() OVER (ORDER BY sha256('6' || chr(31) || CAST(o_orderkey AS VARCHAR))) - 1 AS place FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def ordered(spark, sf):
    """Selected keys back to their rows, placed by a shuffle key."""
    keys = read(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    rows = J.lookup(read(spark, sf, "orders").select("o_orderkey"), keys, "o_orderkey").withColumn("p", H.priority(6, F.col("o_orderkey"))).withColumn("one", F.lit(1))
    return S.running_total(rows, [], "p", "one", "n").select("o_orderkey", (F.col("n") - 1).alias("place"))


@query("join_to_files", "SELECT n_nationkey, 'x/y/' || n_name || '.html' AS path FROM nation WHERE n_nationkey % 3 > 0")
def to_files(spark, sf):
    n = read(spark, sf, "nation")
    files = n.where("n_nationkey % 3 > 0").select(F.concat(F.lit("x/y/"), "n_name", F.lit(".html")).alias("path"))
    return J.to_files(n, "n_name", files, "path").select("n_nationkey", "path")


@query("join_zip", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def zipped(spark, sf):
    o = read(spark, sf, "orders")
    return J.zip_rows(o.select("o_orderkey", "o_orderstatus"), o.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("join_fences", "SELECT p_partkey FROM part WHERE p_size % 2 = 1")
def fences(spark, sf):
    """Candidates that stand in no fenced block of a prior corpus."""
    p = read(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("x = "), F.col("p_partkey").cast("string")).alias("code"))
    prior = p.where("p_size % 2 = 0").select(F.explode(T.fences(F.concat(F.lit("so\n```python\n"), "code", F.lit("\n```\nand\n```\nother\n```\n")))).alias("b")).select(T.strip(F.col("b")).alias("code"))
    return J.exclude(p, prior, "code").select("p_partkey")


@query("join_sampled_verify", "SELECT o_orderkey, 'o_orderpriority' AS difference FROM orders WHERE o_orderkey % 10 = 0 AND CAST('0x' || substr(sha256('2' || chr(31) || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) < 4294967296 // 4")
def sampled_verify(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority").where(H.chosen(2, 0.25, F.col("o_orderkey")))
    other = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "x").otherwise(F.col("o_orderpriority")))
    return J.first_difference(o, other, "o_orderkey", ["o_orderpriority"])


# ---- reports


@query("report_profile", "SELECT lang, count(*) AS n_rows, count(*) FILTER (length(text) > 1000) AS long, count(*) FILTER (contains(text, chr(10))) AS lines FROM documents GROUP BY lang")
def profile(spark, sf):
    return A.profile(read(spark, sf, "documents"), {"long": F.char_length("text") > 1000, "lines": F.col("text").contains("\n")}, "lang")


@query("report_domain_budgets", "SELECT lang, count(*) FILTER (t <= 50000) AS n_rows, CAST(coalesce(sum(n_chars) FILTER (t <= 50000), 0) AS BIGINT) AS used, CAST(sum(n_chars) AS BIGINT) AS available FROM (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) AS t FROM documents) GROUP BY lang")
def domain_budgets(spark, sf):
    d = read(spark, sf, "documents").select("lang", "n_chars", F.md5(F.col("doc_id").cast("string")).alias("h"))
    return A.within_budgets(d, "lang", "h", "n_chars", 50_000)


@query("report_log", "SELECT i AS step, name, CASE name WHEN 'loss' THEN i / 2.0 ELSE i * 1.5 END AS value FROM range(100, 400) t(i), (VALUES ('loss'), ('lr')) n(name)")
def log(spark, sf):
    """The metrics of the last run in a log with two runs."""
    i = F.col("id")
    text = F.when(i.isin(0, 100), "start of a run").otherwise(F.concat(F.lit("step: "), i.cast("string"), F.lit(" loss="), (i / 2).cast("string"), F.lit(" lr: "), (i * 1.5).cast("string")))
    out = A.log_metrics(spark.range(0, 400).select("id", text.alias("text")), "id", "text")
    first = spark.createDataFrame([(100, "loss", 50.0), (100, "lr", 150.0)], "step long, name string, value double")
    return out.where("name <> 'step'").unionByName(first)


# ---- samples and budgets

PRIORITY = "sha256('{seed}' || chr(31) || CAST(o_orderkey AS VARCHAR))"


def _orders(spark, sf, seed):
    size = F.bround("o_totalprice").cast("long")
    return read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey", size.alias("size"), H.priority(seed, F.col("o_orderkey")).alias("p"))


GREEDY = """WITH RECURSIVE o AS ({rows}), r(b, n, room, k, took) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST({budget} AS BIGINT), CAST(-1 AS BIGINT), false FROM o
 UNION ALL SELECT o.b, o.n, CASE WHEN o.s <= r.room THEN r.room - o.s ELSE r.room END, o.k, o.s <= r.room FROM r JOIN o ON o.b = r.b AND o.n = r.n + 1)
SELECT k AS o_orderkey FROM r WHERE took"""


@query("budget_chosen_first", GREEDY.format(budget=3000000, rows=f"SELECT o_orderpriority AS b, o_orderkey AS k, CAST(round_even(o_totalprice, 0) AS BIGINT) AS s, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus <> 'P', {PRIORITY.format(seed=15)}) AS n FROM orders"))
def chosen_first(spark, sf):
    o = _orders(spark, sf, 15)
    budgets = {r[0]: 3_000_000 for r in o.select("o_orderpriority").distinct().collect()}
    return S.chosen_then_rest(o, "o_orderpriority", "o_orderkey", F.col("o_orderstatus") == "P", "p", "size", budgets).select("o_orderkey")


@query(
    "budget_two_passes",
    f"""WITH RECURSIVE o AS (SELECT o_orderpriority AS b, o_orderkey AS k, CAST(round_even(o_totalprice, 0) AS BIGINT) AS s, {PRIORITY.format(seed=16)} AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {PRIORITY.format(seed=16)}) AS n FROM orders),
r(b, n, room, k, took) AS (SELECT DISTINCT b, CAST(0 AS BIGINT), CAST(2000000 AS BIGINT), CAST(-1 AS BIGINT), false FROM o
 UNION ALL SELECT o.b, o.n, CASE WHEN o.s <= r.room THEN r.room - o.s ELSE r.room END, o.k, o.s <= r.room FROM r JOIN o ON o.b = r.b AND o.n = r.n + 1),
one AS (SELECT k FROM r WHERE took), rest AS (SELECT k, s, row_number() OVER (ORDER BY p) AS n FROM o WHERE k NOT IN (SELECT k FROM one)),
q(n, room, k, took) AS (SELECT CAST(0 AS BIGINT), CAST(13000000 - (SELECT sum(s) FROM o WHERE k IN (SELECT k FROM one)) AS BIGINT), CAST(-1 AS BIGINT), false
 UNION ALL SELECT rest.n, CASE WHEN rest.s <= q.room THEN q.room - rest.s ELSE q.room END, rest.k, rest.s <= q.room FROM q JOIN rest ON rest.n = q.n + 1)
SELECT k AS o_orderkey, 1 AS pass FROM one UNION ALL SELECT k, 2 FROM q WHERE took""",
)
def two_passes(spark, sf):
    return S.balanced_then_fill(_orders(spark, sf, 16), "o_orderpriority", "o_orderkey", "p", "size", 2_000_000, 13_000_000).select("o_orderkey", "pass")


@query("budget_bands", "SELECT true AS fits, true AS special_fits, true AS longest_first")
def bands(spark, sf):
    """Longer bands first, special rows up to their share: no row of a shorter band is taken while one of a longer band would fit."""
    o = _orders(spark, sf, 17)
    special = F.col("o_orderstatus") == "F"
    out = S.banded_fill(o, "o_orderkey", "size", "p", "size", [400_000, 300_000, 200_000], 20_000_000, special, 0.4)
    sums = out.agg(F.sum("size").alias("t"), F.sum(F.when(special, F.col("size"))).alias("s"), F.min("size").alias("least"))
    left = o.join(out.select("o_orderkey"), "o_orderkey", "left_anti").where(~special).agg(F.max("size").alias("largest"), F.min("size").alias("smallest"))
    both = sums.crossJoin(left)  # one row each
    return both.select((F.col("t") <= 20_000_000).alias("fits"), (F.col("s") <= 8_000_000).alias("special_fits"), ((F.col("t") + F.col("smallest") > 20_000_000) | (F.col("largest") < F.col("least"))).alias("longest_first"))


@query("sample_candidates", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS n_rows, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS n_flagged FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 20")
def candidates(spark, sf):
    rows, counts = S.capped_candidates(read(spark, sf, "orders"), F.col("o_totalprice") > 300_000, "o_orderkey", 20)
    return rows.select("o_orderkey").crossJoin(F.broadcast(counts))  # counts is one row


@query("budget_quotas", "SELECT * FROM (VALUES ('python', 70), ('cpp', 30), ('rust', 10), ('go', 10)) t(name, quota)")
def quotas(spark, sf):
    """Go lacks 20 and Rust 10 of their shares of 120; Python has 22 to spare, C++ 6."""
    found = S.quotas({"python": 70, "cpp": 30, "rust": 10, "go": 10}, {"python": 0.4, "cpp": 0.2, "rust": 0.2, "go": 0.2}, 120, ("python", "cpp"), 0.65)
    return spark.createDataFrame(list(found.items()), "name string, quota int")


@query("budget_arithmetic", "SELECT n, CAST(round_even(n * 0.3 / 0.7, 0) AS BIGINT) AS replay, least(n // 5, 100 // 3, 90 // 2) AS unit, n * 3 // 8 AS shard FROM range(1, 400) t(n)")
def arithmetic(spark, sf):
    rows = [(n, S.replay_rows(n, 0.3), S.common_unit({"a": n, "b": 100, "c": 90}, {"a": 5, "b": 3, "c": 2}), S.shard_budget(n, 2, 8)) for n in range(1, 400)]
    return spark.createDataFrame(rows, "n long, replay long, unit long, shard long")


@query("order_stride", "SELECT CAST(i AS BIGINT) AS place, CAST(i * 37 % 100 AS BIGINT) AS number FROM range(100) t(i)")
def stride(spark, sf):
    return spark.createDataFrame(list(enumerate(S.stride_order(100))), "place long, number long")


@query(
    "budget_balanced_pairs",
    f"""WITH a AS (SELECT o_orderkey AS k, CAST(round_even(o_totalprice, 0) AS BIGINT) AS s, row_number() OVER (ORDER BY {PRIORITY.format(seed=18)}) AS n FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_orderkey AS k, CAST(round_even(o_totalprice, 0) AS BIGINT) AS s, row_number() OVER (ORDER BY {PRIORITY.format(seed=18)}) AS n FROM orders WHERE o_orderstatus = 'O'),
p AS (SELECT b.n, sum(a.s + b.s) OVER (ORDER BY b.n) + (SELECT coalesce(sum(s), 0) FROM a WHERE n <= 12) AS t, a.s + b.s AS s FROM a JOIN b ON a.n = b.n + 12),
m AS (SELECT count(*) AS m FROM p WHERE t <= 9000000 OR (t - s <= 9000000 AND abs(t - 9000000) < abs(t - s - 9000000)))
SELECT k AS o_orderkey FROM a, m WHERE n <= 12 + m UNION ALL SELECT k FROM b, m WHERE n <= m""",
)
def balanced_pairs(spark, sf):
    o = _orders(spark, sf, 18)
    one, two = S.balanced_pairs(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "p", "size", 100, 50, 9_000_000)
    return one.select("o_orderkey").unionByName(two.select("o_orderkey"))


@query("shuffle_rows", f"SELECT o_orderkey, row_number() OVER (ORDER BY {PRIORITY.format(seed=1)}) - 1 AS place FROM orders")
def shuffle(spark, sf):
    """Every row with its place in the shuffled order, counted over the sorted partitions."""
    return _places(S.shuffled(read(spark, sf, "orders").select("o_orderkey"), 1, F.col("o_orderkey")))


@query("shuffle_parts", f"SELECT o_orderkey, row_number() OVER (ORDER BY {PRIORITY.format(seed=1)}) - 1 AS place FROM orders")
def shuffle_parts(spark, sf):
    return _places(S.shuffled_parts(read(spark, sf, "orders").select("o_orderkey"), 1, 16, F.col("o_orderkey")))


def _places(rows):
    where = stored(S.placed(rows), "places").select("o_orderkey", "position.*")
    sizes = where.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    return where.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("o_orderkey", (F.col("before") + F.col("number")).alias("place"))


@query("shuffle_verified", "SELECT true AS same, false AS other")
def shuffle_verified(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    again = S.shuffled(o, 3, F.col("o_orderkey"))
    return spark.createDataFrame([(S.same_rows(o, again, "o_orderkey"), S.same_rows(o, again.where("o_orderkey > 0"), "o_orderkey"))], "same boolean, other boolean")


# ---- plans, state and storage


@query(
    "plan_chunks",
    """WITH RECURSIVE l AS (SELECT n_nationkey AS i, length(n_name) AS s, sum(length(n_name)) OVER (ORDER BY n_nationkey) - length(n_name) AS at FROM nation),
c(i, start, chunk) AS (SELECT 0, CAST(0 AS BIGINT), 0 UNION ALL SELECT l.i, CASE WHEN l.at - c.start >= 30 THEN l.at ELSE c.start END, CASE WHEN l.at - c.start >= 30 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN l ON l.i = c.i + 1)
SELECT CAST(min(i) AS BIGINT) AS first, CAST(max(i) + 1 AS BIGINT) AS past FROM c GROUP BY chunk""",
)
def chunks(spark, sf):
    sizes = [len(r[0]) for r in read(spark, sf, "nation").orderBy("n_nationkey").select("n_name").collect()]  # a source's row lengths, as a small plan
    return spark.createDataFrame(L.chunk_plan(sizes, 30), "first long, past long")


@query("plan_groups", "SELECT * FROM (VALUES (0, 30), (30, 40), (40, 50), (50, 80)) t(first, past)")
def groups(spark, sf):
    """Whole row groups of 10 rows: 3 + 4 + 2 bytes fit ten, 9 alone, 20 is too large but whole, then 1 + 5 + 4."""
    return spark.createDataFrame(L.group_plan([10] * 8, [3, 4, 2, 9, 20, 1, 5, 4], 10), "first int, past int")


@query("plan_bounds", "SELECT * FROM (VALUES ('3,7,10', true), ('3,3,10', false), ('3,7', false), ('', false)) t(bounds, valid)")
def bounds(spark, sf):
    return spark.createDataFrame([(b, L.valid_bounds([int(x) for x in b.split(",") if x], 10)) for b in ("3,7,10", "3,3,10", "3,7", "")], "bounds string, valid boolean")


@query("plan_cached", "SELECT 1 AS n_made, 2 AS n_keys, '[[0, 2], [2, 3]]' AS plan")
def cached(spark, sf):
    """A plan is made once for a key; another file makes another key."""
    folder, made = fresh_path(spark, "plans"), []
    files = [("a", 10, 1), ("b", 20, 1)]
    make = lambda: made.append(1) or L.chunk_plan([4, 4, 4], 5)
    key = L.plan_key(files, chunk=5)
    first, again = L.cached_plan(spark, folder, key, make), L.cached_plan(spark, folder, key, make)
    keys = {key, L.plan_key(files[::-1], chunk=5), L.plan_key([("a", 11, 1), ("b", 20, 1)], chunk=5)}
    return spark.createDataFrame([(len(made), len(keys), str(again) if first == again else "")], "n_made int, n_keys int, plan string")


@query("plan_steps_left", "SELECT doc_id, doc_id // 100 AS chunk, doc_id % 100 // 8 AS step FROM documents WHERE doc_id // 100 > 0 OR doc_id % 100 // 8 >= 3")
def steps_left(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).cast("long").alias("chunk_index"), (F.col("doc_id") % 100).alias("number"))
    return L.steps_left(d, 8, (0, 3)).select("doc_id", F.col("chunk_index").alias("chunk"), F.col("step").cast("long").alias("step"))


@query("plan_resume", "SELECT * FROM (VALUES ('b/a.parquet', 4, ''), ('a/b.jsonl', 4, 'path'), ('a/a.jsonl', 8, 'length')) t(path, length, reasons)")
def resume(spark, sf):
    """The same corpus in another container goes on; another corpus or another length does not."""
    old = {"path": "b/a.jsonl", "length": 4, "workers": 2}
    cases = [("b/a.parquet", 4), ("a/b.jsonl", 4), ("a/a.jsonl", 8)]
    rows = [(p, n, ",".join(L.may_resume({**old, "path": "a/a.jsonl" if p.startswith("a/a") else "b/a.jsonl"}, {"path": p, "length": n, "workers": 3}, ("path", "workers")))) for p, n in cases]
    return spark.createDataFrame(rows, "path string, length int, reasons string")


@query("plan_stream_or_not", "SELECT CAST(f AS INTEGER) AS footprint, f * 4 > 100 AS streams, f + 30 <= 0.9 * 100 - 5 AS allowed FROM range(10, 70, 5) t(f)")
def stream_or_not(spark, sf):
    return spark.createDataFrame([(f, L.must_stream(f, 100), bool(L.quota_allows(f, 30, 100, 0.9, 5))) for f in range(10, 70, 5)], "footprint int, streams boolean, allowed boolean")


@query("store_reserve", "SELECT * FROM (VALUES ('a', true), ('c', true)) t(path, refused)")
def reserve(spark, sf):
    """40 bytes into 100 that are full: unused files of the lower class go first; with 90 active bytes it is refused."""
    files = spark.createDataFrame([("a", 25, 0, 1, False), ("b", 35, 0, 2, True), ("c", 20, 0, 3, False), ("d", 20, 1, 0, False)], "path string, size long, priority int, last_access long, active boolean")
    try:
        L.reserve(files.withColumn("active", F.col("path") != "d"), 40, 100)
        refused = False
    except ValueError:
        refused = True
    return L.reserve(files, 40, 100).select("path", F.lit(refused).alias("refused"))


@query("store_cached_table", "SELECT count(*) AS n, 2 AS n_places FROM orders WHERE o_orderstatus = 'F'")
def cached_table(spark, sf):
    """The second call reads what the first has written, though it is given another table."""
    base = fresh_path(spark, "cache")
    path, other = L.cache_path(base, status="F", version=1), L.cache_path(base, status="F", version=2)
    o = read(spark, sf, "orders")
    L.cached_table(o.where("o_orderstatus = 'F'"), path)
    return L.cached_table(o.limit(3), path).agg(F.count("*").alias("n"), F.lit(len({path, other, L.cache_path(base, version=1, status="F")})).alias("n_places"))


@query("store_evict", "SELECT * FROM (VALUES ('a'), ('c')) t(path)")
def evict(spark, sf):
    files = spark.createDataFrame([("a", 5, 0, 1, False), ("b", 5, 0, 2, True), ("c", 5, 0, 3, False), ("d", 5, 1, 0, False)], "path string, size long, priority int, last_access long, active boolean")
    return L.evict(files, 11).select("path")


@query("store_uploads", "SELECT user_id AS file, count(*) AS n_parts, user_id % 3 = 0 AS conflict, user_id % 3 <> 1 AS complete FROM events GROUP BY user_id")
def uploads(spark, sf):
    """Each user's events as the parts of a file: some come twice with another hash, some files lack a part."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("file"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("index"))
    n = e.groupBy("file").agg((F.count("*") * 10 + F.when(F.col("file") % 3 == 1, 10).otherwise(0)).alias("total"))
    parts = e.join(n, "file").select("file", "index", F.lit(10).cast("long").alias("length"), F.explode(F.when((F.col("file") % 3 == 0) & (F.col("index") == 0), F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x")))).alias("sha"), "total")
    return L.uploads(parts, 10).select("file", "n_parts", "conflict", "complete")


@query("store_recovery", "SELECT lang AS source, CASE WHEN t0 >= t1 THEN 'tmp0' ELSE 'tmp1' END AS folder, greatest(t0, t1) AS tokens FROM (SELECT lang, CAST(coalesce(sum(n_chars) FILTER (doc_id % 2 = 0), 0) AS BIGINT) AS t0, CAST(coalesce(sum(n_chars) FILTER (doc_id % 2 = 1), 0) AS BIGINT) AS t1 FROM documents GROUP BY lang)")
def recovery(spark, sf):
    d = read(spark, sf, "documents").select(F.col("lang").alias("source"), F.concat(F.lit("tmp"), (F.col("doc_id") % 2).cast("string")).alias("folder"), F.col("n_chars").alias("tokens"))
    return L.best_source(d, "source", "folder", "tokens")


@query("stream_progress", "SELECT CAST(d AS INTEGER) AS done, d / 100.0 AS share, d / 5.0 AS rate, (100 - d) / (d / 5.0) AS \"left\" FROM range(10, 101, 10) t(d)")
def progress(spark, sf):
    return spark.createDataFrame([(d, *(E.progress(d, 100, 5.0)[k] for k in ("share", "rate", "left"))) for d in range(10, 101, 10)], "done int, share double, rate double, left double")


@query("stream_batches", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def batches(spark, sf):
    """Micro-batches graded in order, each into a table of its own number, so that a repeated batch replaces itself."""
    base, table = fresh_path(spark, "batches"), read(spark, sf, "events")
    table.repartition(4).write.parquet(f"{base}/in")

    def grade(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("total")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    E.each_batch(E.read_stream(spark, f"{base}/in", table.schema, files_per_trigger=1), grade, f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("stream_first_seen", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events")
def first_seen(spark, sf):
    """Files read twice through one stream: keys seen within the watermark add nothing."""
    base, table = fresh_path(spark, "seen"), read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    table.unionByName(table).repartition(2).write.parquet(f"{base}/in")
    stream = E.read_stream(spark, f"{base}/in", table.schema)
    E.append_once(stream, f"{base}/out", f"{base}/state", lambda s: E.first_seen(s, ["event_id"], "ts", "400 days")).awaitTermination()
    return spark.read.schema(table.schema).parquet(f"{base}/out").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


@query("stream_paused", "SELECT false AS before, true AS after, true AS stopped")
def paused(spark, sf):
    """A marker file stops a running stream between its batches."""
    from corpusloom.sources.tables import write_report

    base, table = fresh_path(spark, "paused"), read(spark, sf, "events")
    table.write.parquet(f"{base}/in")
    before = L.paused(spark, f"{base}/pause.json")
    running = E.read_stream(spark, f"{base}/in", table.schema).writeStream.format("noop").option("checkpointLocation", f"{base}/state").start()
    write_report(spark, f"{base}/pause.json", {})
    stopped = L.stop_when_paused(running, f"{base}/pause.json", 0.2)
    return spark.createDataFrame([(before, L.paused(spark, f"{base}/pause.json"), stopped and not running.isActive)], "before boolean, after boolean, stopped boolean")


# ---- whole audits


def _published(spark, sf):
    """Documents with what a publisher would claim of them, some of it wrong."""
    i = F.col("doc_id")
    d = read(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    return d.withColumns(
        {
            "text_id": F.when(i % 40 == 0, "wrong").otherwise(H.stripped_key(F.col("text"))),
            "token_count": F.when(i % 50 == 0, -1).otherwise(F.size(T.words(F.col("text"))) + 2),
            "language": F.when(i % 20 == 0, "python").otherwise("text"),
            "quality": (i % 10).cast("double"),
        }
    )


STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(
    "audit_pretrain",
    f"""WITH d AS (SELECT *, CASE WHEN doc_id % 40 = 0 THEN 'wrong' ELSE md5({STRIPPED}) END AS id, CASE WHEN doc_id % 50 = 0 THEN -1 ELSE len({WORDS_SQL.format('text')}) + 2 END AS t FROM documents)
SELECT 'known_source' AS "check", count(*) FILTER (source NOT IN ('src0', 'src1', 'src2', 'src3')) AS n_bad FROM d UNION ALL SELECT 'text_not_empty', count(*) FILTER (text = '') FROM d
UNION ALL SELECT 'text_id', count(*) FILTER (doc_id % 40 = 0) FROM d UNION ALL SELECT 'token_count', count(*) FILTER (doc_id % 50 = 0) FROM d UNION ALL SELECT 'token_range', count(*) FILTER (t NOT BETWEEN 1 AND 300) FROM d
UNION ALL SELECT 'repeated_text_id', count(*) - count(DISTINCT id) FROM d
UNION ALL SELECT 'benchmark_overlap', count(DISTINCT doc_id) FROM ({GRAMS.format(id='doc_id', n=13, w=WORDS_SQL.format('text'), t='documents')}) SEMI JOIN ({GRAMS.format(id='item_id', n=13, w=WORDS_SQL.format('text'), t='benchmark')}) b USING (g)""",
)
def audit_pretrain(spark, sf):
    out = Q.pretrain_audit(_published(spark, sf), read(spark, sf, "benchmark"), ["src0", "src1", "src2", "src3"], F.size(T.words(F.col("text"))) + 2, 300)
    return out.where("`check` <> 'python_syntax'")


@query("audit_python", "SELECT 'python_syntax' AS \"check\", count(*) FILTER (p_partkey % 5 = 0) AS n_bad FROM part")
def audit_python(spark, sf):
    from corpusloom.functions import code as K

    p = read(spark, sf, "part").withColumn("text", F.when(F.col("p_partkey") % 5 == 0, "def f(:").otherwise("def f(x):\n    return x"))
    return Q.report(p, {"python_syntax": K.over("text", K.parses, "boolean")})


@query(
    "audit_mix",
    f"""WITH d AS (SELECT *, CASE WHEN doc_id % 40 = 0 THEN 'wrong' ELSE md5({STRIPPED}) END AS id FROM documents)
SELECT 'tier' AS "check", count(*) FILTER (doc_id % 10 < 2) AS n_bad FROM d UNION ALL SELECT 'text_id', count(*) FILTER (doc_id % 40 = 0) FROM d UNION ALL SELECT 'repeated_text_id', count(*) - count(DISTINCT id) FROM d
UNION ALL SELECT 'prior_corpus', count(*) FILTER (id IN (SELECT id FROM d WHERE source = 'src3')) FROM d UNION ALL SELECT 'total_' || source, CASE WHEN source = 'src1' THEN 1 ELSE 0 END FROM d GROUP BY source
UNION ALL SELECT 'credential', count(*) FILTER (regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----') OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'),
 lambda r: regexp_full_match(r, 'sk-[A-Za-z0-9_-]{{24,}}|gh[pousr]_[A-Za-z0-9]{{30,}}|github_pat_[A-Za-z0-9_]{{40,}}') AND len(list_distinct(string_split(r, ''))) >= 12)) > 0) FROM d""",
)
def audit_mix(spark, sf):
    d = _published(spark, sf)
    totals = {r[0]: r[1] + (r[0] == "src1") for r in d.groupBy("source").agg(F.sum("token_count")).collect()}  # what is claimed: one is off by 1
    return Q.mix_audit(d, d.where("source = 'src3'").select("text_id"), totals, 2.0)


@query(
    "audit_chats",
    f"""WITH m AS (SELECT conv_id, md5(string_agg(role || chr(31) || {STRIPPED.replace('text', 'content')}, chr(30) ORDER BY turn)) AS k, first(content ORDER BY turn) FILTER (role = 'user') AS p, CAST(sum(length(content)) AS BIGINT) AS n,
 bool_or(role = 'user') AND last(role ORDER BY turn) = 'assistant' AND bool_and(role IN ('system', 'user', 'assistant', 'tool') AND trim(content, ' ' || chr(10)) <> '') AS ok FROM {M} GROUP BY conv_id)
SELECT 'valid' AS "check", count(*) FILTER (NOT ok) AS n_bad FROM m UNION ALL SELECT 'chat_id', count(*) FILTER (conv_id % 6 = 0) FROM m UNION ALL SELECT 'tokens', count(*) FILTER (n > 1000) FROM m UNION ALL SELECT 'reasoning', count(*) FILTER (conv_id % 4 = 0) FROM m
UNION ALL SELECT 'repeated_chat_id', count(*) - count(DISTINCT CASE WHEN conv_id % 6 = 0 THEN 'wrong' ELSE k END) FROM m UNION ALL SELECT 'prompt_cap', count(*) FROM (SELECT p FROM m GROUP BY p HAVING count(*) > 3) UNION ALL SELECT 'reasoning_majority', 1""",
)
def audit_chats(spark, sf):
    m = chats(spark, sf).withColumn("chat_id", F.when(F.col("conv_id") % 6 == 0, "wrong").otherwise(C.chat_key(F.col("messages")))).withColumn("reasoning", F.col("conv_id") % 4 == 0)
    return Q.chat_audit(m, F.aggregate("messages", F.lit(0), lambda n, x: n + F.char_length(x["content"])), 1000)


@query("audit_split", "SELECT 'leak_text' AS \"check\", count(*) AS n_bad FROM (SELECT text FROM documents WHERE source = 'src0' INTERSECT SELECT text FROM documents WHERE source <> 'src0') UNION ALL SELECT 'leak_lang', count(*) FROM (SELECT lang FROM documents WHERE source = 'src0' INTERSECT SELECT lang FROM documents WHERE source <> 'src0')")
def audit_split(spark, sf):
    d = read(spark, sf, "documents")
    return Q.split_audit(d.where("source = 'src0'"), d.where("source <> 'src0'"), "text", "lang")


@query("audit_labels", "SELECT * FROM (SELECT 'same_length' AS \"check\", count(*) FILTER (doc_id % 5 = 1) AS n_bad FROM documents UNION ALL SELECT 'length', count(*) FILTER (doc_id % 5 = 2) FROM documents UNION ALL SELECT 'supervised', count(*) FILTER (doc_id % 5 = 3) FROM documents UNION ALL SELECT 'labels', count(*) FILTER (doc_id % 5 IN (1, 4)) FROM documents)")
def audit_labels(spark, sf):
    k = F.col("doc_id") % 5
    ids = F.when(k == 2, F.array(*map(F.lit, (1, 2, 3, 4, 5)))).otherwise(F.array(*map(F.lit, (1, 2, 3))))
    labels = F.when(k == 1, F.array(*map(F.lit, (-100, 2, 3, 4)))).when(k == 2, F.array(*map(F.lit, (-100, 2, 3, 4, 5)))).when(k == 3, F.array(*map(F.lit, (-100, -100, -100)))).when(k == 4, F.array(*map(F.lit, (-100, 2, 9)))).otherwise(F.array(*map(F.lit, (-100, 2, 3))))
    return Q.labels_audit(read(spark, sf, "documents").select(ids.alias("input_ids"), labels.alias("labels")), 4)


@query(
    "audit_handoff",
    """SELECT 'decided' AS "check", count(*) FILTER (p_partkey % 10 = 0) AS n_bad FROM part UNION ALL SELECT 'once', count(*) FILTER (p_partkey % 10 = 1) FROM part UNION ALL SELECT 'known', 1
UNION ALL SELECT 'allowed', count(*) FILTER (p_partkey % 10 = 2) FROM part UNION ALL SELECT 'unchanged', count(*) FILTER (p_partkey % 10 = 3) FROM part""",
)
def audit_handoff(spark, sf):
    k = F.col("p_partkey") % 10
    sent = read(spark, sf, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha256"))
    got = sent.where(k != 0).select("p_partkey", F.when(k == 2, "maybe").otherwise("keep").alias("decision"), F.when(k == 3, "x").otherwise(F.col("sha256")).alias("sha256"))
    extra = spark.createDataFrame([(-1, "keep", "y")], got.schema)
    return Q.handoff_audit(sent, got.unionByName(got.where(k == 1)).unionByName(extra), "p_partkey", ["keep", "drop"])


@query("build_rescued", "SELECT doc_id, 'short' AS old_reason FROM documents WHERE length(text) < 400 AND length(text) >= 200")
def rescued(spark, sf):
    n = F.char_length("text")
    out = X.rescued(read(spark, sf, "documents"), F.when(n < 400, "short"), F.when(n < 200, "short"))
    return out.select("doc_id", "old_reason")


@query("build_next_fit", "SELECT * FROM (VALUES (0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2)) t(item, batch)")
def next_fit(spark, sf):
    """Sizes 40, 20, 50, 5, 1, 1 into 60 and three items a batch."""
    return spark.createDataFrame(list(enumerate(X.next_fit([40, 20, 50, 5, 1, 1], 60, 3))), "item int, batch int")
