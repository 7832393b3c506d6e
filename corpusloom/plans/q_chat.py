"""Chat queries over the conversations table."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chat as C
from corpusloom.plans.registry import query, read


def chats(spark, sf):
    return C.conversations(read(spark, sf, "conversations"))


M = "(SELECT conv_id, turn, lower(trim(role)) AS role, text AS content FROM conversations)"


@query("chat_rebuild", f"SELECT conv_id, count(*) AS n, md5(string_agg(role || chr(31) || content, chr(30) ORDER BY turn)) AS digest FROM {M} GROUP BY conv_id")
def rebuild(spark, sf):
    joined = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\x1f"), m["content"])), "\x1e")
    return chats(spark, sf).select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(joined).alias("digest"))


@query("chat_turns", f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, md5(content) AS digest FROM {M}")
def turns(spark, sf):
    return C.turns_of(chats(spark, sf), "conv_id").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.md5("content").alias("digest"))


@query(
    "chat_render",
    f"SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn)) AS digest FROM {M} GROUP BY conv_id",
)
def render(spark, sf):
    return chats(spark, sf).select("conv_id", F.md5(C.render(F.col("messages"))).alias("digest"))


@query(
    "chat_prompts",
    f"""SELECT conv_id, md5(coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role IN ('system', 'user')), '')) AS prompt, md5(coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (content <> ''), '')) AS visible,
md5(first(content ORDER BY turn) FILTER (role = 'user')) AS first_prompt, md5(last(content ORDER BY turn) FILTER (role = 'assistant')) AS last_answer FROM {M} GROUP BY conv_id""",
)
def prompts(spark, sf):
    m = F.col("messages")
    return chats(spark, sf).select(
        "conv_id", F.md5(C.prompt(m)).alias("prompt"), F.md5(C.visible(m)).alias("visible"), F.md5(C.first_prompt(m)).alias("first_prompt"), F.md5(C.last_answer(m)).alias("last_answer")
    )


@query(
    "chat_valid",
    f"""SELECT conv_id, bool_or(role = 'user') AND last(role ORDER BY turn) = 'assistant' AND bool_and(role IN ('system', 'user', 'assistant', 'tool') AND trim(content, ' ' || chr(10)) <> '') AS ok FROM {M} GROUP BY conv_id""",
)
def valid(spark, sf):
    return chats(spark, sf).select("conv_id", C.valid(F.col("messages")).alias("ok"))


@query("chat_reasoning", rf"SELECT conv_id, bool_or(content LIKE '%<think>%') AS ok FROM {M} GROUP BY conv_id")
def reasoning(spark, sf):
    return chats(spark, sf).select("conv_id", C.has_reasoning(F.col("messages")).alias("ok"))


@query(
    "chat_reasons",
    rf"""WITH m AS (SELECT *, trim(content, ' ' || chr(10)) AS t, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_user FROM {M}),
c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS nu, count(*) FILTER (role = 'assistant') AS na, coalesce(bool_or(role = 'user' AND t = ''), false) AS eu, coalesce(bool_or(role = 'assistant' AND t = ''), false) AS ea,
  coalesce(bool_or(role = 'user' AND length(t) > 20000), false) AS big, coalesce(bool_or(role = 'user' AND turn = last_user AND length(t) >= 8 AND regexp_matches(t, '[:,\-]\s*$')), false) AS cut,
  bool_or(regexp_matches(content, '(?i)\[(insert|placeholder|todo|your\s+[^\]]+)\]|\b(TODO|TBD|FIXME)\b|<\s*(question|answer|instruction)\s*>')) AS hole,
  count(*) FILTER (role = 'user' AND t <> '') > count(DISTINCT CASE WHEN role = 'user' AND t <> '' THEN regexp_replace(lower(t), '\s+', ' ', 'g') END) AS twice FROM m GROUP BY conv_id)
SELECT conv_id, array_to_string(list_filter([CASE WHEN nu = 0 THEN 'missing_user_message' END, CASE WHEN na = 0 THEN 'missing_assistant_message' END, CASE WHEN eu THEN 'empty_user_message' END, CASE WHEN ea THEN 'empty_assistant_message' END,
  CASE WHEN big THEN 'oversized_question' END, CASE WHEN cut THEN 'possibly_incomplete_question' END, CASE WHEN hole THEN 'placeholder_or_template' END, CASE WHEN twice THEN 'duplicate_user_turn' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""",
)
def reasons(spark, sf):
    return chats(spark, sf).select("conv_id", F.array_join(C.chat_reasons(F.col("messages")), ",").alias("reasons"))


@query(
    "chat_replay_score",
    rf"""WITH c AS (SELECT conv_id, count(*) AS n, bool_or(role = 'user') AS u, bool_and(role IN ('system', 'user', 'assistant', 'tool')) AS k, coalesce(string_agg(content, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS own,
  last(content ORDER BY turn) FILTER (role = 'assistant' AND content <> '') AS ans, coalesce(string_agg(content, chr(10) ORDER BY turn), '') AS vis, bool_or(role = 'tool') AS tool FROM {M} GROUP BY conv_id)
SELECT conv_id, CASE WHEN n BETWEEN 2 AND 8 AND u AND k AND ans IS NOT NULL AND NOT (contains(vis, chr(65533)) OR contains(vis, '<|im_start|>') OR contains(vis, '<|im_end|>')) AND length(own) BETWEEN 8 AND 6000 AND length(ans) BETWEEN 2 AND 8000
  AND trim(regexp_replace(lower(own), '\s+', ' ', 'g')) <> trim(regexp_replace(lower(ans), '\s+', ' ', 'g'))
  THEN CASE WHEN n = 2 THEN 5 ELSE 3 END + CASE WHEN length(own) BETWEEN 20 AND 1500 THEN 3 ELSE 1 END + CASE WHEN length(ans) BETWEEN 20 AND 2000 THEN 3 ELSE 1 END + CASE WHEN contains(lower(ans), 'as an ai') THEN 0 ELSE 2 END + CASE WHEN tool THEN 2 ELSE 0 END END AS score FROM c""",
)
def replay_score(spark, sf):
    return chats(spark, sf).select("conv_id", C.replay_score(F.col("messages")).alias("score"))


@query("chat_echo", rf"SELECT conv_id, count(*) FILTER (role = 'user' AND nr = 'assistant' AND regexp_matches(lower(content), 'the') AND regexp_matches(lower(nc), 'and')) AS n FROM (SELECT *, lead(role) OVER w AS nr, lead(content) OVER w AS nc FROM {M} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id")
def echo(spark, sf):
    return chats(spark, sf).select("conv_id", C.echoed_turns(F.col("messages"), "the", "and").cast("long").alias("n"))


@query(
    "chat_system",
    f"""SELECT conv_id, md5(CASE WHEN first(role ORDER BY turn) = 'system' THEN '' ELSE 'system' || chr(31) || 'Be brief.' || chr(30) END || string_agg(role || chr(31) || CASE WHEN turn = t0 AND role = 'system' THEN 'Be brief.' || chr(10) || chr(10) ELSE '' END || content, chr(30) ORDER BY turn)) AS digest
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS t0 FROM {M}) GROUP BY conv_id""",
)
def system(spark, sf):
    m = C.with_system(F.col("messages"), "Be brief.")
    return chats(spark, sf).select("conv_id", F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("\x1f"), x["content"])), "\x1e")).alias("digest"))


@query("chat_pairs", r"SELECT doc_id, md5('user' || trim(lang) || 'assistant' || trim(text, ' ' || chr(10))) AS digest FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def pairs(spark, sf):
    own = read(spark, sf, "documents").select("doc_id", C.from_pair(F.col("lang"), F.col("text")).alias("m")).where("m is not null")
    return own.select("doc_id", F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["role"], x["content"])), "")).alias("digest"))


@query("chat_prefix", f"SELECT conv_id, count(*) - 1 AS n FROM {M} GROUP BY conv_id")
def prefix(spark, sf):
    return chats(spark, sf).select("conv_id", F.size(C.without_last_turn(F.col("messages"))).cast("long").alias("n"))


@query("chat_dedup", f"SELECT min(conv_id) AS conv_id, count(*) AS n FROM (SELECT conv_id, string_agg(role || chr(31) || trim(content, ' ' || chr(10)), chr(30) ORDER BY turn) AS k FROM {M} GROUP BY conv_id) GROUP BY k")
def dedup(spark, sf):
    return chats(spark, sf).groupBy(C.chat_key(F.col("messages")).alias("k")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).drop("k")


@query(
    "chat_instruction_text",
    "SELECT doc_id, md5('### Instruction:' || chr(10) || source || chr(10) || chr(10) || '### Response:' || chr(10) || text) AS digest FROM documents",
)
def instruction_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(C.render_instruction(F.col("source"), F.col("text"))).alias("digest"))


@query("chat_first_filled", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type END AS pick FROM part")
def first_filled(spark, sf):
    k = F.col("p_partkey") % 3
    return read(spark, sf, "part").select("p_partkey", T.first_filled(F.when(k == 0, F.col("p_name")).otherwise(" "), F.when(k == 1, F.col("p_brand")), F.col("p_type")).alias("pick"))
