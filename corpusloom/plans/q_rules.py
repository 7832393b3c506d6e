"""Filters, cleanups and identity rules whose texts are made from the tables, so that SQL knows what must come out."""

from pyspark.sql import functions as F

from corpusloom.functions import code as K
from corpusloom.functions import hashing as H
from corpusloom.functions import text as T
from corpusloom.operators import chat as C
from corpusloom.operators import cleanups as U
from corpusloom.operators import filters as P
from corpusloom.operators import identity as I
from corpusloom.operators import rows as R
from corpusloom.plans.q_filters import WORDS_SQL
from corpusloom.plans.registry import query, read

BAD_SQL = "(low LIKE '%' || chr(65533) || '%' OR low LIKE '%write a paper online%' OR low LIKE '%online casino%' OR low LIKE '%click here to buy%' OR low LIKE '%<|im_start|>%' OR low LIKE '%<|im_end|>%' OR low LIKE '%[assistant/analysis]%')"


@query("filter_strict_text", rf"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 300 AND length(text) <= 8000 AND NOT {BAD_SQL} AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS ok FROM (SELECT *, lower(text) AS low FROM documents)")
def strict_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.strict_text(F.col("text"), 300, 8000).alias("ok"))


@query(
    "filter_repeated_line",
    r"""SELECT doc_id, coalesce(max(c), 0) >= 3 AS found FROM documents LEFT JOIN (SELECT doc_id, l, count(*) AS c FROM (SELECT doc_id, trim(regexp_replace(lower(nfc_normalize(unnest(string_split(text, chr(10))))), '\s+', ' ', 'g')) AS l FROM documents)
WHERE length(l) >= 30 GROUP BY ALL) USING (doc_id) GROUP BY doc_id""",
)
def repeated_line(spark, sf):
    return read(spark, sf, "documents").select("doc_id", C.repeated_line(F.col("text")).alias("found"))


@query(
    "filter_component",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'language_denied' WHEN lang NOT IN ('en', 'fr') THEN 'language_not_allowed' WHEN doc_id % 10 < 3 THEN 'score_below_threshold' WHEN doc_id % 7 = 0 THEN 'vendored_code' WHEN doc_id % 11 = 0 THEN 'generated_code' END AS reason FROM documents""",
)
def component(spark, sf):
    i = F.col("doc_id")
    return read(spark, sf, "documents").select("doc_id", P.accepted_component(F.upper("lang"), (i % 10).cast("string"), i % 7 == 0, i % 11 == 0, ["en", "fr"], ("de",), 3).alias("reason"))


PYTHON = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'size' WHEN 1 THEN 'long_line' WHEN 2 THEN 'syntax' WHEN 3 THEN 'definitions' WHEN 4 THEN 'documentation' END AS reason FROM part"""


@query("filter_python_module", PYTHON)
def python_module(spark, sf):
    k = F.col("p_partkey") % 8
    filler = F.concat(F.lit("\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("value_"), i.cast("string"), F.lit(" = "), i.cast("string"))), "\n"), F.lit("\n"))
    doc = "def f(x):\n    '''" + "What it does, told at some length. " * 4 + "'''\n    return x"
    code = (
        F.when(k == 0, "x = 1").when(k == 1, F.concat(F.lit(doc), filler, F.lit("# " + "y" * 1300))).when(k == 2, F.concat(F.lit("def f(:"), filler)).when(k == 3, filler)
        .when(k == 4, F.concat(F.lit("def f(x):\n    return x"), filler)).otherwise(F.concat(F.lit(doc), filler, F.lit("# "), F.col("p_name")))
    )
    return read(spark, sf, "part").select("p_partkey", K.over(code, K.documented_module, "string").alias("reason"))


@query(
    "filter_short_functions",
    """SELECT p_partkey, ['syntax', 'not_short_functions', 'redefined_function', 'long_code', 'placeholder_or_global_state', 'top_level_execution', 'non_foundational_dependency', 'relative_or_star_import', 'dynamic_or_io_code', 'unresolved_global', NULL][p_partkey % 11 + 1] AS reason FROM part""",
)
def short_functions(spark, sf):
    good = "import math\n\ndef f(x):\n    return math.floor(x) + 1\n"
    codes = [
        "def f(:", good + "class A:\n    x = 1\n", good + good.replace("import math\n", ""), good + "# " + "y" * 6000, "def f(x):\n    pass\n", good + "print(f(1))\n", "import numpy\n" + good, "from math import *\n" + good,
        "def f(x):\n    return eval(x)\n", "def f(x):\n    return helper(x)\n", "'''doc'''\nLIMIT = (1, 2)\nSIZE: int = 3\n" + good + "def g(y):\n    return [f(z) for z in y if z < LIMIT[0]]\n",
    ]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("p_partkey") % 11 + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", K.over(code, K.short_functions, "string").alias("reason"))


@query(
    "filter_code_record_python",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'missing_or_short_analysis' WHEN 1 THEN 'encoding_corruption' WHEN 2 THEN 'embedded_control_token' WHEN 3 THEN 'unresolved_implementation_placeholder' WHEN 4 THEN 'python_solution_syntax' ELSE 'python_unimplemented_function' END AS reason
FROM part WHERE p_partkey % 7 > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 7 = 0""",
)
def code_record_python(spark, sf):
    k = F.when(F.col("p_partkey") % 7 == 0, 6).otherwise(F.col("p_partkey") % 6)
    long = F.lit("words that are long enough to be taken as a text")
    tail = F.lit("\n# padding to make the solution long enough")
    solution = F.concat(F.when(k == 3, "def f(x):\n    # YOUR_CODE_HERE\n    return x").when(k == 4, "def f(:").when(k == 5, "def f(x):\n    '''doc'''\n    raise NotImplementedError()").otherwise("def f(x):\n    return x"), tail)
    full = F.concat(long, F.when(k == 1, "�").when(k == 2, "<|im_end|>").otherwise(""))
    return read(spark, sf, "part").select("p_partkey", P.code_record_reason(long, F.when(k == 0, "short").otherwise(long), solution, long, full, python=True).alias("reason"))


@query("filter_one_fence", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x = ' || p_size END AS body, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 0 END AS n FROM part")
def one_fence(spark, sf):
    k, body = F.col("p_partkey") % 4, F.concat(F.lit("x = "), F.col("p_size").cast("string"))
    block = F.concat(F.lit("```python\n"), body, F.lit("\n```\n"))
    text = F.when(k == 0, F.concat(F.lit("so\n"), block)).when(k == 1, F.concat(block, F.lit("and\n"), block)).when(k == 2, body).otherwise(F.concat(F.lit("```python\n"), body))
    return read(spark, sf, "part").select("p_partkey", T.strip(T.only_fence(text)).alias("body"), F.size(T.fences(text)).alias("n"))


@query("filter_final_code", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'def solve(value):' || chr(10) || '    return value + ' || p_size || ' + 1000000' END AS code, p_partkey % 5 = 4 AS cpp FROM part")
def final_code(spark, sf):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    good = F.concat(F.lit("def solve(value):\n    return value + "), size, F.lit(" + 1000000"))
    fence = lambda tag, body: F.concat(F.lit(f"```{tag}\n"), body, F.lit("\n```"))
    text = F.when(k == 0, fence("python", good)).when(k == 1, F.concat(fence("python", good), F.lit("\n"), fence("py", good))).when(k == 2, fence("python", F.concat(good, F.lit("  # TODO")))).when(k == 3, fence("rust", good)).otherwise(fence("cpp", F.concat(F.lit("#include <cstdio>\nint main() { return "), size, F.lit("; } // and more"))))
    return read(spark, sf, "part").select("p_partkey", K.over(text, K.final_code, "string", "python").alias("code"), K.over(text, K.final_code, "string", "cpp").isNotNull().alias("cpp"))


@query(
    "clean_problem_prompt",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(t) BETWEEN 120 AND 12000 THEN md5('Solve the following programming problem in Python. Return the final solution as one `python` code block.' || chr(10) || chr(10) || t) END AS digest
FROM (SELECT doc_id, regexp_replace('Problem: ' || text, '\\s+$', '') AS t FROM documents)""",
)
def problem_prompt(spark, sf):
    preamble = "You are a helpful and harmless assistant. You should think.\nYou must use ```python for the code:\n```python\n# code\n```\n\n"
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, preamble).otherwise(""), F.lit("Problem: "), F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(U.problem_prompt(text, "python")).alias("digest"))


@query(
    "clean_math_exchange",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'The answer is ' || p_size WHEN 1 THEN 'x = ' || p_size WHEN 2 THEN '```python' || chr(10) || '# take the number as it is given' || chr(10) || '# then print it and nothing else at all' || chr(10) || 'print(' || p_size || ')' || chr(10) || '```' END AS answer,
CASE p_partkey % 5 WHEN 0 THEN 'We add what is there and find the whole of it.' WHEN 1 THEN 'First we move all terms to one side of it. Then we divide.' WHEN 2 THEN 'take the number as it is given. then print it and nothing else at all' END AS reasoning FROM part""",
)
def math_exchange(spark, sf):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    told = F.concat(F.lit("Let's think about the question step by step. We add what is there\n and find the whole of it.\nThe answer is "), size)
    lines = F.concat(F.lit("First we move all terms to one side of it.\nThen we divide.\nx = "), size)
    program = F.concat(F.lit("# take the number as it is given\n# then print it and nothing else at all\nprint("), size, F.lit(")"))
    output = F.when(k == 0, told).when(k == 1, lines).when(k == 2, program).when(k == 3, F.concat(F.lit("Maybe we should think about it for a while, and wait.\nx = "), size)).otherwise("no")
    out = U.math_exchange(F.lit("How much is it?"), output)
    return read(spark, sf, "part").select("p_partkey", out["answer"].alias("answer"), out["reasoning"].alias("reasoning"))


@query(
    "clean_code_exchange",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '```python' || chr(10) || 'x = ' || p_size || chr(10) || '```' WHEN 1 THEN 'Use x = ' || p_size END AS answer,
CASE p_partkey % 3 WHEN 0 THEN 'The code gives the variable the number that was asked for, which is all there is to do in this case.' END AS reasoning FROM part""",
)
def code_exchange(spark, sf):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    both = F.concat(F.lit("The code gives the variable the number that was asked for,\n```python\nx = "), size, F.lit("\n```\nwhich is all there is to do in this case."))
    out = U.code_exchange(F.lit("Set x."), F.when(k == 0, both).when(k == 1, F.concat(F.lit("Use x = "), size)).otherwise(""))
    return read(spark, sf, "part").select("p_partkey", out["answer"].alias("answer"), out["reasoning"].alias("reasoning"))


THOUGHT = "The question is about a number, so the number that is given is repeated with its unit."


@query("clean_chat", f"SELECT p_partkey, ['cot_retained', 'bad_cot_removed', 'plain_retained', 'invalid_structure', 'too_many_turns', 'bad_visible_text', 'bad_cot_removed'][p_partkey % 7 + 1] AS status, CASE WHEN p_partkey % 7 = 0 THEN '{THOUGHT}' END AS reasoning FROM part")
def clean_chat(spark, sf):
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    say = lambda role, text, thought="": F.struct(F.lit(role).alias("role"), (text if not isinstance(text, str) else F.lit(text)).alias("content"), F.lit(thought).alias("reasoning_content"))
    chat = lambda thought, answer=size: F.array(say("user", "How many?"), say("assistant", answer, thought))
    many = F.flatten(F.array(*[chat("") for _ in range(7)]))
    messages = (
        F.when(k == 0, chat(THOUGHT)).when(k == 1, chat(THOUGHT + " Maybe.")).when(k == 2, chat("")).when(k == 3, F.array(say("user", "Hello?"))).when(k == 4, many)
        .when(k == 5, chat("", F.concat(size, F.lit(" �")))).otherwise(chat("The user asks how many there are, and so the number of them has to be told."))
    )
    out = U.cleaned_chat(messages)
    kept = F.get(F.filter(F.transform(out["messages"], lambda m: m["reasoning_content"]), lambda x: x.isNotNull()), F.lit(0))
    return read(spark, sf, "part").select("p_partkey", out["status"].alias("status"), kept.alias("reasoning"))


@query("clean_sentences", "SELECT doc_id, 'The first sentence is here. Another one, of number ' || doc_id || ', follows.' AS text FROM documents")
def sentences(spark, sf):
    text = F.concat(F.lit("The first sentence is here. Another one, of number "), F.col("doc_id").cast("string"), F.lit(", follows. THE FIRST SENTENCE IS HERE! Short."))
    return read(spark, sf, "documents").select("doc_id", F.array_join(U.distinct_sentences(text), " ").alias("text"))


@query("filter_train_only", "SELECT p_partkey, p_partkey % 4 = 0 AS ok FROM part")
def train_only(spark, sf):
    k = F.col("p_partkey") % 4
    splits = F.when(k == 0, F.array(F.lit(" Train"), F.lit("train"))).when(k == 1, F.array(F.lit("train"), F.lit("test"))).when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("valid")))
    return read(spark, sf, "part").select("p_partkey", P.train_only(splits).alias("ok"))


@query("filter_description", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A summary of part ' || p_partkey || ' here' END AS summary, CASE p_partkey % 4 WHEN 0 THEN 2 END AS n_steps FROM part")
def description(spark, sf):
    k = F.col("p_partkey") % 4
    text = F.concat(F.lit('{"summary": "A summary of part '), F.col("p_partkey").cast("string"), F.lit(' here", "flow": '), F.when(k == 0, '["one", "two"]}').when(k == 1, "[]}").when(k == 2, '["one", " "]}').otherwise("3}"))
    out = R.described(text)
    return read(spark, sf, "part").select("p_partkey", out["summary"].alias("summary"), F.when(out.isNotNull(), F.size(out["flow"])).alias("n_steps"))


@query("filter_problem", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'empty_statement' WHEN 1 THEN 'image_in_statement' WHEN 2 THEN 'no_or_mismatched_tests' END AS reason, CASE p_partkey % 4 WHEN 3 THEN 'a' || p_size END AS first_input FROM part")
def problem(spark, sf):
    k, one = F.col("p_partkey") % 4, F.array(F.concat(F.lit("a"), F.col("p_size").cast("string")))
    outputs = F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("b")))
    reason = R.problem_reason(F.when(k == 0, " ").otherwise("Do it."), one, outputs, F.when(k == 1, 1).otherwise(0))
    return read(spark, sf, "part").select("p_partkey", reason.alias("reason"), F.when(reason.isNull(), R.test_cases(one, outputs)[0]["input"]).alias("first_input"))


@query("filter_all_tests_pass", "SELECT p_partkey, p_partkey % 4 = 0 AS ok FROM part")
def all_tests_pass(spark, sf):
    k = F.col("p_partkey") % 4
    statuses = F.when(k == 1, '["pass", "pass", "fail", "pass", "pass"]').when(k == 2, '["pass"]').otherwise('["pass", "Pass", "pass", "pass", "pass"]')
    judged = F.when(k == 3, '{"style": {"score": 2}}').otherwise('{"style": {"score": 5}}')
    return read(spark, sf, "part").select("p_partkey", R.all_tests_pass(F.lit("1.0"), statuses, judged).alias("ok"))


@query("filter_untagged", "SELECT o_orderkey, o_orderkey % 2 = 1 AS supported FROM orders WHERE o_orderkey % 3 > 0")
def untagged(spark, sf):
    i = F.col("o_orderkey")
    o = read(spark, sf, "orders").select("o_orderkey", F.when(i % 3 == 0, F.array(F.lit("greedy"), F.lit("interactive"))).when(i % 3 == 1, F.array(F.lit("greedy"))).alias("tags"), F.when(i % 2 == 1, "GNU C++17 (64)").otherwise("Kotlin 1.7").alias("language"))
    return R.only_untagged(o, "tags", "interactive").select("o_orderkey", R.supported_language(F.col("language"), ["c++", "python"]).alias("supported"))


@query("filter_classifier", f"SELECT doc_id, CASE WHEN length(text) < 300 THEN 'short' WHEN len({WORDS_SQL.format('text')}) > 500 THEN 'wordy' ELSE 'keep' END AS outcome FROM documents")
def classifier(spark, sf):
    """Any rules a caller names, the first that holds."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    return P.decide(d, [("short", F.char_length("text") < 300), ("wordy", F.size(T.words(F.col("text"))) > 500)]).select("doc_id", "outcome")


@query("filter_reviewed", "SELECT doc_id, max(CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END) AS decision FROM labels GROUP BY doc_id")
def reviewed(spark, sf):
    """Rows that all have a decision; a missing one stops the build, and here it does so for the whole table."""
    known = read(spark, sf, "labels").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, "keep").otherwise("drop")).alias("decision"))
    open_rows = read(spark, sf, "documents").select("doc_id").join(known, "doc_id", "left")
    try:
        P.require_all(open_rows, "decision", "decision")
        stopped = open_rows.where("decision IS NULL").isEmpty()
    except ValueError:
        stopped = True
    return P.require_all(known, "decision", "decision").where(F.lit(stopped))


NAMES = ["zeta", "omicron 3"]


@query("identity_claims", "SELECT p_partkey, p_partkey % 6 = 0 AS claims, ['claim', 'review', 'review', 'review', 'clean', 'clean'][p_partkey % 6 + 1] AS verdict FROM part")
def identity_claims(spark, sf):
    k = F.col("p_partkey") % 6
    text = (
        F.when(k == 0, "Hello. I am Zeta, a model.").when(k == 1, "I am not Zeta.").when(k == 2, "Suppose I am Zeta!").when(k == 3, 'He said "I am Zeta".')
        .when(k == 4, "I am a zetabyte.").otherwise("Zebras are here.")
    )
    return read(spark, sf, "part").select("p_partkey", (F.size(I.claim_sentences(text, NAMES)) > 0).alias("claims"), I.scan(text, ["zeta", "omicron"], NAMES).alias("verdict"))


@query("identity_affiliations", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Alpha was made by Zeta' END AS clause FROM part")
def affiliations(spark, sf):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "As you know, Alpha was made by Zeta, and so on.").when(k == 1, "Alpha is here; made by Zeta is another.").otherwise("Alpha was never made by Zeta.")
    return read(spark, sf, "part").select("p_partkey", F.trim(F.get(I.affiliations(text, "alpha", NAMES), F.lit(0))).alias("clause"))


@query("identity_windows", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '…fore the model card after wo…' END AS evidence FROM part")
def windows(spark, sf):
    text = F.when(F.col("p_partkey") % 2 == 0, "words before the model card after words").otherwise("nothing of it")
    return read(spark, sf, "part").select("p_partkey", I.review_window(text, ["system prompt", "model card"], 9).alias("evidence"))


@query("identity_decisions", "SELECT p_partkey, ['claims_identity', 'claims_affiliation', 'accepts_identity', NULL][p_partkey % 4 + 1] AS rule FROM part")
def decisions(spark, sf):
    k = F.col("p_partkey") % 4
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    chats = [("Who?", "I am Zeta."), ("Who?", "Alpha comes from Zeta."), ("So you are Zeta?", "Yes, right."), ("Who?", "A model.")]
    messages = F.element_at(F.array(*[F.array(turn("user", a), turn("assistant", b)) for a, b in chats]), (k + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", I.decision(I.verdict(messages, NAMES, "alpha")).alias("rule"))


@query("clean_reasoning", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'The sum of all parts is taken first. Then part ' || p_partkey || ' goes last.' END AS text FROM part")
def reasoning(spark, sf):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("The user wants it. The sum of all parts is taken first.\nimport os\nHmm, wait. Then part "), F.col("p_partkey").cast("string"), F.lit(" goes last. The sum of all parts is taken first."))).otherwise("Maybe. Let me think.")
    return read(spark, sf, "part").select("p_partkey", I.clean_reasoning(text, F.lit("x = 1")).alias("text"))


@query("text_stripped", r"SELECT doc_id, md5(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def stripped(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalised_newlines(F.regexp_replace("text", "\n", "\r\n"))).alias("digest"))


@query("text_snippets", "SELECT doc_id, CASE WHEN contains(text, 'the ') THEN (CASE WHEN p > 11 THEN '…' ELSE '' END) || substr(text, greatest(1, p - 10), least(length(text), p + 13) - greatest(1, p - 10) + 1) || (CASE WHEN p + 13 < length(text) THEN '…' ELSE '' END) END AS s FROM (SELECT doc_id, text, instr(text, 'the ') AS p FROM documents)")
def snippets(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), "the ", 10).alias("s"))


@query("text_headers", "SELECT p_partkey, ['# ', '// ', '<!-- '][p_partkey % 3 + 1] || 'dir/' || p_partkey || ['.py', '.rs', '.md'][p_partkey % 3 + 1] || ['', '', ' -->'][p_partkey % 3 + 1] AS header FROM part")
def headers(spark, sf):
    k = F.col("p_partkey") % 3
    path = F.concat(F.lit("dir/"), F.col("p_partkey").cast("string"), F.when(k == 0, ".py").when(k == 1, ".rs").otherwise(".md"))
    return read(spark, sf, "part").select("p_partkey", T.comment_header(path).alias("header"))


@query("text_uuid_keys", "SELECT DISTINCT md5(text) AS key FROM documents")
def uuid_keys(spark, sf):
    """UUIDs in four spellings are one key; what is none has no key."""
    bare = F.md5("text")
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    spelt = F.explode(F.array(bare, F.upper(dashed), F.concat(F.lit("{"), dashed, F.lit("}")), F.concat(F.lit("urn:uuid:"), dashed), F.lit("no uuid")))
    return read(spark, sf, "documents").select(spelt.alias("s")).select(H.uuid_key(F.col("s")).alias("key")).where("key IS NOT NULL").distinct()


@query("markup_statement", "SELECT p_partkey, 'Part ' || p_partkey || chr(10) || chr(10) || '- one' || chr(10) || '- two & three' AS text, 1 AS n_images, '# Part ' || p_partkey || chr(10) || '`x`' || chr(10) || chr(10) || '| a | b |' AS markdown FROM part")
def statement(spark, sf):
    from corpusloom.functions import markup as M

    n = F.col("p_partkey").cast("string")
    html = F.concat(F.lit("<head><title>t</title></head><p>Part "), n, F.lit("</p><ul><li>one</li><li>two &amp; three<img src=x></li></ul><script>no</script>"))
    table = F.concat(F.lit("<h1>Part "), n, F.lit("</h1><code>x</code><table><tr><td>a </td><td>b</td></tr></table>"))
    return read(spark, sf, "part").select("p_partkey", M.html_text(html).alias("x"), M.html_markdown(table).alias("markdown")).select("p_partkey", "x.text", "x.n_images", "markdown")
