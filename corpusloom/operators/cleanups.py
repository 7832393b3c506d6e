"""Cleanups of prompts, answers and chats of known layouts: what is cut off, kept apart as reasoning, or rejected."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import code as K
from corpusloom.functions import text as T
from corpusloom.operators.chat import valid
from corpusloom.operators.filters import bad_visible_text

#: The preamble of prompts, doubts, talk about the task, and the last sentence of an answer.
PREAMBLE = r"(?is)\AYou are a helpful and harmless assistant\..*?You must use ```(?:python|cpp).*?```(?:python|cpp)?\s*\n.*?\n```\s*\n+"
UNCERTAIN = r"(?i)\b(?:maybe|perhaps|possibly|not sure|unclear|wait|hold on|could be|might be|I think)\b"
META = r"(?i)\b(?:the user|as chatgpt|final answer|final response|final code|code block|must output|need to output|allowed methods|instruction below|let'?s craft|now craft)\b"
FINAL = r"(?is)^(.*?)(?:\n|^)((?:the answer is|answer:|therefore,? the answer is|thus,? the answer is).{1,160})\s*$"
ANSWERS = r"(?i)\d|[A-E]\b|\\boxed|=|true|false|yes|no"
OPENING = r"(?i)^let'?s (?:think about|solve) (?:the )?(?:multi-choice )?question(?: step by step)?\.\s*"
FENCED = r"(?s)```\s*([A-Za-z0-9_+.-]*)\s*\n(.*?)```"
USER_TALK = (
    r"(?i)(?:用户(?:问|想|希望|需要|要求)|分析用户|这位用户|the user (?:asks|wants|needs)|作为(?:一个)?(?:AI|助手)|as (?:an )?ai|I need to (?:answer|respond)|"
    r"首先.{0,8}分析.{0,8}需求|接下来.{0,12}考虑|最后.{0,8}推荐)"
)
ASKS_CODE = r"(?i)代码|程序|编程|code|program|script"
#: How a problem is put once its preamble is gone.
LANGUAGE_NAMES = {"python": "Python", "cpp": "C++"}


def problem_prompt(text: Column, language: str, least: int = 120, most: int = 12_000) -> Column:
    """The problem without its preamble, newly introduced; null if there is no preamble or the size doesn't fit."""
    whole = T.strip(text)
    body = T.strip(F.regexp_replace(whole, PREAMBLE, ""))
    intro = f"Solve the following programming problem in {LANGUAGE_NAMES[language]}. Return the final solution as one `{language}` code block.\n\n"
    return F.when(whole.rlike(PREAMBLE) & F.char_length(body).between(least, most), F.concat(F.lit(intro), body))


def doubtful(text: Column) -> Column:
    """Reasoning that doubts itself or talks about its task."""
    return text.rlike(UNCERTAIN) | text.rlike(META)


def _exchange(user: Column, answer: Column, reasoning: Column) -> Column:
    return F.struct(user.alias("user"), answer.alias("answer"), reasoning.alias("reasoning"))


def math_exchange(instruction: Column, output: Column) -> Column:
    """user, answer and reasoning of a worked answer, or null where they can't be told apart.

    A program with comments gives its comments as reasoning. Otherwise the last sentence is the answer:
    one that says so, or a last line or sentence that looks like an answer.
    """
    user, text = T.strip(F.coalesce(instruction, F.lit(""))), T.strip(F.coalesce(output, F.lit("")))
    fits = (user != "") & (text != "") & (F.char_length(user) <= 10_000) & (F.char_length(text) <= 5_000)
    hashed = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*#"))
    comments = F.transform(hashed, lambda x: T.strip(F.regexp_replace(x, r"^\s*#\s?", "")))
    told = T.collapse(F.array_join(F.transform(F.filter(comments, lambda x: F.char_length(x) >= 8), lambda x: F.regexp_replace(x, r"\.+$", "")), ". "))
    program = text.contains("print(") & text.rlike(r"(?:^|\n)#") & F.char_length(told).between(50, 2400) & ~doubtful(told)
    program = program & K.over(F.when(program, text), K.parses, "boolean")
    lines = F.filter(F.transform(F.split(text, r"\n+"), T.strip), lambda x: x != "")
    parts = F.when(F.size(lines) >= 2, lines).otherwise(F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), T.strip), lambda x: x != ""))
    last = F.try_element_at(parts, F.lit(-1))
    marked = text.rlike(FINAL)
    plain = (F.size(parts) >= 2) & F.char_length(last).between(1, 300) & last.rlike(ANSWERS)
    way = F.when(marked, F.regexp_extract(text, FINAL, 1)).when(plain, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    way = T.collapse(F.regexp_replace(T.strip(way), OPENING, ""))
    answer = T.collapse(F.when(marked, F.regexp_extract(text, FINAL, 2)).otherwise(last))
    sound = F.coalesce(F.char_length(way).between(30, 3000) & ~doubtful(way), F.lit(False))
    fenced = F.concat(F.lit("```python\n"), text, F.lit("\n```"))
    return F.when(fits & F.coalesce(program, F.lit(False)), _exchange(user, fenced, told)).when(fits & sound, _exchange(user, answer, way))


def code_exchange(instruction: Column, response: Column) -> Column:
    """user, answer and reasoning: the explanation around one code block is reasoning if it is short and sure.

    Else the response stays as it is and reasoning is null; null where a side is empty or too long.
    """
    user, text = T.strip(F.coalesce(instruction, F.lit(""))), T.strip(F.coalesce(response, F.lit("")))
    fits = (user != "") & (text != "") & (F.char_length(user) <= 12_000) & (F.char_length(text) <= 12_000)
    outside = T.collapse(F.regexp_replace(text, FENCED, "\n"))
    tag, code = F.lower(F.regexp_extract(text, FENCED, 1)), T.strip(F.regexp_extract(text, FENCED, 2))
    told = (F.regexp_count(text, F.lit(FENCED)) == 1) & F.char_length(outside).between(80, 2400) & ~doubtful(outside)
    told = told & (code != "") & ~code.contains("...") & ~F.lower(code).contains("your code here")
    block = F.concat(F.lit("```"), tag, F.lit("\n"), code, F.lit("\n```"))
    nothing = F.lit(None).cast("string")
    return F.when(fits & told, _exchange(user, block, outside)).when(fits, _exchange(user, text, nothing))


def cleaned_chat(messages: Column, most_turns: int = 12, most_chars: int = 24_000) -> Column:
    """status and messages (role, content, reasoning_content) of a chat whose messages have these three.

    Status is invalid_structure, too_many_turns, bad_visible_text or visible_text_too_long (messages are
    null), or tells whether reasoning was kept, all of it removed, or never there. Reasoning goes if it is
    too short or long, broken, doubtful or about the user, has code nobody asked for, or holds the answer.
    """
    blank = F.lit("")
    own = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), T.strip(F.coalesce(m["content"], blank)).alias("content"), T.strip(F.coalesce(m["reasoning_content"], blank)).alias("reasoning_content")))

    def asked(i: Column) -> Column:
        before = F.filter(F.slice(own, 1, i + 1), lambda m: m["role"] == "user")
        return F.coalesce(F.try_element_at(before, F.lit(-1))["content"], blank)

    def sound(m: Column, i: Column) -> Column:
        thought, answer = m["reasoning_content"], T.collapse(m["content"])
        odd = bad_visible_text(thought) | thought.rlike(USER_TALK) | thought.rlike(UNCERTAIN)
        odd = odd | (thought.contains("```") & ~asked(i).rlike(ASKS_CODE))
        odd = odd | ((F.char_length(answer) >= 80) & F.contains(T.collapse(thought), F.substring(answer, 1, 80)))
        return F.char_length(thought).between(60, 1600) & ~odd

    thinks = lambda m: (m["role"] == "assistant") & (m["reasoning_content"] != "")
    judged = F.transform(own, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.when(m["role"] != "assistant", F.nullif(m["reasoning_content"], blank)).when(thinks(m) & sound(m, i), m["reasoning_content"]).alias("reasoning_content")))
    chars = F.aggregate(own, F.lit(0), lambda n, m: n + F.char_length(m["content"]))
    status = (
        F.when(~valid(messages), "invalid_structure")
        .when(F.size(messages) > most_turns, "too_many_turns")
        .when(F.exists(own, lambda m: bad_visible_text(m["content"])), "bad_visible_text")
        .when(chars > most_chars, "visible_text_too_long")
        .when(F.exists(judged, lambda m: (m["role"] == "assistant") & m["reasoning_content"].isNotNull()), "cot_retained")
        .when(F.exists(own, thinks), "bad_cot_removed")
        .otherwise("plain_retained")
    )
    return F.struct(status.alias("status"), F.when(status.isin("cot_retained", "bad_cot_removed", "plain_retained"), judged).alias("messages"))


def stripped_metadata(rows, *names: str):
    """rows without the columns that told clones apart; review columns and all others stay."""
    return rows.drop(*names)


def distinct_sentences(text: Column, least: int = 15) -> Column:
    """The sentences of a text in order, without those whose letters and digits came before or are too few."""
    keyed = F.transform(T.sentences(text), lambda s: F.struct(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "").alias("key"), s.alias("text")))
    long = F.filter(keyed, lambda s: F.char_length(s["key"]) >= least)
    keys = F.transform(long, lambda s: s["key"])
    return F.transform(F.filter(long, lambda s, i: F.array_position(keys, s["key"]) == i + 1), lambda s: s["text"])
