"""Chat rows: arrays of messages (role, content, reasoning_content, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Other names of roles, and the markers of the rendered form.
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
START, END = "<|im_start|>", "<|im_end|>"
PLACEHOLDER = r"(?i)\[(?:insert|placeholder|todo|your\s+[^\]]+)\]|\b(?:TODO|TBD|FIXME)\b|<\s*(?:question|answer|instruction)\s*>"
UNFINISHED = r"(?:[:：]|[,，]|[-—])\s*$"


def role_of(role: Column) -> Column:
    """A role in lower case under its usual name."""
    low = F.lower(T.strip(F.coalesce(role, F.lit(""))))
    out = low
    for old, new in ROLE_ALIASES.items():
        out = F.when(low == old, new).otherwise(out)
    return out


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in order, from one row per turn."""
    message = F.struct(F.col(turn).alias("turn"), role_of(F.col(role)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    packed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(message)).alias("m"))
    return packed.select(conv, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def turns_of(chats: DataFrame, conv: str, messages: str = "messages") -> DataFrame:
    return chats.select(conv, F.posexplode_outer(messages).alias("turn", "m")).select(conv, "turn", "m.*")


#: The fields that hold a chat or a side of an exchange, in the order they are read, and the role of bare texts.
TEXT_FIELDS = {
    "conversations": "", "messages": "", "chosen": "", "rejected": "", "prompt": "user", "question": "user", "instruction": "user", "text": "",
    "response": "assistant", "answer": "assistant", "solution": "assistant", "output": "assistant", "completion": "assistant",
}


def role_texts(df: DataFrame) -> Column:
    """(role, text) of all that a row says, from whichever of the known fields it has: lists of messages under
    their usual names (role or from; content, value or text), and bare texts with the role of their field."""
    parts = []
    for name, role in TEXT_FIELDS.items():
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        if kind.typeName() == "string":
            parts.append(F.when(F.col(name).isNotNull(), F.array(F.struct(F.lit(role).alias("role"), F.col(name).alias("text")))))
        elif kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            has = kind.elementType.fieldNames()
            who, what = (next((f for f in names if f in has), None) for names in (("role", "from"), ("content", "value", "text")))
            if what:
                said = F.transform(F.col(name), lambda m: F.struct(role_of(m[who] if who else F.lit("")).alias("role"), m[what].alias("text")))  # noqa: B023
                parts.append(F.filter(said, lambda p: p["text"].isNotNull()))
    none = F.array().cast("array<struct<role:string,text:string>>")
    return F.concat(*[F.coalesce(p, none) for p in parts]) if parts else none


def from_pair(instruction: Column, response: Column) -> Column:
    """A two-message chat of stripped texts, or null if one of them is empty."""
    a, b = T.strip(F.coalesce(instruction, F.lit(""))), T.strip(F.coalesce(response, F.lit("")))
    chat = F.array(F.struct(F.lit("user").alias("role"), a.alias("content")), F.struct(F.lit("assistant").alias("role"), b.alias("content")))
    return F.when((a != "") & (b != ""), chat)


def of_role(messages: Column, *roles: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"].isin(*roles)), lambda m: m["content"])


def prompt(messages: Column) -> Column:
    """The system and user texts, a line each."""
    return F.array_join(of_role(messages, "system", "user"), "\n")


def visible(messages: Column) -> Column:
    return F.array_join(F.filter(F.transform(messages, lambda m: m["content"]), lambda c: c != ""), "\n")


def render(messages: Column) -> Column:
    """START role newline text END newline for every message."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit(START), m["role"], F.lit("\n"), m["content"], F.lit(END + "\n"))), "")


def render_instruction(instruction: Column, response: Column) -> Column:
    return F.concat(F.lit("### Instruction:\n"), instruction, F.lit("\n\n### Response:\n"), response)


def render_thinking(user: Column, reasoning: Column, answer: Column) -> Column:
    return F.concat(F.lit(START + "user\n"), user, F.lit(END + "\n" + START + "assistant\n<think>\n"), reasoning, F.lit("\n</think>\n\n"), answer, F.lit(END + "\n"))


def problem_prompt(title: Column, description: Column, examples: Column, note: Column) -> Column:
    """Title, description, numbered examples (input, output) and a note; absent parts are left out."""
    shown = F.array_join(F.transform(examples, lambda e, i: F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit("\nInput:\n"), e["input"], F.lit("\nOutput:\n"), e["output"])), "\n\n")
    fill = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws("\n\n", fill(title), fill(description), fill(shown), F.when(fill(note).isNotNull(), F.concat(F.lit("Note\n"), note)))


def with_system(messages: Column, system: str) -> Column:
    """A system message before the others, or its text before the one that is there."""
    has = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    joined = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(system + "\n\n"), m["content"])).otherwise(m["content"]).alias("content")))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return F.when(has, joined).otherwise(F.concat(first, messages))


def valid(messages: Column) -> Column:
    """Not empty, known roles, a user message, an assistant message last, and no blank text."""
    last = F.try_element_at(messages, F.lit(-1))
    ok = F.exists(messages, lambda m: m["role"] == "user") & (last["role"] == "assistant")
    known = F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant", "tool") & (T.strip(m["content"]) != ""))
    return F.when(F.size(messages) > 0, F.coalesce(ok & known, F.lit(False))).otherwise(F.lit(False))


def has_reasoning(messages: Column) -> Column:
    """A think tag with something in it."""
    return F.exists(messages, lambda m: m["content"].rlike(r"(?s)<think>(?:(?!</think>).)*?\S(?:(?!</think>).)*</think>"))


#: Marks of broken text, and how an assistant says what it is or cannot do.
BROKEN = ["�", "<|im_start|>", "<|im_end|>", "[assistant/analysis]", "[tool/analysis]"]
DISCLAIMER = r"(?i)as an ai|作为.{0,3}ai|无法访问互联网"
#: The points of a chat.
TWO_TURNS, MORE_TURNS, GOOD_SIZE, OTHER_SIZE, NO_DISCLAIMER, WITH_TOOLS = 5, 3, 3, 1, 2, 2


def replay_category(messages: Column, fields: tuple[str, ...] = ()) -> Column:
    """tools, zh_general or other_general. fields: which of tools and tool_calls the messages have."""
    used = [lambda m, name=name: F.coalesce(m[name] != "", F.lit(False)) for name in fields if name in ("tools", "tool_calls")]
    tools = F.exists(messages, lambda m: reduce(lambda a, b: a | b(m), used, m["role"] == "tool"))
    return F.when(tools, "tools").when(visible(messages).rlike("[\u4e00-\u9fff]"), "zh_general").otherwise("other_general")


def repeated_line(text: Column, line: int = 30, times: int = 3) -> Column:
    """Whether a line of at least `line` characters, NFKC, lower case, single spaces, comes `times` times."""
    from corpusloom.functions.markup import compatible

    return F.coalesce(T.repeats(F.filter(T.lines(compatible(text)), lambda x: F.char_length(x) >= line), times), F.lit(False))


def replay_score(messages: Column, fields: tuple[str, ...] = ()) -> Column:
    """7 to 15 for a chat worth replaying, null for one that is not.

    fields: which of reasoning_content, tools and tool_calls the messages have.
    """
    n, own, bots = F.size(messages), F.array_join(of_role(messages, "user"), "\n"), F.filter(of_role(messages, "assistant"), lambda c: c != "")
    last, text = F.try_element_at(bots, F.lit(-1)), visible(messages)
    fits = n.between(2, 8) & F.exists(messages, lambda m: m["role"] == "user") & (F.size(bots) > 0)
    fits = fits & F.forall(messages, lambda m: m["role"].isin("system", "user", "assistant", "tool"))
    if "reasoning_content" in fields:
        fits = fits & F.forall(messages, lambda m: T.strip(F.coalesce(m["reasoning_content"], F.lit(""))) == "")
    fits = fits & ~T.contains_any(text, BROKEN) & ~repeated_line(text)
    fits = fits & F.char_length(own).between(8, 6000) & F.char_length(last).between(2, 8000) & (T.strip(own) != "") & (T.collapse(F.lower(own)) != T.collapse(F.lower(last)))
    score = (
        F.when(n == 2, TWO_TURNS).otherwise(MORE_TURNS)
        + F.when(F.char_length(own).between(20, 1500), GOOD_SIZE).otherwise(OTHER_SIZE)
        + F.when(F.char_length(last).between(20, 2000), GOOD_SIZE).otherwise(OTHER_SIZE)
        + F.when(~last.rlike(DISCLAIMER), NO_DISCLAIMER).otherwise(0)
        + F.when(replay_category(messages, fields) == "tools", WITH_TOOLS).otherwise(0)
    )
    return F.when(fits, score)


#: Questions about who the assistant is, and words by which it speaks of itself.
IDENTITY_QUESTION = r"(?i)你是谁|你的(?:真实)?(?:身份|模型|来源|开发者|创建者|开发团队)|自我介绍|who are you|what model are you|your (?:model|identity|creator|developer)|who (?:created|developed) you"
SELF_REFERENCE = r"(?i)我是|我的模型|我由|我来自|我基于|我属于|我的开发|我的创建者|开发团队是|开发者是|由.{0,24}(开发|训练|推出|发布)|i\s+am|i'm|my\s+(model|creator|developer|team)|developed\s+by|created\s+by|trained\s+by|based\s+on"


def chat_reasons(messages: Column, names: list[str] | None = None, question: Column | None = None, oversized: int = 20_000) -> Column:
    """Names of all that is odd about a chat; candidates for review, not drops.

    names are the other models and makers whose mention beside a word of self-reference, or right after
    a question about identity, is looked for. question is the prompt field of rows that are no chats:
    there the rules on messages give way to one on an empty question.
    """
    from corpusloom.operators.filters import all_reasons

    users = F.transform(of_role(messages, "user"), T.strip)
    bots = F.transform(of_role(messages, "assistant"), T.strip)
    keys = F.transform(F.filter(users, lambda u: u != ""), lambda u: T.collapse(F.lower(u)))
    last = F.when(F.size(users) > 0, F.try_element_at(users, F.lit(-1)))
    chat = F.lit(True) if question is None else question.isNull()
    claim, asked = F.lit(False), F.lit(False)
    if names:
        brand = "(?i)" + "|".join(names)
        claim = F.exists(bots, lambda t: t.rlike(brand) & t.rlike(SELF_REFERENCE))
        n = F.greatest(F.size(messages) - 1, F.lit(0))
        pairs = F.arrays_zip(F.slice(messages, 1, n).alias("a"), F.slice(messages, 2, n).alias("b"))
        asked = ~claim & F.exists(pairs, lambda p: (p["a"]["role"] == "user") & (p["b"]["role"] == "assistant") & p["a"]["content"].rlike(IDENTITY_QUESTION) & p["b"]["content"].rlike(brand))
    return all_reasons(
        ("possible_foreign_model_identity", claim),
        ("identity_question_mentions_foreign_model", asked),
        ("missing_user_message", chat & (F.size(users) == 0)),
        ("missing_assistant_message", chat & (F.size(bots) == 0)),
        ("empty_user_message", chat & F.exists(users, lambda u: u == "")),
        ("empty_assistant_message", chat & F.exists(bots, lambda u: u == "")),
        ("empty_question", ~chat & (T.strip(question) == "") if question is not None else F.lit(False)),
        ("oversized_question", F.exists(users, lambda u: F.char_length(u) > oversized)),
        ("possibly_incomplete_question", (F.char_length(last) >= 8) & last.rlike(UNFINISHED)),
        ("placeholder_or_template", F.exists(messages, lambda m: m["content"].rlike(PLACEHOLDER))),
        ("duplicate_user_turn", F.size(F.array_distinct(keys)) < F.size(keys)),
        ("invalid_conversation_structure", chat & (F.size(messages) == 0)),
    )


def echoed_turns(messages: Column, claim: str, acceptance: str) -> Column:
    """How often a user's claim is taken up by the assistant in the next turn."""
    n = F.size(messages)
    pairs = F.arrays_zip(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(messages, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    hit = lambda p: (p["a"]["role"] == "user") & (p["b"]["role"] == "assistant") & F.lower(p["a"]["content"]).rlike(claim) & F.lower(p["b"]["content"]).rlike(acceptance)
    return F.size(F.filter(pairs, hit))


def chat_key(messages: Column) -> Column:
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\x1f"), T.strip(m["content"]))), "\x1e"), 256)


def first_prompt(messages: Column) -> Column:
    return F.get(of_role(messages, "user"), F.lit(0))


def last_answer(messages: Column) -> Column:
    bots = of_role(messages, "assistant")
    return F.when(F.size(bots) > 0, F.try_element_at(bots, F.lit(-1)))


def without_last_turn(messages: Column) -> Column:
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))


def filled_fields(record: Column, *names: str) -> Column:
    """JSON of a record without its empty fields."""
    return F.to_json(F.struct(*[F.when(record[n] != "", record[n]).alias(n) for n in names]))
