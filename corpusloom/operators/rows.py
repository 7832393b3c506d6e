"""Source layouts to one chat form, categories, provenance, and structured problem rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chat as C

#: Layouts of sources: which columns hold the two sides of an exchange.
LAYOUTS = {"prompt_completion": ("prompt", "completion"), "instruction_response": ("instruction", "response"), "problem_solution": ("problem", "solution")}


def to_chat(rows: DataFrame, layout: str, messages: str = "messages") -> DataFrame:
    """Adds messages (null where a side is empty) from a layout; `messages` itself is cleaned."""
    if layout in LAYOUTS:
        a, b = LAYOUTS[layout]
        return rows.withColumn(messages, C.from_pair(F.col(a), F.col(b)))
    own = F.transform(messages, lambda m: F.struct(C.role_of(m["role"]).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")))
    fine = F.size(own) > 0
    fine = fine & F.forall(own, lambda m: m["role"].isin("system", "user", "assistant", "tool") & (T.strip(m["content"]) != ""))
    return rows.withColumn(messages, F.when(fine, own))


def category(source: Column, table: dict[str, list[str]]) -> Column:
    """The category that lists a source, or null."""
    out = F.lit(None).cast("string")
    for name, members in table.items():
        out = F.when(source.isin(*members), F.lit(name)).otherwise(out)
    return out


def record(text: Column, source: str, **extra: Column) -> list[Column]:
    """The columns of a published row: text, source, its id and what else is known."""
    return [text.alias("text"), F.lit(source).alias("source"), F.sha2(T.strip(text), 256).alias("text_id"), *(c.alias(n) for n, c in extra.items())]


def described(value: Column) -> Column:
    """summary and flow of a JSON description: 20 to 1,000 characters, 1 to 30 steps that are not blank; else null."""
    got = F.from_json(value, "summary string, flow array<string>")
    fine = F.char_length(T.strip(got["summary"])).between(20, 1000) & F.size(got["flow"]).between(1, 30) & F.forall(got["flow"], lambda s: T.strip(s) != "")
    return F.when(F.coalesce(fine, F.lit(False)), got)


def problem_reason(statement: Column, inputs: Column, outputs: Column, images: Column) -> Column:
    """Why a problem with parallel test lists is dropped, or null."""
    from corpusloom.operators.filters import first_reason

    return first_reason(
        ("empty_statement", T.strip(F.coalesce(statement, F.lit(""))) == ""),
        ("image_in_statement", F.coalesce(images, F.lit(0)) > 0),
        ("no_or_mismatched_tests", F.coalesce((F.size(inputs) != F.size(outputs)) | (F.size(inputs) <= 0), F.lit(True))),
    )


def test_cases(inputs: Column, outputs: Column) -> Column:
    """Cases (input, output) of parallel lists."""
    return F.transform(F.arrays_zip(inputs.alias("input"), outputs.alias("output")), lambda c: F.struct(c["input"].alias("input"), c["output"].alias("output")))


def all_tests_pass(score: Column, statuses: Column, judgement: Column, least_tests: int = 5, least_grade: float = 4) -> Column:
    """A perfect score, enough tests that all pass, and no grade of the judgement (JSON) below the least."""
    passed = F.from_json(statuses, "array<string>")
    grades = F.map_values(F.from_json(judgement, "map<string, struct<score: double>>"))
    fine = (score.try_cast("double") >= 1) & (F.size(passed) >= least_tests) & F.forall(passed, lambda s: F.lower(s) == "pass") & F.forall(grades, lambda g: g["score"] >= least_grade)
    return F.coalesce(fine, F.lit(False))


def shifted(ids: Column, mask: Column) -> Column:
    """Inputs, next-token targets and their mask of a preference side."""
    n = F.size(ids)
    return F.struct(F.slice(ids, 1, n - 1).alias("x"), F.slice(ids, 2, n - 1).alias("y"), F.slice(mask, 2, n - 1).alias("mask"))


def maybe_system(messages: Column, system: str, share: float, seed: int, key: Column) -> Column:
    """A system message for a share of chats, the same ones on every run."""
    from corpusloom.functions.hashing import chosen

    return F.when(chosen(seed, share, key), C.with_system(messages, system)).otherwise(messages)


def without_empty_think(messages: Column) -> Column:
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.regexp_replace(m["content"], r"<think>\s*</think>\s*", "").alias("content")))


def only_untagged(rows: DataFrame, tags: str, tag: str) -> DataFrame:
    return rows.where(~F.coalesce(F.array_contains(tags, tag), F.lit(False)))


def supported_language(language: Column, names: list[str]) -> Column:
    low = F.lower(F.coalesce(language, F.lit("")))
    return F.exists(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.contains(low, n))
