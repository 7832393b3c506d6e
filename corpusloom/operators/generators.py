"""Synthetic exercises with answers, one row per number, and an independent check of every answer."""

from __future__ import annotations

import json
import random
import statistics
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id long, family string, prompt string, answer string"

#: Families of exercises over a list of numbers: how each is asked, and how it is answered.
FAMILIES = {
    "keep_even": ("Keep the even numbers in order", lambda v: [x for x in v if x % 2 == 0]),
    "distinct": ("Drop repeats, keeping first places", lambda v: list(dict.fromkeys(v))),
    "once": ("List the numbers that occur exactly once", lambda v: [x for x in v if v.count(x) == 1]),
    "running_max": ("Give the running maximum", lambda v: list(accumulate(v, max))),
    "running_sum": ("Give the running sum", lambda v: list(accumulate(v))),
    "median": ("Give the median", lambda v: statistics.median(v)),
    "ordered": ("Sort by last digit, then by value", lambda v: sorted(v, key=lambda x: (x % 10, x))),
    "counts": ("Count each number, by number", lambda v: {str(k): v.count(k) for k in sorted(set(v))}),
}


def exercise(n: int, seed: int) -> tuple[int, str, str, str]:
    rnd = random.Random(seed * 1_000_003 + n)
    family = sorted(FAMILIES)[n % len(FAMILIES)]
    values = [rnd.randint(0, 30) for _ in range(rnd.randint(3, 12))]
    asked, solve = FAMILIES[family]
    return n, family, f"{asked}: {json.dumps(values)}", json.dumps(solve(values))


def exercises(spark: SparkSession, count: int, seed: int = 0, parts: int | None = None) -> DataFrame:
    """count exercises, the same for a seed on every cluster."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([exercise(int(n), seed) for n in f["id"]], columns=["id", "family", "prompt", "answer"])

    return spark.range(0, count, 1, parts).mapInPandas(run, SCHEMA)


def check(family: str, prompt: str, answer: str) -> bool:
    """Whether an answer is right, found by other means than it was made."""
    v, got = json.loads(prompt.split(": ", 1)[1]), json.loads(answer)
    if family == "keep_even":
        return got == [x for x in v if not x & 1]
    if family == "distinct":
        return len(got) == len(set(v)) and [v.index(x) for x in got] == sorted(v.index(x) for x in got)
    if family == "once":
        return sorted(got) == sorted(x for x in set(v) if sum(y == x for y in v) == 1)
    if family == "running_max":
        return got == [max(v[: k + 1]) for k in range(len(v))]
    if family == "running_sum":
        return got == [sum(v[: k + 1]) for k in range(len(v))]
    if family == "median":
        s = sorted(v)
        return got * 2 == s[(len(s) - 1) // 2] + s[len(s) // 2]
    if family == "ordered":
        return sorted(got) == sorted(v) and all((a % 10, a) <= (b % 10, b) for a, b in zip(got, got[1:], strict=False))
    return sum(got.values()) == len(v) and all(got[str(x)] == v.count(x) for x in v)


def anchors(spark: SparkSession, pool: list[tuple[str, str]], times: int) -> DataFrame:
    """A pool of question and answer pairs, repeated."""
    rows = spark.createDataFrame(pool, "prompt string, answer string")
    return rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


#: Fixed lists that the generated rows choose from.
WHO = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo"]
WHERE = ["Oslo", "Lima", "Bonn", "Kyoto", "Quito", "Turin"]
WHAT = ["apples", "pens", "tickets", "stamps", "bricks"]


def draw(n: Column, k: int, size: int, seed: int = 0) -> Column:
    """The k-th whole number from 0 to size - 1 that row n draws: the same on every cluster, and in any SQL."""
    return F.pmod((n + 1) * F.lit(7919 + 104_729 * seed) + F.lit(k) * (n + 13) * F.lit(31) + F.lit(k * 17), F.lit(size)).cast("int")


def drawn_list(n: Column, size: int = 31, seed: int = 0) -> Column:
    """A list of 3 to 8 drawn numbers."""
    return F.slice(F.array(*[draw(n, k, size, seed) for k in range(1, 9)]), 1, draw(n, 0, 6, seed) + 3)


def choice(names: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), at + 1)


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0), lambda a, x: a + x)


def _divisor(v: Column) -> Column:
    """The greatest common divisor, by trying all from 30 down; 0 for zeros only."""
    fits = F.filter(F.sequence(F.lit(30), F.lit(1), F.lit(-1)), lambda d: F.forall(v, lambda x: x % d == 0))
    return F.when(F.exists(v, lambda x: x > 0), fits[0]).otherwise(0)


#: Kinds of strict questions about a list: the question, and the one right number.
STRICT = {
    "sum": ("What is the sum", _total),
    "maximum": ("What is the largest number", F.array_max),
    "minimum": ("What is the smallest number", F.array_min),
    "spread": ("What is the largest minus the smallest", lambda v: F.array_max(v) - F.array_min(v)),
    "count": ("How many numbers are there", F.size),
    "distinct": ("How many different numbers are there", lambda v: F.size(F.array_distinct(v))),
    "even": ("How many are even", lambda v: F.size(F.filter(v, lambda x: x % 2 == 0))),
    "above": ("How many are above 15", lambda v: F.size(F.filter(v, lambda x: x > 15))),
    "first": ("What is the first number", lambda v: v[0]),
    "last": ("What is the last number", lambda v: F.element_at(v, -1)),
    "second": ("What is the second smallest, repeats counted", lambda v: F.array_sort(v)[1]),
    "alternating": ("Add the numbers with signs + - + - in turn: what results", lambda v: F.aggregate(F.transform(v, lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)),
    "remainder": ("What is the sum's remainder by 7", lambda v: _total(v) % 7),
    "divisor": ("What is the greatest common divisor", _divisor),
    "rises": ("How often is a number larger than the one before it", lambda v: F.size(F.filter(F.transform(v, lambda x, i: (i > 0) & (x > F.get(v, i - 1))), lambda up: up))),
}


def strict_questions(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """id, kind, values, prompt, answer: the kinds in turn, over drawn lists."""
    kinds = list(STRICT)
    rows = spark.range(count).withColumn("values", drawn_list(F.col("id"), seed=seed)).withColumn("kind", choice(kinds, (F.col("id") % len(kinds)).cast("int")))
    asked, right = F.lit(None).cast("string"), F.lit(None).cast("int")
    for kind, (question, solve) in STRICT.items():
        asked = F.when(F.col("kind") == kind, question).otherwise(asked)
        right = F.when(F.col("kind") == kind, solve(F.col("values"))).otherwise(right)
    shown = F.concat(F.lit("Numbers: "), F.array_join(F.transform("values", lambda x: x.cast("string")), ", "), F.lit(". "))
    return rows.select("id", "kind", "values", F.concat(shown, asked, F.lit("?")).alias("prompt"), right.alias("answer"))


def _line(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


#: Families of worked chains over three drawn numbers: the equations, line by line, and the result.
CHAINS = {
    "two_sums": lambda a, b, c: ([(a, " + ", b, " = ", a + b), (a + b, " + ", c, " = ", a + b + c)], a + b + c),
    "price": lambda a, b, c: ([(a, " * ", b, " = ", a * b), (a * b, " + ", c, " = ", a * b + c)], a * b + c),
    "change": lambda a, b, c: ([(b, " + ", c, " = ", b + c), ("100 - ", b + c, " = ", F.lit(100) - b - c)], F.lit(100) - b - c),
    "perimeter": lambda a, b, c: ([(a, " + ", b, " = ", a + b), ("2 * ", a + b, " = ", (a + b) * 2)], (a + b) * 2),
    "area": lambda a, b, c: ([(a, " * ", b, " = ", a * b)], a * b),
    "distance": lambda a, b, c: ([(c, " - ", b, " = ", c - b), (a, " * ", c - b, " = ", a * (c - b))], a * (c - b)),
    "difference": lambda a, b, c: ([(a, " - ", b, " = ", a - b), (a - b, " - ", c, " = ", a - b - c)], a - b - c),
    "shares": lambda a, b, c: ([(a, " * ", c, " = ", a * c), (a * c, " / ", a, " = ", c)], c),
    "squares": lambda a, b, c: ([(a, " * ", a, " = ", a * a), (b, " * ", b, " = ", b * b), (a * a, " + ", b * b, " = ", a * a + b * b)], a * a + b * b),
    "tens": lambda a, b, c: ([(a, " * 10 = ", a * 10), (a * 10, " + ", b, " = ", a * 10 + b)], a * 10 + b),
}


def worked_chains(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """id, family, steps (equations, a line each), answer: the families in turn."""
    names, n = list(CHAINS), F.col("id")
    a, b, c = (draw(n, k, 20, seed) + 1 for k in (1, 2, 3))
    rows = spark.range(count).withColumn("family", choice(names, (n % len(names)).cast("int")))
    steps, right = F.lit(None).cast("string"), F.lit(None).cast("int")
    for family, build in CHAINS.items():
        lines, result = build(a, b, c)
        steps = F.when(F.col("family") == family, F.concat_ws("\n", *[_line(*x) for x in lines])).otherwise(steps)
        right = F.when(F.col("family") == family, result).otherwise(right)
    return rows.select("id", "family", steps.alias("steps"), right.cast("int").alias("answer"))


def rule_pairs(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """pair, side, prompt, answer: two rows for each rule, one that meets it and one that does not; a unit of selection."""
    n = F.col("pair")
    limit, gap = draw(n, 1, 50, seed) + 10, draw(n, 2, 9, seed) + 1
    rows = spark.range(count).select(F.col("id").alias("pair"), F.explode(F.array(F.lit("meets"), F.lit("fails"))).alias("side"))
    value = F.when(F.col("side") == "meets", limit + gap).otherwise(limit - gap)
    prompt = _line("Rule: a parcel above ", limit, " kg goes by ship, others by mail. A parcel weighs ", value, " kg. How does it go?")
    return rows.select("pair", "side", prompt.alias("prompt"), F.when(value > limit, "ship").otherwise("mail").alias("answer"))


def template_sentences(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    n = F.col("id")
    text = F.concat(choice(WHO, draw(n, 1, len(WHO), seed)), F.lit(" buys "), (draw(n, 2, 90, seed) + 10).cast("string"), F.lit(" "), choice(WHAT, draw(n, 3, len(WHAT), seed)), F.lit(" in "), choice(WHERE, draw(n, 4, len(WHERE), seed)), F.lit("."))
    return spark.range(count).select("id", text.alias("text"))


def entry(n: int, k: int) -> tuple[str, int]:
    """The k-th line of ledger n, and its amount."""
    amount = ((n + 1) * 7919 + k * (n + 13) * 31 + k * 17) % 199 - 99
    return f"Entry {k}: {amount:+d}\n", amount


def ledgers(spark: SparkSession, count: int, target: int) -> DataFrame:
    """id, n_entries, n_chars, balance, text: as many lines as fit the target, found by bisection on their running length."""

    def run(frames):
        for f in frames:
            out = []
            for n in f["id"]:
                lines = [entry(int(n), k) for k in range(1, target // 11 + 1)]  # a line has 11 characters at least
                ends = list(accumulate(len(x) for x, _ in lines))
                fits = bisect_right(ends, target)
                out.append((n, fits, ends[fits - 1] if fits else 0, sum(a for _, a in lines[:fits]), "".join(x for x, _ in lines[:fits])))
            yield pd.DataFrame(out, columns=["id", "n_entries", "n_chars", "balance", "text"])

    return spark.range(count).mapInPandas(run, "id long, n_entries int, n_chars int, balance int, text string")


def curriculum(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """id, family, messages: chats of eight families in turn, whose answers follow from what was asked.

    sequence and boundary ask about a list (an empty one in the latter), entity and missing about a
    person (of whom something is not told in the latter), condition compares, protocol wants a format,
    multi_turn asks twice about one list, code asks what a line of Python gives.
    """
    n, v = F.col("id"), F.col("v")
    text = lambda x: F.array_join(F.transform(x, lambda i: i.cast("string")), ", ")
    who, city, age, other = choice(WHO, draw(n, 11, len(WHO), seed)), choice(WHERE, draw(n, 12, len(WHERE), seed)), draw(n, 13, 60, seed) + 18, draw(n, 14, 60, seed) + 18
    even = F.filter(v, lambda x: x % 2 == 0)
    asks = {
        "sequence": [(_line("Keep the even numbers in order: ", text(v)), text(even))],
        "entity": [(_line(who, " is ", age, " and lives in ", city, ". Where does ", who, " live?"), city)],
        "condition": [(_line("If ", age, " is above ", other, " say yes, or else no."), F.when(age > other, "yes").otherwise("no"))],
        "protocol": [(_line("Answer as JSON with the keys name and age: ", who, ", ", age), F.to_json(F.struct(who.alias("name"), age.alias("age"))))],
        "boundary": [(F.lit("What is the sum of an empty list?"), F.lit("0"))],
        "multi_turn": [(_line("What is the largest of ", text(v), "?"), F.array_max(v).cast("string")), (F.lit("And the smallest?"), F.array_min(v).cast("string"))],
        "missing": [(_line(who, " lives in ", city, ". How old is ", who, "?"), F.lit("That is not told."))],
        "code": [(_line("What does len([", text(v), "]) give?"), F.size(v).cast("string"))],
    }
    rows = spark.range(count).withColumn("v", drawn_list(n, seed=seed)).withColumn("family", choice(list(asks), (n % len(asks)).cast("int")))
    messages = F.lit(None).cast("array<struct<role:string,content:string>>")
    for family, turns in asks.items():
        chat = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for turn in turns for role, content in zip(("user", "assistant"), turn, strict=True)])
        messages = F.when(F.col("family") == family, chat).otherwise(messages)
    return rows.select("id", "family", messages.alias("messages"))
