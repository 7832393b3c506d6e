"""Claims about who the writer is: per-sentence rules, row verdicts, review windows and decisions.

The caller names the brands; nothing here ships a list of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.filters import any_of, first_reason

#: First-person claims, and what takes a claim back or puts it in another's mouth.
CLAIM = r"\b(?:i am|i'm|my name is|call me|i was (?:made|built|created|trained|developed) by|as an ai (?:model )?(?:by|from|of))\b"
DENIAL = r"\b(?:not|never|no longer|isn't|am not|rather than|unlike)\b"
SUPPOSED = r"\b(?:if|suppose|imagine|pretend|role-?play|act as|would you|were i|as though)\b"
QUOTED = r"[\"“「][^\"”」]*$"
MADE_BY = r"\b(?:made|built|created|trained|developed|released|owned) by\b|\b(?:from|of)\b"


def _names(names: list[str]) -> str:
    return T.bounded_terms([n.lower().replace(".", r"\.") for n in names])


def claim_sentences(text: Column, names: list[str]) -> Column:
    """Sentences that claim to be one of the names, neither denied, supposed nor inside a quotation."""

    def claims(s: Column) -> Column:
        low = F.lower(s)
        before = F.regexp_substr(low, F.lit(r"^.*?(?=" + CLAIM + ")"))
        return low.rlike(CLAIM) & low.rlike(_names(names)) & ~low.rlike(DENIAL) & ~low.rlike(SUPPOSED) & ~F.coalesce(before.rlike(QUOTED), F.lit(False))

    # a cheap test of the whole text first: most texts name nobody
    return F.when(F.lower(text).rlike(_names(names)), F.filter(T.sentences(text), claims)).otherwise(F.array().cast("array<string>"))


def affiliations(text: Column, brand: str, vendors: list[str]) -> Column:
    """Clauses that tie a brand to one of the vendors."""

    def ties(c: Column) -> Column:
        low = F.lower(c)
        return low.rlike(_names([brand])) & low.rlike(_names(vendors)) & low.rlike(MADE_BY) & ~low.rlike(DENIAL)

    clauses = F.flatten(F.transform(T.sentences(text), lambda s: F.split(s, r"[,;，；]")))
    return F.when(F.lower(text).rlike(_names([brand])), F.filter(clauses, ties)).otherwise(F.array().cast("array<string>"))


def scan(text: Column, triggers: list[str], names: list[str]) -> Column:
    """clean, review (a bounded name, but no claim) or claim; triggers are substrings tested first."""
    met = T.contains_any(F.lower(text), [t.lower() for t in triggers])
    named = F.lower(text).rlike(_names(names))
    return F.when(~met | ~named, "clean").when(F.size(claim_sentences(text, names)) > 0, "claim").otherwise("review")


def review_window(text: Column, patterns: list[str], margin: int = 60) -> Column:
    """Evidence for a reviewer: the surroundings of the first pattern that is found."""
    return F.coalesce(*[T.snippet(text, p, margin) for p in patterns])


def verdict(messages: Column, names: list[str], brand: str) -> Column:
    """claims and affiliations in assistant messages, and claims of users that the next turn accepts."""
    from corpusloom.operators.chat import echoed_turns, of_role

    answers = of_role(messages, "assistant")
    return F.struct(
        F.flatten(F.transform(answers, lambda a: claim_sentences(a, names))).alias("claims"),
        F.flatten(F.transform(answers, lambda a: affiliations(a, brand, names))).alias("affiliations"),
        echoed_turns(messages, r"\byou are\b.*" + _names(names), r"^\s*(?:yes|right|correct|that's right|indeed)\b").alias("accepted"),
    )


def decision(found: Column) -> Column:
    """The rule by which a row with such a verdict is dropped, or null."""
    return first_reason(("claims_identity", F.size(found["claims"]) > 0), ("claims_affiliation", F.size(found["affiliations"]) > 0), ("accepts_identity", found["accepted"] > 0))


def clean_reasoning(text: Column, code: Column, most: int = 3200, distinct: float = 0.88, overlap: float = 0.72) -> Column:
    """Reasoning without sentences about itself, doubts and code lines, and without repeats.

    Null if what stays is empty, too repetitive (share of different five-word runs), or mostly words of
    the code. Cut at the last sentence that fits in `most` characters.
    """
    about = r"(?i)\b(?:the user (?:asks|wants|needs)|as an? (?:ai|assistant)|i need to (?:answer|respond)|wait|hmm|maybe|not sure|let me (?:think|check))\b"
    code_line = r"(?m)^\s*(?:def |class |import |from |#include|for \(|while \(|return |print\()|[{};]\s*$"
    kept = F.array_distinct(F.filter(T.sentences(text), lambda s: ~s.rlike(about) & ~s.rlike(code_line)))

    def finish(s: Column) -> Column:
        start = F.struct(F.lit("").alias("t"), F.lit(True).alias("go"))
        step = lambda acc, x: F.when(
            acc["go"] & (F.char_length(acc["t"]) + F.char_length(x) + 1 <= most), F.struct(T.strip(F.concat_ws(" ", acc["t"], x)).alias("t"), F.lit(True).alias("go"))
        ).otherwise(F.struct(acc["t"].alias("t"), F.lit(False).alias("go")))
        return F.aggregate(s, start, step, lambda acc: acc["t"])

    def judge(t: Column) -> Column:
        words, other = T.words(t), T.words(code)
        runs = T.ngrams(words, 5)
        dull = T.let(runs, lambda r: F.when(F.size(r) > 0, T.distinct_ratio(r) < distinct).otherwise(F.lit(False)))
        copied = T.let(F.array_distinct(words), lambda w: F.size(F.array_intersect(w, other)) > overlap * F.size(w))
        return F.when(any_of([t == "", dull, copied]), F.lit(None).cast("string")).otherwise(t)

    return T.let(finish(kept), judge)
