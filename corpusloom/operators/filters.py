"""Filters. Each gives a reason column (null: kept) or a boolean, so that every drop has a name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import code as K
from corpusloom.functions import text as T

#: Texts with these, in any case, are not clean.
BAD_MARKERS = ["�", "write a paper online", "online casino", "click here to buy", "<|im_start|>", "<|im_end|>", "[assistant/analysis]"]
#: Further marks of wrongly decoded text.
MOJIBAKE = ["Ã", "Â"]
CONTROL_TOKEN = r"<\|(?:im_start|im_end|endoftext)\|>"
CREDENTIAL = r"(?<![A-Za-z0-9_-])(?:sk-[A-Za-z0-9_-]{24,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})(?![A-Za-z0-9_-])"
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----"


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])


def all_reasons(*rules: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules]), lambda r: r.isNotNull())


def repeats_a_line(text: Column, line: int, times: int) -> Column:
    """Whether a line of at least `line` characters, in lower case and with single spaces, comes `times` times.

    Lower-casing makes a character three at most, so shorter lines are left out before the dear steps.
    """
    long = F.filter(T.lines(text), lambda x: F.char_length(x) * 3 >= line)

    def met(some: Column) -> Column:
        plain = F.filter(F.transform(some, lambda x: T.collapse(F.lower(x))), lambda x: F.char_length(x) >= line)
        return F.when(F.size(some) >= times, T.repeats(plain, times)).otherwise(F.lit(False))

    return F.when(F.char_length(text) * 3 >= line * times, T.let(long, met)).otherwise(F.lit(False))


def clean_text(text: Column, least: int = 200, most: int = 200_000, line: int = 80, times: int = 4, markers: list[str] | None = None) -> Column:
    """Of fitting length, without bad markers or controls, and no long line too often. Cheap tests come first."""
    marked = T.let(F.lower(text), lambda low: T.contains_any(low, [m.lower() for m in markers or BAD_MARKERS]))
    fits = F.coalesce(F.char_length(text).between(least, most), F.lit(False))
    return F.when(fits, F.when(T.has_controls(text) | marked, F.lit(False)).otherwise(~repeats_a_line(text, line, times))).otherwise(F.lit(False))


def strict_text(text: Column, least: int, most: int) -> Column:
    """The variant of fewer rules: stripped length, no bad marker, and no control character at all."""
    size = F.char_length(T.strip(text))
    return F.coalesce((size >= least) & (F.char_length(text) <= most) & ~T.contains_any(F.lower(text), [m.lower() for m in BAD_MARKERS]) & ~T.has_controls(text), F.lit(False))


def clean_article(text: Column) -> Column:
    """The shorter variant, which also rejects wrongly decoded text."""
    return clean_text(text, 100, 50_000, 50, 3, BAD_MARKERS + MOJIBAKE)


def code_record_reason(task: Column, analysis: Column, solution: Column, test: Column, full: Column, python: bool = False) -> Column:
    """Why a structured code record is dropped. Python solutions must parse and do more than raise NotImplementedError."""
    named = {"task": task, "analysis": analysis, "solution": solution, "test": test, "full_content": full}
    short = [(f"missing_or_short_{k}", F.char_length(T.strip(F.coalesce(c, F.lit("")))) < 40) for k, c in named.items()]
    unfinished = r"(?im)^\s*(?://|#|/\*)\s*(?:YOUR_CODE_HERE|IMPLEMENT_ME|\[(?:insert\s+|placeholder\b)[^\]]*\])"
    return first_reason(
        *short,
        ("encoding_corruption", T.contains_any(full, ["\x00", "�"])),
        ("embedded_control_token", full.rlike(CONTROL_TOKEN)),
        ("unresolved_implementation_placeholder", solution.rlike(unfinished)),
        *((("python_solution_syntax", ~K.over(solution, K.parses, "boolean")), ("python_unimplemented_function", K.over(solution, K.only_raises, "boolean"))) if python else ()),
    )


def accepted_component(language: Column, score: Column, vendored: Column, generated: Column, allowed: list[str] | None = None, denied: tuple[str, ...] = (), least: float = 0.0) -> Column:
    """Why a row of a component is not taken: its language, its score, or that it is not the repository's own; else null."""
    low = F.lower(F.coalesce(language, F.lit("")))
    return first_reason(
        ("language_denied", low.isin(*[d.lower() for d in denied]) if denied else F.lit(False)),
        ("language_not_allowed", ~low.isin(*[a.lower() for a in allowed]) if allowed else F.lit(False)),
        ("score_below_threshold", ~F.coalesce(score.try_cast("double") >= least, F.lit(False))),
        ("vendored_code", vendored),
        ("generated_code", generated),
    )


def scored_code_reason(content: Column, uuid: Column, repo: Column, path: Column, relevance: Column, quality: Column, category: Column) -> Column:
    """Why a scored source file is dropped."""
    rel, qual = relevance.cast("double"), quality.cast("double")
    finite = lambda x: ~(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    bare = F.lower(F.regexp_replace(uuid, "-", ""))
    conflict = content.rlike(r"(?m)^<<<<<<< .+$") & content.rlike(r"(?m)^=======$") & content.rlike(r"(?m)^>>>>>>> .+$")
    html = F.lower(F.substring(content, 1, 500)).contains("<html") & F.lower(F.right(content, F.lit(1000))).contains("</html>")
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    return first_reason(
        ("empty_content", missing(T.strip(content))),
        ("missing_provenance", missing(uuid) | missing(repo) | missing(path)),
        ("invalid_source_scores_or_uuid", ~bare.rlike("^[0-9a-f]{32}$") | rel.isNull() | qual.isNull()),
        ("nonfinite_score", ~finite(rel) | ~finite(qual)),
        ("invalid_score_range", ~rel.between(0, 1) | ~qual.between(0, 10)),
        ("upstream_quality_gate", F.coalesce(category == "EXCLUDE", F.lit(False)) | (qual < 3)),
        ("invalid_encoding", T.contains_any(content, ["\x00", "�"])),
        ("unresolved_merge_conflict", conflict),
        ("html_in_code", html),
    )


def credential(text: Column) -> Column:
    """A private key header, or a token literal of twelve or more different characters."""
    tokens = F.regexp_extract_all(text, F.lit(CREDENTIAL), F.lit(0))
    return text.rlike(PRIVATE_KEY) | F.exists(tokens, lambda t: F.size(F.array_distinct(F.split(t, ""))) >= 12)


def license_of(value: Column) -> Column:
    """The licence a label stands for, or null; the order of the tests matters."""
    low = F.lower(value)
    return (
        F.when(low.contains("public domain"), "Public Domain")
        .when(T.contains_any(low, ["cc0", "publicdomain/zero", "zero/1.0"]), "CC0")
        .when(T.contains_any(low, ["attribution share-alike", "/by-sa/"]), "CC BY-SA")
        .when(T.contains_any(low, ["creative commons - attribution", "/licenses/by/"]), "CC BY")
    )


def _rating_at_most(label: Column, most: int) -> Column:
    return F.when(label.rlike(r"^\d{1,9}$"), label.try_cast("int") <= most).otherwise(F.lit(False))


def easy(difficulty: Column) -> Column:
    label = F.lower(T.strip(F.coalesce(difficulty, F.lit(""))))
    return label.isin("introductory", "easy", "beginner", "basic", "1", "1.0") | _rating_at_most(label, 1200)


def eligible(difficulty: Column) -> Column:
    label = F.lower(T.strip(F.coalesce(difficulty, F.lit(""))))
    return easy(difficulty) | label.isin("medium", "intermediate") | _rating_at_most(label, 1600)


def train_only(splits: Column) -> Column:
    """Whether all of a row's split labels are train."""
    return (F.size(splits) > 0) & F.forall(splits, lambda s: F.lower(T.strip(s)) == "train")


#: Words that only broken text has, Latin words run into CJK ones, and names where that is usual.
BROKEN_WORDS = ["usuario", "uptake外", "郁strong", "天numer", "<unk>"]
MIXED = r"[A-Za-z]{4,}[\u3400-\u9fff]|[\u3400-\u9fff][A-Za-z]{4,}"
MIXED_ALLOWED = r"(?i)(?:Python|JavaScript|TypeScript|Java|Linux|Windows|Android|iOS|API|JSON|HTML|CSS|SQL|GitHub|App|ChatGPT|OpenAI|Transformer|Token|Web|HTTP|HTTPS|VPN|JVM|GUI|Hadoop|Spark)[\u3400-\u9fff]"


def bad_visible_text(text: Column) -> Column:
    """Blank, broken, mixed or strongly repetitive text."""
    own = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z\u3400-\u9FFF]+"), F.lit(0))
    dull = T.let(own, lambda w: F.when(F.size(w) >= 60, T.distinct_ratio(T.ngrams(w, 5)) < 0.82).otherwise(F.lit(False)))
    mixed = F.regexp_count(text, F.lit(MIXED)) - F.regexp_count(text, F.lit(MIXED_ALLOWED)) >= 2
    return F.coalesce((T.strip(text) == "") | T.contains_any(text, ["�", "\x00"]) | T.contains_any(F.lower(text), BROKEN_WORDS) | mixed | dull, F.lit(True))


def topic_rows(text: Column, strict: list[str], ambiguous: list[str]) -> Column:
    """Any strict term, or two different ambiguous ones."""
    low = F.lower(text)
    weak = F.array_distinct(F.regexp_extract_all(low, F.lit(T.bounded_terms(ambiguous)), F.lit(0)))
    return low.rlike(T.bounded_terms(strict)) | (F.size(weak) >= 2)


def within_tokens(text: Column, most: int, count: Column) -> Column:
    """Whether a text has at most `most` tokens; a byte-level vocabulary never needs more than its bytes."""
    return F.when(F.octet_length(text) <= most, F.lit(True)).otherwise(count <= most)


def decide(docs: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds outcome: the first rule that holds, or keep."""
    return docs.withColumn("outcome", F.coalesce(first_reason(*rules), F.lit("keep")))


def require_all(rows: DataFrame, column: str, what: str) -> DataFrame:
    """rows, if the column is null nowhere; else an error that counts the rows."""
    missing = rows.where(F.col(column).isNull()).count()
    if missing:
        raise ValueError(f"{missing} rows have no {what}")
    return rows


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
