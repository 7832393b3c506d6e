"""Text expressions. All are Spark columns; nothing here leaves the JVM unless its name ends in _udf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str methods treat as white space and as line ends.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
WORD = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+"
WORD_CJK = r"[\u3400-\u9FFF]|[A-Za-z0-9_]+"
SEPARATOR = "\x1f"


def strip(text: Column) -> Column:
    """Outer white space removed (Spark's trim knows the space only)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, outer ones removed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def normalised_newlines(text: Column) -> Column:
    return strip(F.regexp_replace(text, "\r\n?", "\n"))


def words(text: Column) -> Column:
    """Identifier-like words and digit runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def words_cjk(text: Column) -> Column:
    """Words where each CJK character is a word of its own."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_CJK), F.lit(0))


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often `then` uses it inside its own lambdas."""
    return F.transform(F.array(value), then)[0]


def runs(tokens: Column, size: int) -> Column:
    """All runs of `size` tokens as arrays; empty if there are fewer tokens."""

    def each(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.slice(w, i, size))
        return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, each)


def ngrams(tokens: Column, size: int, separator: str = SEPARATOR) -> Column:
    """All runs of `size` tokens, joined; empty if there are fewer tokens."""

    def runs(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), separator))
        return F.when(F.size(w) >= size, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def distinct_ratio(items: Column) -> Column:
    return let(items, lambda x: F.size(F.array_distinct(x)) / F.size(x))


def repeats(items: Column, times: int) -> Column:
    """Whether some item of the array comes at least `times` times (one sort, no counting of all pairs)."""

    def met(o: Column) -> Column:
        found = F.exists(F.sequence(F.lit(0), F.size(o) - times), lambda i: o[i] == o[i + (times - 1)])
        return F.when(F.size(o) >= times, found).otherwise(F.lit(False))

    return let(F.array_sort(items), met)


def contains_any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | text.contains(t)
    return found


def has_controls(text: Column) -> Column:
    """Control characters below space other than tab, line feed and carriage return."""
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def bounded_terms(terms: list[str]) -> str:
    """A pattern for terms with no ASCII letter or digit on either side."""
    return "(?<![a-z0-9])(?:" + "|".join(terms) + ")(?![a-z0-9])"


def count_terms(text: Column, hard: str, weak: str) -> tuple[Column, Column]:
    """Occurrences of hard terms, and of weak ones outside hard spans."""
    low = F.lower(text)
    return F.regexp_count(low, F.lit(hard)), F.regexp_count(F.regexp_replace(low, hard, ""), F.lit(weak))


def sentences(text: Column) -> Column:
    """Sentences by CJK and Latin enders and line feeds, blank ones left out."""
    parts = F.split(text, r"(?<=[\u3002\uFF01\uFF1F!?])|(?<=\.)\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def snippet(text: Column, pattern: str, margin: int = 60) -> Column:
    """The first hit of a pattern with up to `margin` characters on either side, cut ends marked."""
    at = F.regexp_instr(text, F.lit(pattern))
    hit = F.char_length(F.regexp_substr(text, F.lit(pattern)))
    start, end = F.greatest(F.lit(1), at - margin), F.least(F.char_length(text), at + hit - 1 + margin)
    body = F.substring(text, start, end - start + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end < F.char_length(text), "…").otherwise("")))


FENCE = r"(?s)```([A-Za-z0-9+#_-]*)[ \t]*\n(.*?)```"


def fences(text: Column) -> Column:
    """The bodies of all fenced blocks."""
    return F.regexp_extract_all(text, F.lit(FENCE), F.lit(2))


def fence_languages(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), F.lower)


def last_fence(text: Column) -> Column:
    found = fences(text)
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1)))


def only_fence(text: Column) -> Column:
    found = fences(text)
    return F.when(F.size(found) == 1, found[0])


def outside_think(text: Column) -> Column:
    """What follows the last closing think tag; null while a think tag is still open."""
    open_only = text.contains("<think>") & ~text.contains("</think>")
    return F.when(~open_only, F.substring_index(text, "</think>", -1))


NUMBER = r"[+-]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)"


def final_number(text: Column) -> Column:
    """The number after the last line mark ####, or null; nothing earlier stands in for a bad one."""
    tail = F.element_at(F.split(outside_think(text), r"(?m)^[ \t]*####[ \t]*"), -1)
    marked = outside_think(text).rlike(r"(?m)^[ \t]*####")
    bare = F.regexp_replace(strip(tail), ",", "")
    return F.when(marked & strip(tail).rlike(f"^{NUMBER}$"), bare.try_cast("decimal(38,18)") if hasattr(bare, "try_cast") else bare.cast("decimal(38,18)"))


def first_filled(*columns: Column) -> Column:
    """The first column that is not blank."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in columns])


def comment_header(path: Column) -> Column:
    """The path as a comment line in the style of the file's suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    hash_style = suffix.isin("py", "sh", "rb", "r", "yaml", "yml", "toml", "pl")
    markup = suffix.isin("html", "xml", "md", "vue")
    return F.when(hash_style, F.concat(F.lit("# "), path)).when(markup, F.concat(F.lit("<!-- "), path, F.lit(" -->"))).otherwise(F.concat(F.lit("// "), path))


def round_half_even(value: Column, scale: int = 0) -> Column:
    return F.bround(value, scale)


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def seconds_of(duration: Column) -> Column:
    """seconds + nanos of a duration struct."""
    return duration["seconds"] + duration["nanos"] / F.lit(1e9)


def mib(size: Column) -> Column:
    return size / F.lit(1048576)
