"""Problem statements and articles in HTML as plain text or Markdown."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F

#: Elements that break lines, and elements whose content is left out.
BREAKING = ["p", "div", "center", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "blockquote", "dl"]
LEFT_OUT = ["script", "style", "head"]

#: What is written where an element opens and where it closes, as plain text and as Markdown.
PLAIN_OPEN = {**dict.fromkeys(BREAKING, "\n"), "li": "\n- "}
PLAIN_CLOSE = {**dict.fromkeys(BREAKING, "\n"), "pre": "\n"}
MARKDOWN_OPEN = {**PLAIN_OPEN, **{f"h{n}": f"\n\n{'#' * n} " for n in range(1, 7)}, "pre": "\n\n```\n", "td": "| ", "th": "| "}
MARKDOWN_CLOSE = {**PLAIN_CLOSE, "pre": "\n```\n", "tr": " |\n"}


def events(html: str) -> list[tuple[str, str]]:
    """What a page is made of, in order: (open, tag), (close, tag) and (text, decoded text)."""
    out: list[tuple[str, str]] = []
    parser = HTMLParser(convert_charrefs=True)
    parser.handle_starttag = lambda tag, attrs: out.append(("open", tag))
    parser.handle_endtag = lambda tag: out.append(("close", tag))
    parser.handle_data = lambda data: out.append(("text", data))
    parser.feed(html)
    parser.close()
    return out


def nested(found: list[tuple[str, str]], tags: list[str]) -> list[int]:
    """For every event, how many of these elements are open after it; a stray end counts for nothing."""
    step = {"open": 1, "close": -1}
    steps = (step.get(kind, 0) if tag in tags else 0 for kind, tag in found)
    return list(accumulate(steps, lambda depth, by: max(0, depth + by), initial=0))[1:]


def read_html(html: str | None, markdown: bool = False) -> tuple[str, int]:
    """The text of a statement and how many images it had."""
    found = events(html or "")
    hidden, pre = nested(found, LEFT_OUT), nested(found, ["pre"])
    marks = {"open": MARKDOWN_OPEN, "close": MARKDOWN_CLOSE} if markdown else {"open": PLAIN_OPEN, "close": PLAIN_CLOSE}
    parts = []
    for k, (kind, what) in enumerate(found):
        if kind == "text":
            parts.append("" if hidden[k] else what)
        elif what == "code" and markdown:
            parts.append("" if pre[k] else "`")
        elif what == "pre" and kind == "close" and not (k and pre[k - 1]):  # no pre was open
            parts.append("\n")
        else:
            parts.append(marks[kind].get(what, ""))
    text = re.sub(r"[ \t]+\n", "\n", "".join(parts))
    return re.sub(r"\n{3,}", "\n\n", text).strip(), found.count(("open", "img"))


def html_text(column):
    """text and n_images of a column of HTML, in Arrow batches."""

    @F.pandas_udf("text string, n_images int")
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_html(h) for h in html], columns=["text", "n_images"])

    return run(column)


def html_markdown(column):
    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: read_html(h, True)[0])

    return run(column)


def folded(column):
    """NFKC, case-folded, single spaces."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))

    return run(column)


def compatible(column):
    """NFKC, in lower case, single spaces within each line."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "\n".join(" ".join(unicodedata.normalize("NFKC", x).lower().split()) for x in t.splitlines()))

    return run(column)
