"""Main text of web pages by scoring the tree of elements."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import table, text_or_empty, text_slices

def _markup(attrs: str) -> re.Pattern:
    return re.compile(rf"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?:{attrs}(?P<loose>[^>]*+>))|<[!?/][^>]*+>", re.S)


#: A tag ends at the first > outside quotes, or at the first at all if its quotes are never closed.
MARKUP = _markup(r"(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)|")
#: After this many tags with quotes that are never closed, the quotes of a page mean nothing any more.
BARE, MOST_BROKEN = _markup("(?P<attrs>(?!))|"), 8
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and none of the page's text.
RAW = frozenset("script style template noscript iframe noembed noframes object textarea title svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Never part of an article.
ASIDE = frozenset("nav aside footer header form button select input label fieldset dialog menu head audio video canvas map".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar".split())
#: Words of class and id that name such parts.
ASIDE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adbox|adslot|adsbygoogle|banner|breadcrumbs?|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|announcement|"
    r"footer|header|masthead|nav|navbar|navigation|menu|topbar|toolbar|sidebar|side|widget|related|recommended|share|sharing|social|promo\w*|sponsor\w*|"
    r"subscribe|subscription|newsletter|popup|modal|overlay|login|signup|pager|pagination|skip|hidden|sr-only)(?:$|[\s_-])",
    re.I,
)
READER = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|ads?|adverts?|advertisement|sponsored|promo)(?:$|[\s_-])", re.I)
#: Words that make the rest of a name a description, and ends that make a state of it: has-sidebar, comments-open.
DESCRIBES = re.compile(r"(?:^|[_-])(?:has|have|no|not|non|with|without|overflow(?:[_-][xy])?|backface)[_-].*|.*[_-](?:open|closed|enabled|disabled)$|^hidden[_-].*", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLOSES = {  # an opening tag ends an open element of these, up to the given fence
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
P_FENCE = frozenset("td th caption button object body html".split())
ENDS_P = BLOCK - {"br", "option", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "head"}
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 figcaption".split())
CONTAINER = {"article": 30.0, "main": 25.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "th": -5.0, "body": 0.0, "html": -1.0}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "score", "text", "linked", "own", "named", "mains", "articles", "prose")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list = []
        self.score = self.text = self.linked = self.own = 0
        self.named = self.mains = self.articles = self.prose = 0


def parse(html: str) -> Node:
    """A tree of elements and decoded texts; unclosed, misnested and unknown tags are borne."""
    root = Node("html", "", None)
    stack, at, n = [root], 0, len(html)
    opened: defaultdict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a tag are
    last, markup, broken = html.rfind(">") + 1, MARKUP, 0

    def close(down_to: int) -> None:
        for x in stack[down_to:]:
            opened[x.tag].pop()
        del stack[down_to:]

    def end_open(tags: frozenset | tuple, fence: frozenset | tuple) -> None:
        """Ends the open elements of these tags within the fence."""
        if any(opened[t] for t in tags):
            edge = max((opened[t][-1] for t in fence if opened[t]), default=0)
            inside = [opened[t][k] for t in tags if (k := bisect_right(opened[t], edge)) < len(opened[t])]
            if inside:
                close(min(inside))

    while at < n:
        m = markup.search(html, at, last)
        if not m:
            stack[-1].children.append(unescape(html[at:].partition("<!--")[0]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["tag"] is None:
            if at == last and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>")):
                break
            continue
        tag, attrs = m["tag"].lower(), m["attrs"] or m["loose"]
        if m["attrs"] is None and ('"' in attrs or "'" in attrs):
            broken += 1
            markup = BARE if broken > MOST_BROKEN else MARKUP
        if m["end"]:
            if opened[tag]:
                close(opened[tag][-1])
            continue
        if tag in ENDS_P:
            end_open(("p",), P_FENCE)
        if tag in CLOSES:
            end_open(*CLOSES[tag])
        if tag in RAW:
            if not attrs.endswith("/>") or tag in ("script", "style", "title"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag == "html":
            root.attrs = root.attrs or attrs
            continue
        child = Node(tag, attrs, stack[-1])
        stack[-1].children.append(child)
        if tag not in VOID and not (attrs.endswith("/>") and tag in ASIDE):
            opened[tag].append(len(stack))
            stack.append(child)
    return root


def aside(node: Node) -> bool:
    """Menus, headers, footers, forms and hidden parts, by tag, role, or attribute."""
    if node.tag in ASIDE:
        return True
    if len(node.attrs) < 4 or node.tag in ("body", "html"):
        return False
    for name, *values in ATTR.findall(node.attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "role":
            if value.lower() in ASIDE_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def named(node: Node, words: re.Pattern) -> int:
    """2 if a class or the id is one of the words, 1 if one has such a part, or else 0."""
    found = 0
    if len(node.attrs) >= 4 and node.tag not in ("body", "html"):
        for name, *values in ATTR.findall(node.attrs):
            if name.lower() in ("class", "id"):
                for token in next((v for v in values if v), "").split():
                    token = DESCRIBES.sub("", CAMEL.sub("-", token))
                    if m := words.search(token):
                        found = max(found, 2 if m[0] == token else 1)
    return found


def prune(root: Node, by_name: bool = True) -> list[Node]:
    """Drops asides, and by class and id menus, sidebars, notices, adverts and comments; the nodes
    that stay, parents before children.

    What only part of a name tells apart stays if it holds a main element or most of the page's text
    out of links and comments; what a whole name does, if that text has a main element in it or all
    articles.
    """
    kept, stack = [], [root]
    while stack:
        node = stack.pop()
        kept.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not aside(c)]
        stack.extend(c for c in node.children if not isinstance(c, str))
    if not by_name:
        return kept
    for node in reversed(kept):
        own = node.tag in ("article", "main")
        node.named = named(node, READER if own else ASIDE_WORD)
        for c in node.children:
            if isinstance(c, str):
                node.prose += len(c.strip())
            else:
                node.prose, node.mains, node.articles = node.prose + c.prose, node.mains + c.mains, node.articles + c.articles
        if own and not node.named:
            node.mains, node.articles = node.mains + (node.tag == "main"), node.articles + 1
        if node.tag == "a" or node.named and not node.articles and named(node, READER):
            node.prose = 0
    if not any(node.named for node in kept):
        return kept

    def stays(node: Node) -> bool:
        if node.named == 0:
            return True
        most = 2 * node.prose > root.prose
        return most or node.mains > 0 if node.named == 1 else most and (node.mains > 0 or 0 < node.articles == root.articles)

    kept, stack = [], [root]
    while stack:
        node = stack.pop()
        kept.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or stays(c)]
        stack.extend(c for c in node.children if not isinstance(c, str))
    return kept


def measure(nodes: list[Node]) -> None:
    """Letters of text, linked letters and commas of every node, children first."""
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                size = len(c.strip())
                node.text += size
                node.own += size
            else:
                node.text += c.text
                node.linked += c.linked
                if c.tag not in BLOCK:
                    node.own += c.own
        if node.tag == "a":
            node.linked = node.text


def commas(node: Node) -> int:
    total, stack = 0, [node]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                total += c.count(",") + c.count("，") + c.count("、")
            elif c.tag not in BLOCK:
                stack.append(c)
    return total


def density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def score(nodes: list[Node]) -> Node:
    """Passes the points of paragraphs to their ancestors and returns the best container."""
    seen = []
    for node in nodes:
        if node.own and (node.tag in PARAGRAPH or node.tag in CONTAINER):
            points = (1.0 if node.own >= 25 else 0.2) + commas(node) + min(node.own / 100, 3.0)
            up, share = node if node.tag in CONTAINER and node.tag != "td" else node.parent, 1.0
            for level in range(5):
                if up is None:
                    break
                up.score += points * share
                seen.append(up)
                up, share = up.parent, (0.5, 1 / 3, 1 / 6, 1 / 9, 0)[level]
    best, top = nodes[0], float("-inf")
    for node in dict.fromkeys(seen):
        if node.tag not in CONTAINER:
            continue
        node.score = (node.score + CONTAINER[node.tag]) * (1 - density(node))
        if node.score > top:
            best, top = node, node.score
    return best


def container(best: Node) -> Node:
    """The article or main element around the best container, if there is one."""
    found, up = best, best.parent
    while up is not None:
        if up.tag in ("article", "main"):
            found = up
        up = up.parent
    return found


def kept_nodes(best: Node) -> list:
    """The best container and the siblings that read like more of it, in page order; equals always do."""
    if best.tag in ("html", "body"):  # no container: all but blocks of links
        return [c for c in best.children if isinstance(c, str) or c.tag not in BLOCK or density(c) <= 0.8]
    like = lambda score: min(max(10.0, 0.2 * score), score) if score > 0 else 10.0
    least = like(best.score)
    out = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif not isinstance(c, str):
            loose = c.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and density(c) < 0.25 and c.text > 0
            if c.tag == best.tag == "article":  # both have the bonus of their tag
                near = c.score - CONTAINER["article"] >= like(best.score - CONTAINER["article"])
            else:
                near = c.score >= least or loose and best.tag != "article"
            if near:
                out.append(c)
    return out


def text_of(nodes: list[Node]) -> str:
    """Texts in page order; blocks are set apart, white space runs are one space."""
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.tag in BLOCK:
            parts.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def extract(html: str) -> str:
    """The main text of a page, empty if it has none. Names do not empty a page."""
    for by_name in (True, False):
        nodes = prune(parse(html), by_name)
        measure(nodes)
        text = text_of(kept_nodes(container(score(nodes))))
        if text:
            break
    return text


def _extract_batches(batches):
    for batch in batches:
        for part in text_slices(batch, "html"):
            texts = [extract(h) for h in part["html"].to_pylist()]
            cols = [part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null html is empty and gives an empty text; null ids and urls stay null; repeated pages give
    repeated rows; no rows give no rows; further columns are not read.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return own.mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
