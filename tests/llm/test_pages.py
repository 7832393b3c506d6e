import re
from collections import Counter, defaultdict

import pytest
from corpusloom.llm import html_extract, line_dedup

PAGES = "page_id long, url string, html string, host string, lines string, text string"
LONG = "First para, with commas, and words enough to count as a paragraph of its own."


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a b"),
        (f"<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p><b>bold<br><p>{LONG}</article><footer>f</footer>", f"T bold {LONG}"),
        (f"<div class='sidebar'><p>{LONG}</p></div><div id=content><p>{LONG}</p><p>Tiny.</p></div>", f"{LONG} Tiny."),
        (f"<header><h1>Site</h1></header><main><p>{LONG}</p><aside>x</aside><form><p>search</p></form></main><div class='comments'><p>{LONG}</p></div>", LONG),
        (f"<div class='post'><p>{LONG} in<b>li</b>ne</p><ul><li>one</li><li>two</li></ul><div class='ad'>buy</div><pre>a  b</pre></div>", f"{LONG} inline one two a b"),
        ("<article><p>&lt;tag&gt; &amp;amp; x&nbsp;y &#233;&#x41;</p></article>", "<tag> &amp; x y éA"),
        ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- c --><p>b</p></article>", "a b"),
        ("<article><p>x < y and 3 > 2</p></article>", "x < y and 3 > 2"),
        ("<article><p title='a>b'>c</p><div style='display: none'>no</div><p hidden>no</p></article>", "c"),
        (f"<p>{LONG}</p><div><a href=x>link text that is long enough, really</a></div>", LONG),
    ],
)
def test_extract(html, want):
    assert html_extract.extract(html) == want


def test_extract_survives_odd_markup():
    for html in ("<", "<div" * 500, "</p></div></html>", "<p " * 2000, "<table><tr><td>a<td>b<tr><td>c", "<div>" * 5000 + "deep", "<script>never closed", "<!-- open", "&#xFFFFFFFF; &bogus;"):
        html_extract.extract(html)
    assert html_extract.extract("<div>" * 3000 + f"<p>{LONG}") == LONG


def test_extract_pages(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "", "", ""), (1, "u", f"<article><p>{LONG}</p></article>", "", "", ""), (2, None, None, "", "", ""), (None, "u", "<p>x</p>" * 30_000, "", "", "")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got.collect()) == [(0, 59_999, 59_999), (1, len(LONG), len(LONG)), (1, len(LONG), len(LONG)), (2, 0, 0)]
    assert html_extract.extract_pages(spark.createDataFrame([], PAGES)).count() == 0


def brute_lines(rows):
    pages = []
    for i, url, html, *_ in rows:
        host = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", (url or "").lower())
        text = re.sub(r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>", "", html or "")
        text = re.sub(r"<[^>]*>", "", re.sub(r"(?i)</?(?:p|div|br|li|nav|footer)\b[^>]*>", "\n", text))
        lines = [x for x in (" ".join(t.split()) for t in text.split("\n")) if x]
        pages.append((i, host[1] if host else "", lines))
    total, seen = Counter(h for _, h, _ in pages), defaultdict(int)
    for _, h, lines in pages:
        for x in set(lines):
            seen[h, x] += 1
    out = []
    for i, h, lines in pages:
        kept = [x for x in lines if not (seen[h, x] >= 3 and seen[h, x] > 0.3 * total[h])]
        out.append((i, h, total[h], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = []
    for i in range(60):
        host = ["http://A.example/x", "https://u@b.example:80/y", "https://c.example?z", None, "odd"][i % 5 if i > 20 else 0]
        rows.append((i, host, f"<nav>menu  here</nav><p>line {i % 7}</p><div>own {i}</div><footer>foot {i % 3}<br>foot {i % 3}</footer><script>x</script>", "c", "c", "c"))
    rows += [(100, "http://a.example", None, "", "", ""), (101, "http://a.example", "", "", "", ""), (5, "http://a.example", "<p>menu here</p>", "", "", ""), (None, "http://a.example", "<p>q</p>" * 20_000, "", "", "")]
    got = line_dedup.dedup_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(((r.page_id, r.host, r.n_pages, r.n_lines, r.n_dropped, r.text) for r in got), key=repr) == brute_lines(rows)
    assert line_dedup.dedup_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_line_dedup_of_texts(spark):
    docs = spark.createDataFrame([(i, f"same\nown {i}", "s") for i in range(4)] + [(9, None, None)], "doc_id long, text string, source string")
    got = line_dedup.dedup_texts(docs, "source")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [*((i, f"own {i}") for i in range(4)), (9, "")]


def test_parts_that_are_no_article():
    page = (
        "<body><div class='siteHeader'>head</div><div id='cookieNotice'>cookies, cookies, cookies</div><article><h1>T</h1><p>{0}</p><div class='byline'>By A.</div><section><p>{0}</p></section></article>"
        "<article class='comment'><p>{0}</p></article><article><p>teaser</p></article><div class='alert'>x</div><footer>f</footer></body>"
    )
    assert html_extract.extract(page.format(LONG)) == f"T {LONG} By A. {LONG}"
    parts = [f"<article>{f'<p>{LONG}</p>' * n}</article>" for n in (6, 10)]
    assert html_extract.extract("".join(parts)) == " ".join([LONG] * 16)


@pytest.mark.parametrize("attrs", ["class='content has-sidebar'", "class='overflow-hidden'", "id='page-with-nav'", "class='no-comments'", "class='post-header-side'", "class='hidden-print x'", "class='sidebar'", "id=comments"])
def test_names_do_not_drop_what_holds_the_article(attrs):
    inner = f"<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><div class='ad'>buy</div></article><div class='comments'>{f'<p>{LONG}</p>' * 9}</div>"
    assert html_extract.extract(f"<body><p>By</p><div {attrs}>{inner}</div><div class='siteFooter'><p>f</p></div>") == f"T {LONG} {LONG}"
    assert html_extract.extract(f"<body><div {attrs}><p>{LONG}</p></div>") == LONG


def test_names_still_drop_what_they_name():
    teasers = f"<div class='related'><article><p>{LONG} {LONG} {LONG}</p></article></div>"
    thread = f"<div id='comments'><article class='comment-body'><p>{LONG} {LONG} {LONG}</p></article></div>"
    legal = f"<div class='footer'><p>{LONG} {LONG} {LONG} {LONG}</p></div>"
    for more in (teasers, thread, legal):
        assert html_extract.extract(f"<body><article class='post comments-open'><p>{LONG}</p></article>{more}") == LONG


def test_made_pages_give_back_their_articles():
    """Pages put together of known parts: the text that must come out is known from how they are made."""
    import random

    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rnd.randint(14, 30))) + ", " + word() + "."
    chrome = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/{word()}>{word()}</a></li>' for _ in range(6))}</ul></nav>",
        lambda: f"<div class='{rnd.choice(['ad', 'cookie-notice', 'social-share', 'newsletter'])}'><p>{word()} {word()}</p></div>",
        lambda: f"<aside><h3>{word()}</h3><p>{sentence()}</p></aside>",
        lambda: f"<form><label>{word()}</label><input type=text><button>{word()}</button></form>",
        lambda: f"<script>var a = '<p>{word()}</p>';</script><style>p {{ color: {word()} }}</style>",
        lambda: f"<!-- <p>{sentence()}</p> -->",
    ]
    for _ in range(150):
        blocks, want = [], []
        for _ in range(rnd.randint(3, 9)):
            text = sentence()
            kind = rnd.random()
            if kind < 0.7:
                w = text.split()
                k = rnd.randrange(len(w))
                blocks.append(f"<p>{' '.join(w[:k])} <b>{w[k]}</b>\n{' '.join(w[k + 1:])}</p>")
            elif kind < 0.85:
                blocks.append(f"<blockquote>{text}</blockquote>")
            else:
                blocks.append(f"<ul><li>{text}<li>{text}</ul>")
                want.append(text)
            want.append(text)
            if rnd.random() < 0.3:
                blocks.append(rnd.choice(chrome[1:])())
        title = word()
        wrap = rnd.choice(["<article>{}</article>", "<main>{}</main>", "<div id=content class='post has-sidebar'>{}</div>"])
        page = f"<html><head><title>{word()}</title></head><body><header>{word()}</header>{rnd.choice(chrome)()}" + wrap.format(f"<h1>{title}</h1>" + "".join(blocks)) + f"{rnd.choice(chrome)()}<footer>{sentence()}</footer></body></html>"
        assert html_extract.extract(page) == " ".join([title, *want])


def test_hostile_pages_take_linear_time():
    import time

    def seconds(n):
        start = time.process_time()
        for html in ("<span>" * n + "<p><button>" * n, "<a b='>x" * n + '<p "q', "<div" * n, "<p>" * n, "<td>" * n + "<tr>" * n, "<!--" * n, "<script>" * n):
            html_extract.extract(html)
        return time.process_time() - start

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.05)


def test_equal_containers_give_the_first_and_its_like():
    one = f"<div><p>{LONG}</p></div>"
    assert html_extract.extract(f"<body>{one}{one}</body>") == f"{LONG} {LONG}"
    assert html_extract.extract(f"<body>{one}<hr></body>") == LONG
