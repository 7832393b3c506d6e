"""Site-relative line deduplication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.shared import stored, table

#: A line on more than this share of a host's pages, and on MIN_PAGES of them at least, is boilerplate.
RATIO, MIN_PAGES = 0.3, 3
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
BLANKS = r"[ \t\r\n\x0B\x0C]+"


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def html_lines(html: Column) -> Column:
    """The visible lines of a page: block elements and line feeds part them, blanks are one space."""
    seen = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), UNSEEN, ""), BREAKS, "\n")
    return text_lines(F.regexp_replace(seen, TAG, ""))


def text_lines(text: Column) -> Column:
    """The lines of a text that are not blank, trimmed, with single spaces."""
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))
    return F.filter(clean, lambda x: x != "")


def boilerplate(lines: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, n_pages and the digests of its boilerplate lines, from a table with host and lines.

    The pages of a host that hold a line are counted by partial sums first. As a host's pages hold
    each boilerplate line on over `ratio` of them, it has at most 1/ratio times as many such lines
    as a page has lines on average: the list of a host is bounded by what its pages look like, not
    by how many there are.
    """
    totals = lines.groupBy("host").agg(F.count("*").alias("n_pages"))
    each = lines.select("host", F.explode(F.array_distinct(F.transform("lines", F.md5))).alias("mark"))
    often = each.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    over = often.join(totals, "host").where(F.col("n") > ratio * F.col("n_pages"))
    return totals.join(over.groupBy("host").agg(F.collect_list("mark").alias("marks")), "host", "left")


def drop_boilerplate(lines: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Adds n_pages (of the host), n_lines, n_dropped and kept (the other lines, in order).

    `lines` is a stored table with host and lines (array of strings) besides any further columns.
    The lists are stored too, so that the join with them is a plain one: Spark broadcasts them if
    they are small, and splits the partitions of hosts with many pages if they are not.
    """
    none = F.array().cast("array<string>")
    found = lines.join(stored(boilerplate(lines, ratio, min_pages), "boilerplate"), "host", "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("marks", none), F.md5(x)))
    return found.withColumn("kept", kept).withColumn("n_lines", F.size("lines")).withColumn("n_dropped", F.col("n_lines") - F.size("kept")).drop("marks")


def dedup_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: page_id, url, host, n_pages, n_lines, n_dropped, text.

    Null html has no lines; null and odd URLs share the empty host. Repeated pages count as pages.
    No rows give no rows; further columns are not read.
    """
    own = pages.select("page_id", "url", host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    out = drop_boilerplate(stored(own, "lines"), ratio, min_pages)
    return out.select("page_id", "url", "host", "n_pages", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), F.array_join("kept", "\n").alias("text"))


def dedup_texts(docs: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with text_col cleaned of boilerplate lines; host_col (null: empty) tells the sites."""
    own = docs.select(F.struct("*").alias("__d"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), text_lines(F.col(text_col)).alias("lines"))
    return drop_boilerplate(stored(own, "lines"), ratio, min_pages).select("__d.*", F.array_join("kept", "\n").alias("__clean")).withColumn(text_col, F.col("__clean")).drop("__clean")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_pages(table(spark, sf_dir, "pages"))


OP7_SQL = rf"""
WITH l AS (
  SELECT page_id, url, coalesce(regexp_extract(lower(url), '{HOST}', 1), '') AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{UNSEEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)),
           lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS n_pages FROM l GROUP BY host),
b AS (
  SELECT host, line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) JOIN t USING (host)
  GROUP BY host, line, n_pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO} * n_pages),
m AS (SELECT host, list(line) AS marks FROM b GROUP BY host),
k AS (
  SELECT page_id, url, host, n_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(marks, []), x)) AS kept
  FROM l JOIN t USING (host) LEFT JOIN m USING (host))
SELECT page_id, url, host, n_pages, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS text
FROM k
"""
