"""Filter queries."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import filters as P
from corpusloom.operators import recipes as R
from corpusloom.plans.registry import query, read

WORDS_SQL = r"regexp_extract_all(lower({0}), '[A-Za-z_][\p{{L}}\p{{N}}_]*|\p{{Nd}}+')"
CLEAN_SQL = r"""
  SELECT doc_id, n BETWEEN {least} AND {most}
      AND NOT (low LIKE '%' || chr(65533) || '%' OR low LIKE '%write a paper online%' OR low LIKE '%online casino%' OR low LIKE '%click here to buy%'
               OR low LIKE '%<|im_start|>%' OR low LIKE '%<|im_end|>%' OR low LIKE '%[assistant/analysis]%' {more})
      AND NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')
      AND coalesce(m, 0) < {times} AS ok
  FROM (SELECT doc_id, text, lower(text) AS low, length(text) AS n FROM documents)
  LEFT JOIN (
    SELECT doc_id, max(c) AS m FROM (
      SELECT doc_id, l, count(*) AS c FROM (
        SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) AS l FROM documents)
      WHERE length(l) >= {line} GROUP BY doc_id, l) GROUP BY doc_id) USING (doc_id)"""


@query("filter_clean_text", CLEAN_SQL.format(least=200, most=200000, line=80, times=4, more=""))
def clean_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.clean_text(F.col("text")).alias("ok"))


@query("filter_clean_article", CLEAN_SQL.format(least=100, most=50000, line=50, times=3, more="OR low LIKE '%ã%' OR low LIKE '%â%'"))
def clean_article(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.clean_article(F.col("text")).alias("ok"))


@query(
    "filter_scored_code",
    r"""
SELECT doc_id, CASE
    WHEN trim(text) = '' THEN 'empty_content'
    WHEN repo = '' THEN 'missing_provenance'
    WHEN NOT regexp_full_match(uuid, '[0-9a-f]{32}') THEN 'invalid_source_scores_or_uuid'
    WHEN NOT (rel BETWEEN 0 AND 1) OR NOT (qual BETWEEN 0 AND 10) THEN 'invalid_score_range'
    WHEN category = 'EXCLUDE' OR qual < 3 THEN 'upstream_quality_gate'
    WHEN contains(text, chr(65533)) THEN 'invalid_encoding'
    WHEN contains(lower(text[1:500]), '<html') AND contains(lower(text[-1000:]), '</html>') THEN 'html_in_code' END AS reason
FROM (SELECT doc_id, text, CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS repo, CASE WHEN doc_id % 19 = 0 THEN 'x' ELSE md5(text) END AS uuid,
             doc_id % 23 / 20.0 AS rel, CAST(doc_id % 12 AS DOUBLE) AS qual, CASE WHEN doc_id % 29 = 0 THEN 'EXCLUDE' ELSE 'keep' END AS category FROM documents)""",
)
def scored_code(spark, sf):
    d = read(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        P.scored_code_reason(
            F.col("text"),
            F.when(i % 19 == 0, "x").otherwise(F.md5("text")),
            F.when(i % 17 == 0, "").otherwise(F.col("source")),
            F.col("source"),
            i % 23 / 20.0,
            (i % 12).cast("double"),
            F.when(i % 29 == 0, "EXCLUDE").otherwise("keep"),
        ).alias("reason"),
    )


@query(
    "filter_credentials",
    r"""
SELECT doc_id, regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----') OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_-]+'),
    lambda r: regexp_full_match(r, 'sk-[A-Za-z0-9_-]{24,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}') AND len(list_distinct(string_split(r, ''))) >= 12)) > 0 AS found
FROM documents""",
)
def credentials(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.credential(F.col("text")).alias("found"))


@query(
    "filter_license",
    r"""
SELECT doc_id, CASE WHEN contains(l, 'public domain') THEN 'Public Domain'
    WHEN contains(l, 'cc0') OR contains(l, 'publicdomain/zero') OR contains(l, 'zero/1.0') THEN 'CC0'
    WHEN contains(l, 'attribution share-alike') OR contains(l, '/by-sa/') THEN 'CC BY-SA'
    WHEN contains(l, 'creative commons - attribution') OR contains(l, '/licenses/by/') THEN 'CC BY' END AS license
FROM (SELECT doc_id, lower(text) AS l FROM documents)""",
)
def license_of(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.license_of(F.col("text")).alias("license"))


@query(
    "filter_difficulty",
    "SELECT p_partkey, p_size * 60 <= 1200 OR p_size = 1 AS easy, p_size * 60 <= 1600 OR p_size = 1 AS eligible FROM part",
)
def difficulty(spark, sf):
    label = F.when(F.col("p_size") == 1, "Easy ").otherwise((F.col("p_size") * 60).cast("string"))
    return read(spark, sf, "part").select("p_partkey", P.easy(label).alias("easy"), P.eligible(label).alias("eligible"))


@query(
    "filter_dull_text",
    r"""
SELECT doc_id, trim(text) = '' OR contains(text, chr(65533)) OR (len(w) >= 60 AND len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) / (len(w) - 4) < 0.82) AS bad
FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[A-Za-z\x{3400}-\x{9fff}]+') AS w FROM documents)""",
)
def dull_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.bad_visible_text(F.col("text")).alias("bad"))


@query(
    "filter_topic",
    r"""
SELECT doc_id, regexp_matches(l, '(^|[^a-z0-9])(casino|lottery)($|[^a-z0-9])') OR len(list_distinct(list_filter(regexp_extract_all(l, '[a-z0-9]+'), lambda x: x IN ('the', 'und', 'les')))) >= 2 AS hit
FROM (SELECT doc_id, lower(text) AS l FROM documents)""",
)
def topic(spark, sf):
    return read(spark, sf, "documents").select("doc_id", P.topic_rows(F.col("text"), ["casino", "lottery"], ["the", "und", "les"]).alias("hit"))


@query("filter_max_tokens", f"SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 200 OR len({WORDS_SQL.format('text')}) + 2 <= 200")
def max_tokens(spark, sf):
    d = read(spark, sf, "documents")
    return d.where(P.within_tokens(F.col("text"), 200, F.size(T.words(F.col("text"))) + 2)).select("doc_id")


@query(
    "filter_code_record",
    r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR length(trim(text)) < 40 THEN 'missing_or_short_task'
  WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR contains(text, '<|endoftext|>') THEN 'embedded_control_token' END AS reason FROM documents""",
)
def code_record(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select("doc_id", P.code_record_reason(F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(t), t, t, t, t).alias("reason"))


LADDER_SQL = f"""
WITH q AS ({CLEAN_SQL.format(least=200, most=200000, line=80, times=4, more='')}),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY doc_id) > 1 AS dup FROM documents JOIN q USING (doc_id) WHERE ok),
b AS (SELECT DISTINCT array_to_string(w[i:i + 12], chr(31)) AS g FROM (SELECT w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {WORDS_SQL.format('text')} AS w FROM benchmark) WHERE len(w) >= 13)),
o AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i:i + 12], chr(31)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT doc_id, {WORDS_SQL.format('text')} AS w FROM documents) WHERE len(w) >= 13)) JOIN b USING (g))
SELECT doc_id, CASE WHEN NOT ok THEN 'text_quality' WHEN dup THEN 'duplicate_text' WHEN o.doc_id IS NOT NULL THEN 'benchmark_overlap' ELSE 'keep' END AS outcome
FROM q LEFT JOIN k USING (doc_id) LEFT JOIN o USING (doc_id)"""


def reason_ladder(docs, bench):
    """outcome of every document: text_quality, then duplicate_text, benchmark_overlap, or keep."""
    return R.screened(docs, bench).select("doc_id", "outcome")


@query("build_reason_ladder", LADDER_SQL)
def build_reason_ladder(spark, sf):
    return reason_ladder(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("report_reasons", f"SELECT source, outcome, count(*) AS n FROM ({LADDER_SQL}) JOIN documents USING (doc_id) GROUP BY source, outcome")
def report_reasons(spark, sf):
    out = build_reason_ladder(spark, sf).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return out.groupBy("source", "outcome").agg(F.count("*").alias("n"))
