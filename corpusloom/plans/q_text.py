"""Text and hash function queries."""

from pyspark.sql import functions as F

from corpusloom.functions import hashing as H
from corpusloom.functions import text as T
from corpusloom.plans.q_filters import WORDS_SQL
from corpusloom.plans.registry import query, read


@query(
    "text_measures",
    r"""
SELECT doc_id, length(trim(text)) AS n_strip, len(string_split(text, chr(10))) AS n_lines, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_collapsed,
       octet_length(encode(text)) AS n_bytes FROM documents""",
)
def text_measures(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id", F.char_length(T.strip(t)).cast("long").alias("n_strip"), F.size(T.lines(t)).cast("long").alias("n_lines"),
        F.char_length(T.collapse(t)).cast("long").alias("n_collapsed"), F.octet_length(t).cast("long").alias("n_bytes"),
    )


@query("text_words", f"SELECT doc_id, len({WORDS_SQL.format('text')}) AS n_words, md5(array_to_string({WORDS_SQL.format('text')}, ' ')) AS words_md5 FROM documents")
def text_words(spark, sf):
    w = T.words(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@query(
    "text_keys",
    f"""
SELECT doc_id, sha256(text) AS raw, sha256(trim(text, ' ' || chr(10))) AS stripped, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed,
       sha256(array_to_string({WORDS_SQL.format('text')}, ' ')) AS by_words, sha256(trim(text, ' ' || chr(10)) || chr(31) || source) AS composite FROM documents""",
)
def text_keys(spark, sf):
    t = F.col("text")
    return read(spark, sf, "documents").select(
        "doc_id", H.text_key(t).alias("raw"), H.stripped_key(t).alias("stripped"), H.collapsed_key(t).alias("collapsed"), H.words_key(t).alias("by_words"),
        H.composite_key(t, F.col("source")).alias("composite"),
    )


@query(
    "text_final_number",
    r"""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 4 = 1 THEN CAST(doc_id * 1000 AS VARCHAR) END AS answer FROM documents""",
)
def text_final_number(spark, sf):
    i = F.col("doc_id").cast("string")
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("so 3\n#### 5\n #### "), i))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("<think>#### 1</think>\n#### "), F.when(i == "0", "0").otherwise(F.concat(i, F.lit("000")))))
        .when(F.col("doc_id") % 4 == 2, F.lit("#### 7\n#### seven"))
        .otherwise(F.concat(F.lit("<think>\n#### "), i))
    )
    return read(spark, sf, "documents").select("doc_id", T.final_number(text).cast("long").cast("string").alias("answer"))


@query(
    "text_sections",
    r"""
SELECT doc_id, regexp_extract(text, '[^\n]+') AS first_line, text[1:20] AS head, strpos(lower(text), 'the') AS at,
       len(regexp_extract_all(lower(text), 'th')) AS n_hard, len(regexp_extract_all(regexp_replace(lower(text), 'th', '', 'g'), 'e')) AS n_weak FROM documents""",
)
def text_sections(spark, sf):
    t = F.col("text")
    hard, weak = T.count_terms(t, "th", "e")
    return read(spark, sf, "documents").select(
        "doc_id", F.regexp_substr(t, F.lit("[^\n]+")).alias("first_line"), F.substring(t, 1, 20).alias("head"), F.instr(F.lower(t), "the").cast("long").alias("at"),
        hard.cast("long").alias("n_hard"), weak.cast("long").alias("n_weak"),
    )
