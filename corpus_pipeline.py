"""From documents to packed sequences: the stages, and a run of all of them.

Each stage works on everything its predecessor kept. All but the last return the columns of the
documents they are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, exact_dedup, language_id, near_dup, packing
from corpusloom.llm.shared import drop_stored, stored, stored_count, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; rejected are those without letters, so null and empty texts too.

    Where no row has a language, none can be learned, and all documents with letters stay. Repeated
    rows fare alike, no rows give no rows, and further columns are kept whatever their names.
    """
    model = language_id.learn(docs.where(~language_id.held_out()))
    if not model.families:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = docs.select(F.struct("*").alias("doc"), language_id.language_of(spark, model, F.col("text")).alias("found"))
    return found.where(F.col("found.lang_pred") != language_id.UNKNOWN).select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the least id (null last).

    Null texts count as empty; of rows equal in id and text one stays; no rows give no rows.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the least id (null last).

    Null texts count as empty, and those are one class; of rows equal in id and text one stays; no
    rows give no rows.
    """
    return near_dup.drop_near(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark text.

    The text decides, whatever the id; null and empty texts stay; no rows give no rows.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents with their places in sequences.

    Null and empty texts are an end id; rows that repeat an id are packed apart; no rows give no rows.
    """
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language), ("exact", exact), ("near", near), ("contamination", contamination), ("packed", packed)]

#: Language and near-duplicate stages, and the packing, are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = stored_count()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            drop_stored(spark, since=mark, but=docs)
    return docs
