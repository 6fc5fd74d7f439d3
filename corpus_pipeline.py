"""Documents to packed training windows: quality rules, near-dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import neardup, packing, pii, quality
from skerry.llm.text import stored
from skerry.operators.joins import skew_safe_join


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep."""
    return quality.judged(docs).where("kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 4) -> DataFrame:
    """One document of each group of near-duplicates, by sets of `width` words: of rows that repeat
    its doc_id, one as well. Documents without words are all kept, as are those without a doc_id."""
    found = neardup.near_duplicates(docs, width)
    kept = found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    ones = skew_safe_join(docs.where("doc_id IS NOT NULL"), kept, ["doc_id"], "left_semi").dropDuplicates(["doc_id"])
    return ones.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """keep_one_of_each() by sets of five words; four are for op2 alone."""
    return keep_one_of_each(spark, docs, sf_dir, width=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their personal data replaced by its kind."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of equal size, with their ids."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_good), ("near_dedup", near_dedup), ("personal_data", mask_personal_data), ("packing", pack)]
#: Near-duplicates, spans and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
