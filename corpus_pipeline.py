"""From raw documents to packed training windows: quality rules, near-dedup, masking, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
all but the last return the columns of documents. Empty input gives an empty result of the
last stage's columns. Null and empty texts are rejected in the first stage; rows without a
doc_id pass the second; of rows with one doc_id the one of the least text stays; of a group
of near copies the document with the least doc_id stays. Texts of any length are read whole,
and further columns pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import packing, pii, quality, simhash_dedup
from vellum.llm.common import checkpointed, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup.drop_near_duplicates(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind in brackets."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows that the documents' pieces go into."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", keep_good), ("simhash near-dedup", drop_copies), ("pii", mask_pii), ("best-fit packing", pack)]

#: The fertility, fingerprint and packing stages have no SQL form; tests/llm holds the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written to the shared folder and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
