"""The corpus pipeline: documents become packed training sequences.

Each stage calls one training-data operator, takes the documents its predecessor kept and returns documents, except
the last, which returns the packed pieces with their ids.  A driver may write each stage's result and read it back for
the next.  Every stage takes any table that has the columns of documents, in any order, and more; columns that clash
with an operator's own names are kept, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import linededup, minhash, mixing, packing, quality
from quillon.llm.common import quoted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    A null or empty text is judged as an empty document, a null source or language as a site of its own; repeated rows
    are judged alike, by the posterior of all of them; a posterior of exactly the threshold keeps.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line are taken out of the texts, and documents that lose their last word go.

    Null, empty and blank texts have no lines to lose and stay; null ids come last, each a document of its own; rows
    that share an id and a text are one document and keep or lose the same lines; of equal lines the first stays.
    """
    return linededup.remove_lines(docs, drop_emptied=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least id.

    Documents without words are classes of their own; rows of one id and one text are one document; of texts that share
    an id each is judged for itself; rows without an id all stay.
    """
    return minhash.keep_one(docs, weighted=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training run: documents as often as the mix draws them, in the curriculum's order.

    A null source is a source of its own; documents without words are not drawn; repeated rows are drawn one by one;
    ties of the seeded order fall to equal rows only.  A source's last copy is cut where its target is reached.
    """
    return mixing.training_order(docs).select(*quoted(docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids and their places in training sequences.

    A null or empty text is one piece, its end id; a text longer than a sequence is cut into whole sequences and a rest;
    repeated rows, as the mix draws them, are packed one by one.
    """
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fuzzy joins, hashing orders and subword ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
