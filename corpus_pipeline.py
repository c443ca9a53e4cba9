"""The corpus pipeline: five stages from raw documents to sampled token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet to
the shared staging folder and reads it back as the next stage's ``docs``. All stages but the last
return the columns of ``documents``; further columns of any names pass through them.

Edge cases: documents without text or words score 0 and go with the first stage; texts of any length are
read whole; of rows of equal id and text the third stage keeps one, of differing texts of one id each that
nothing resembles; rows of a null id pass all stages; ties go to the smallest id (near duplicates) or by
hash (mixing); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import line_dedup, minhash, mixing, pieces, quality_knn
from riskloom.llm.tables import table
from riskloom.operators.staging import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that a later document repeats."""
    return line_dedup.dedup_lines(docs)


def unique_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return minhash.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix draws it (up to twice), dealt to shards."""
    return mixing.mix(docs)


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: doc_id, pieces, n_pieces, lossless."""
    return pieces.encode(docs, pieces.vocabulary_for(spark))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unique_lines),
    ("near-duplicate removal", unique_documents),
    ("mixing sources to target weights", mixed_sources),
    ("sampled pieces", sampled_pieces),
]

ORACLE_SQL = None  # models, signatures and sampling: tests/llm compares every stage with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
