"""The registered queries of this package: thin callers of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import (
    embedding,
    hard_negatives,
    language,
    licences,
    line_dedup,
    merkle,
    minhash,
    mixing,
    packing,
    pieces,
    quality_knn,
    quality_rules,
    toxicity,
)
from riskloom.llm.tables import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grades(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licences.document_paths(table(spark, sf_dir, "documents"))
    return licences.scan_files(files, opening_declares=True)  # documents have no licence files


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.vocabulary_for(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predictions(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_knn": op2_quality_knn,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_minhash": op5_minhash,
    "op6_licences": op6_licences,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_minhash": minhash.ORACLE_SQL,
    "op7_embedding_dedup": embedding.ORACLE_SQL,
    "op12_merkle": merkle.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
