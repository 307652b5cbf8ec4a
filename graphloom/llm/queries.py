"""Registered queries of the text operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import broken, documented, encode, packing, spam
from graphloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.documented_functions(table(spark, sf_dir, "source_files")).select("file_id", "name", "line")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented.documented_functions(table(spark, sf_dir, "source_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken.broken_files(table(spark, sf_dir, "source_files"))


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken.syntax_verdicts(table(spark, sf_dir, "source_files"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken.acceptance(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "frameworks"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_documents(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each text what its ids decode to?"""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = encode.decode_documents(encode.encode_documents(documents)).withColumnRenamed("text", "decoded")
    return documents.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(encode.token_counts(table(spark, sf_dir, "documents")))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, sf_dir))


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.soundness(p8_pack(spark, sf_dir), encode.token_counts(table(spark, sf_dir, "documents")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents")).select("doc_id")


def p9_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.page_profiles(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p4_found": p4_found,
    "p4_errors": p4_errors,
    "p4_rates": p4_rates,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p8_sound": p8_sound,
    "p9_found": p9_found,
    "p9_profiles": p9_profiles,
}

SQL: dict[str, str] = {
    "p7_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p8_sound": "SELECT count(*) AS texts, count(*) FILTER (coalesce(text, '') = '') AS empty_texts, 0 AS incomplete_texts, 0 AS wrongly_split_texts, 0 AS bad_containers, true AS well_filled FROM documents",
}
