"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, encoding.

Every stage gets the documents that its predecessor kept, as written to Parquet, and its decisions
take effect: rejected documents and further copies go, repeated sentences and benchmark
passages leave the texts (n_chars follows), and the last stage adds the token ids.

Defined cases, in every stage: null and blank texts fail the quality rules, and stay what they are in the other stages; null
ids, languages and sources are values; rows that agree in doc_id and text are one document (the second stage keeps one
row of it); texts of any length are taken whole; an empty table stays empty; further columns, whatever their names, are
passed on by all but n_ids, ids_crc32, same and ids, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chesslake.llm.common import materialize, read_table, scratch_path, tokenizer_path
from chesslake.llm.decontamination import decontaminate
from chesslake.llm.near_dedup import near_dedup
from chesslake.llm.quality_rules import keep_good
from chesslake.llm.sentencepiece_codec import encode_texts
from chesslake.llm.substring_dedup import substring_dedup


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of sentences; documents of which nothing is left go.

    The shortened texts are written before they are looked at: a filter on them would be merged into the
    rebuilding of the text and split it into sentences again and again.
    """
    own = {c: f"own {c}" for c in ("n_sentences", "n_removed") if c in docs.columns}
    short = materialize(substring_dedup(docs.withColumnsRenamed(own)), "shortened").where("n_removed = 0 OR trim(text) <> ''")
    return _counted(short.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns)))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    return _counted(decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_ids, ids_crc32, same (decoding gives the text again) and ids."""
    return encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), keep=tuple(docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("sentencepiece", encoded),
]

#: Robust covariances, signatures and merges can't be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
