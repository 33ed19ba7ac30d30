"""The corpus pipeline: five stages over the documents, each written as Parquet and read again as the next one's input.

Stages 1 to 4 return the columns of documents. Language ID drops what is in none of the known languages; near-dedup
keeps one document of each group; decontamination cuts benchmark passages out of texts; mixing sets the order of rows
(files by part number, rows within files); the token store writes the ids in that order.

SQL cannot express the stages (SimHash, a trained language model, earliest-deadline-first slots, a tokenizer), so
there is none; tests/llm/test_whole.py holds run() against brute force, given the documents that language ID accepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, mixing, simhash, tokenstore
from tidemark.llm.common import fresh_path, table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay."""
    return langid.identify(docs).where("accepted_").select("row_.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in the order of the mix."""
    return mixing.in_mixed_order(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of docs in the order of their files and rows; its rows as read back."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)
    order = (F.when(part != "", part).otherwise("0").cast("long"), F.col("_metadata.row_index"))
    return tokenstore.token_store(docs, tokenstore.default_tokenizer(), order=order)[1]


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_store", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
