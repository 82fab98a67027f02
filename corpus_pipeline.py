"""A corpus pipeline: quality rules, shared lines, near-duplicates, benchmark leaks, token ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, cascade, lines, simhash, spaced
from lacuna.llm.queries import TOKENIZER
from lacuna.llm.text import share_package
from lacuna.session import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, the two base rules included."""
    share_package(spark)
    return cascade.keep_good(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text."""
    return lines.drop_shared_lines(docs.select(*COLUMNS)).withColumn(
        "n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; a document without an id stays.

    Rows that repeat an id are told apart by their texts: a text goes only if it is itself the copy of an earlier document.
    """
    share_package(spark)
    last = (1 << 63) - 1
    named = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("n"),
                     F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    found = simhash.near_duplicates(docs.select(named.alias("name"), "text"), "name")
    lost = found.where(f"id <> component_id AND id.n < {last}L").select(
        F.col("id.n").alias("_lost"), F.col("id.h").alias("_text")).distinct()
    lost = Scratch(spark, "near").write(lost, "lost")
    return docs.select(*COLUMNS).join(
        lost, (F.col("doc_id") == F.col("_lost")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_text")), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    share_package(spark)
    return spaced.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    share_package(spark)
    return bpe.encode(docs.select(*COLUMNS), bpe.read_tokenizer(TOKENIZER)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("tokens", tokens)]

#: SimHash, spaced seeds and BPE are not to be said in SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
