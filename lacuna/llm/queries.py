"""The registered queries of the operators, and SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm import (bpe, cascade, chat, crf, lexical, licenses, lines, manifest, merkle, packing, simhash, spaced,
                        windows)
from lacuna.llm.sql import SQL
from lacuna.llm.text import share_package

#: The tokenizer files; the folder can be set for machines that keep it elsewhere.
FOLDER = os.environ.get("LACUNA_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = os.path.join(FOLDER, "word_bpe_49k.json")
BYTE_TOKENIZER = os.path.join(FOLDER, "byte_bpe_50k.json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of an archive of ``pages`` in files of 1,000 record numbers, the second with planted faults.

    A record is its URL, a newline and the page. Records lie one behind the other in the order of page_id. The
    second replica has one byte of every 97th record replaced, lacks every 211th and has one more behind the end of
    each file.
    """
    record = F.concat_ws("\n", "url", "html")
    rows = pages.where("page_id IS NOT NULL").select(
        "page_id", F.concat(F.lit("warc-"), F.floor(F.col("page_id") / 1000)).alias("file"), record.alias("payload"))
    sized = rows.withColumn("size", F.octet_length("payload").cast("long"))
    order = Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    first = sized.withColumn("at", F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long"))
    faulty = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.expr("substring(payload, 2)"))).otherwise(
        F.col("payload"))
    second = first.where("page_id % 211 <> 17").select("file", "at", faulty.alias("payload"))
    tails = first.groupBy("file").agg((F.max(F.col("at") + F.col("size"))).alias("at")).select(
        "file", "at", F.concat(F.lit("tail of "), "file").alias("payload"))
    return first.select("file", "at", "payload"), second.union(tails)


def op1_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.audit(*replicas(table(spark, folder, "pages")))
    # A side that lacks the record has size -1 and an empty digest.
    return found.select("file", "at", "kind", *[F.coalesce(f"size_{x}", F.lit(-1)).alias(f"size_{x}") for x in "ab"],
                        *[F.coalesce(f"digest_{x}", F.lit("")).alias(f"digest_{x}") for x in "ab"])


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def op3_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    found = spaced.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_passages"), F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"),
        F.sum("equal_words").alias("equal_words"), F.max("n_words").alias("item_words"))


def op4_pii_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = crf.spans(docs, crf.fit(docs))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = F.array(*[F.lit(k) for k in crf.KINDS])
    both = F.transform(F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"),
        s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in crf.KINDS],
                        F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(both).alias("spans"))


def op5_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    read = chat.read_back(chat.prefix_examples(turns.union(more)))
    whole = F.array_join("losses", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.char_length(whole).cast("long").alias("loss_chars"), F.sha2(whole, 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"))


def op6_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    found = cascade.judge(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept")


def op7_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.passages(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op8_license_digests(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"), licenses.catalogue(spark))
    return found.select(F.col("id").alias("doc_id"), "text_digest", "license",
                        F.array_join("line_licenses", ",").alias("line_licenses"), "n_license_lines")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_shared_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    source = bpe.read_tokenizer(TOKENIZER)
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), source).select("doc_id", "ids")
    return bpe.decode(coded, source).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.cut(table(spark, folder, "documents"), bpe.read_tokenizer(BYTE_TOKENIZER))
    told = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign(told)


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = manifest.build(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=changed, current={"text": lowered})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {f.__name__: f for f in (
    op1_merkle_fixity, op2_simhash, op3_spaced_seeds, op4_pii_crf, op5_prefix_targets, op6_quality_cascade,
    op7_compact_windows, op8_license_digests, op9_line_dedup, op10_word_bpe, op11_bestfit_packing, op12_lexical_search,
    op13_merkle_manifest)}

ORACLES = dict(SQL)
