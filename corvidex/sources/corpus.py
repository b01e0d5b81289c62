"""Sources and sinks: Markdown files, the driver's tables seen as documents, chunks and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvidex.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, raw_content) of every ``*.md`` file below ``path``, read whole and in parallel."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(tx.safe_filename(F.col("_metadata.file_name")).alias("source_path"), F.col("value").alias("raw_content"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as knowledge-base documents: lang is the category; dates are formulas of the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("document_id"),
        F.col("source").alias("source_path"),
        F.col("lang").alias("category"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("document_date"),
        F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), ((F.col("doc_id") * 7) % 365).cast("int")), "yyyy-MM-dd").alias("indexed_at"),
        F.sha2("text", 256).alias("source_sha256"),
        F.col("text").alias("raw_text"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each non-blank line of a document; every seventh line stands for an administrative section."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("chunk_no", "text")).where(F.trim("text") != "")
    return lines.select(
        F.col("doc_id").alias("document_id"),
        "chunk_no",
        F.when(F.col("chunk_no") % 7 == 3, "meta").when(F.col("chunk_no") % 7 == 5, "fact").otherwise("section").alias("kind"),
        "text",
        F.when(F.col("chunk_no") % 5 != 4, F.concat("source", F.lit(" > part "), (F.col("chunk_no") % 3).cast("string"))).alias("section_path"),
        F.when(F.col("chunk_no") % 5 != 4, F.concat(F.lit("part "), (F.col("chunk_no") % 3).cast("string"))).alias("heading"),
        F.col("lang").alias("tags_text"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's conversations as stored messages, seq from 1 in each session; every fifth assistant row calls a tool."""
    c = table(spark, sf_dir, "conversations")
    calls = F.concat(F.lit('[{"id":"c'), F.col("turn").cast("string"), F.lit('","name":"kb.search_chunks","arguments":{}}]'))
    return c.select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("seq"),
        "role",
        F.col("text").alias("content"),
        F.when((F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 5 == 0), calls).alias("tool_calls_json"),
    )
