"""Listings and statistics over documents and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvidex.functions import text as tx


def top_sections(chunks: DataFrame) -> DataFrame:
    """(document_id, sections): distinct top sections in order of first appearance, meta chunks left out."""
    named = chunks.where("kind <> 'meta' AND section_path IS NOT NULL").select("document_id", "chunk_no", tx.top_section(F.col("section_path")).alias("section"))
    first = named.groupBy("document_id", "section").agg(F.min("chunk_no").alias("at"))
    return first.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "section"))), lambda x: x["section"]).alias("sections"))


def by_recency(documents: DataFrame, limit: int, category: str | None = None) -> DataFrame:
    """The documents stored last; of a category, if it is named."""
    documents = documents if category is None else documents.where(F.col("category") == category)
    return documents.orderBy(F.desc("indexed_at"), F.desc("document_id")).limit(limit)


def list_docs(documents: DataFrame, chunks: DataFrame, limit: int, from_date: str | None = None) -> DataFrame:
    """The newest ``limit`` documents by date with their top sections; those without sections stay."""
    documents = documents if from_date is None else documents.where(F.col("document_date") >= from_date)
    newest = documents.orderBy(F.desc("document_date"), F.asc("document_id")).limit(limit).select("document_id", "document_date", "category")
    held = chunks.join(newest.select("document_id"), "document_id", "left_semi")
    return newest.join(top_sections(held), "document_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))


def document_chunks(chunks: DataFrame, document_id: object | None, limit: int, include_meta: bool = False) -> DataFrame:
    """The first ``limit`` chunks of a document; of each document, if none is named."""
    own = chunks if document_id is None else chunks.where(F.col("document_id") == document_id)
    own = own if include_meta else own.where("kind <> 'meta'")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_no"))
    return own.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


def category_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("category").agg(F.count("*").alias("n"))


def chunk_statistics(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    joined = chunks.select("document_id", F.length("text").alias("n")).join(documents.select("document_id", "category"), "document_id")
    return joined.groupBy("category").agg(F.count("*").alias("n_chunks"), F.round(F.avg("n"), 4).alias("avg_chars"), F.min("n").cast("long").alias("min_chars"), F.max("n").cast("long").alias("max_chars"))


def recency_chunks(documents: DataFrame, chunks: DataFrame, cutoff: str, fetch: int, max_docs: int, per_doc: int) -> DataFrame:
    """First chunks of recently dated documents: the latest ``fetch`` are taken first, and the date cuts after that.

    Adds ``doc_pos`` and ``in_doc``, both from 1.
    """
    fetched = by_recency(documents, fetch)
    order = Window.orderBy(F.desc("indexed_at"), F.desc("document_id"))  # over at most ``fetch`` rows
    recent = fetched.where(F.col("document_date") >= cutoff).withColumn("doc_pos", F.row_number().over(order)).where(F.col("doc_pos") <= max_docs)
    about = recent.select("document_id", "source_path", "category", "document_date", "doc_pos")
    held = chunks.where("kind <> 'meta'").join(F.broadcast(about), "document_id")
    return held.withColumn("in_doc", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_no"))).where(F.col("in_doc") <= per_doc)


def find_by_hash(documents: DataFrame, sha256: str) -> DataFrame:
    return documents.where(F.col("source_sha256") == sha256).orderBy("document_id").limit(1)


def section_filter(chunks: DataFrame, document_id: object | None, sections: list[str]) -> DataFrame:
    """A document's chunks, or all chunks, whose top section, in lower case, is among ``sections``; those without a section go."""
    own = chunks if document_id is None else chunks.where(F.col("document_id") == document_id)
    return own.where(F.lower(tx.top_section(F.col("section_path"))).isin([s.lower() for s in sections]))
