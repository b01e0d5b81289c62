"""The knowledge base as one store: documents, their chunks and the search index change together, in one published version."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corvidex.operators import constraints, segments
from corvidex.operators.store import last_of_each
from corvidex.sources.versions import Table, Version, Versions


def open_library(spark: SparkSession, root: str, buckets: int = 64) -> Versions:
    return Versions(spark, root, {
        "documents": Table("document_id", buckets, ("document_id", "source_sha256")),
        "chunks": Table("document_id", buckets, ("chunk_id",)),
    })


def put(library: Versions, documents: DataFrame, chunks: DataFrame, batch: tuple[str, int] | None = None, order: str | None = None) -> Version:
    """Publish ``documents`` and ``chunks``: their documents are replaced or added, with all of their chunks and index entries.

    Of several rows of a document, that with the greatest ``order`` counts, if it
    is named. ``batch`` (stream, number) marks the version: a batch that a version
    already holds changes nothing, so a repeated one is harmless. Chunks are
    numbered from 0 in the order of ``chunk_no``. What breaks a rule of
    ``constraints.LIBRARY`` is refused as a whole (``Violation``); rules are
    judged on what is written already, so that texts are dealt once.
    """
    before = library.latest()
    if batch and before.batches.get(batch[0], -1) >= batch[1]:
        return before
    documents = documents if order is None else last_of_each(documents, ["document_id"], order).drop(order)
    number = F.row_number().over(Window.partitionBy(library.by_key("chunks")).orderBy("chunk_no")) - 1
    chunks = library.dealt("chunks", chunks).withColumn("chunk_no", number.cast(chunks.schema["chunk_no"].dataType))
    return _publish(library, before, documents, chunks, documents.select("document_id"), batch)


def remove(library: Versions, ids: DataFrame, batch: tuple[str, int] | None = None) -> Version:
    """Publish a version without the documents ``ids`` (document_id), their chunks and index entries; ids that aren't there change nothing."""
    before = library.latest()
    if not before.tables or batch and before.batches.get(batch[0], -1) >= batch[1]:
        return before
    ids = library.read("documents", before).select("document_id").join(ids.select("document_id").distinct(), "document_id", "left_semi")
    if ids.isEmpty():
        return before
    none = [library.read(name, before).limit(0) for name in ("documents", "chunks")]
    return _publish(library, before, *none, ids, batch)


def _publish(library: Versions, before: Version, documents: DataFrame, chunks: DataFrame, ids: DataFrame, batch: tuple[str, int] | None) -> Version:
    after = library.change(before, "documents", documents, ids)
    after = library.change(after, "chunks", chunks, ids)
    fresh = {name: library.fresh(name, after) for name in ("documents", "chunks")}
    constraints.require(fresh, constraints.LIBRARY)
    after = segments.change(library, after, fresh["chunks"], ids, folders=after.fresh["chunks"])
    if batch:
        after = replace(after, batches={**after.batches, batch[0]: batch[1]})
    return library.publish(after)


def find(library: Versions, ids: list, name: str = "documents") -> DataFrame:
    """Rows of a few documents, from the buckets of their ids."""
    return library.read(name, keys=ids)


def find_by_hash(library: Versions, source_sha256: str) -> DataFrame:
    """Documents of a text's hash; row groups whose Bloom filter doesn't know it aren't read."""
    return library.read("documents").where(F.col("source_sha256") == source_sha256)
