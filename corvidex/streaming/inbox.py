"""Ingest of an inbox folder by Structured Streaming: each batch of new files goes through the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corvidex.functions import text as tx
from corvidex.operators import library
from corvidex.operators.ingest import IngestParams, ingest
from corvidex.sources.versions import Versions


def watch(spark: SparkSession, inbox: str, sink: Callable[[int, DataFrame, DataFrame, DataFrame], None], checkpoint: str, indexed_at: str, params: IngestParams = IngestParams(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Start reading ``*.md`` files that arrive in ``inbox``; ``sink`` gets (batch, documents, chunks, rejects).

    The checkpoint names the files already read; a sink that writes by batch
    number is idempotent when a batch is repeated.
    """
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(inbox)
    name, when = tx.safe_filename(F.col("_metadata.file_name")), F.col("_metadata.file_modification_time")
    files = stream.select(name.alias("source_path"), F.col("value").alias("raw_content"), when.alias("uploaded"))

    def batch(df: DataFrame, number: int) -> None:
        sink(number, *ingest(df, indexed_at, params, keep))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into(store: Versions, inbox: str, checkpoint: str, indexed_at: str, params: IngestParams = IngestParams(), rejects: str | None = None) -> StreamingQuery:
    """``watch`` that publishes each batch's documents, chunks and index entries in ``store`` as one version.

    The version names the batch, so a batch that is repeated after a failure, at
    whatever point, is published once. Rejects are written below the folder
    ``rejects``, by batch, if it is named.
    """

    def publish(number: int, documents: DataFrame, chunks: DataFrame, refused: DataFrame) -> None:
        if rejects:
            refused.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        library.put(store, documents, chunks, (inbox, number))

    def keep(df: DataFrame) -> DataFrame:
        folder = store.folder("inbox")  # no version names it, so ``vacuum`` takes it away
        df.write.parquet(folder)
        return store.spark.read.schema(df.schema).parquet(folder)

    return watch(store.spark, inbox, publish, checkpoint, indexed_at, params, keep)
