"""Segments of a written search index: a change writes its own postings, and segments merge as they grow.

A segment holds the postings of some documents, each file sorted by term and of few
documents, as a text is far smaller than its places; the lengths of their chunks, the distinct terms, and the ids of documents that older segments no
longer count for. A new segment takes in those before it while they aren't
``fanout`` times its size, so sizes fall from the oldest to the newest by that
factor, their number grows with the logarithm of the index, and a row is
rewritten as often. A document weighs as much as ``places`` ids: a removal, which
has ids alone, rewrites no places until much is gone. When more than ``dead`` of all documents have been replaced,
all segments become one. A reader leaves out replaced documents by one anti-join
with the ids of all segments, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from corvidex.operators import search as s
from corvidex.sources.versions import SENT, Version, Versions

SHARE = 6e6  # bytes of files whose places are sorted in one task: some 50 times as many in memory
_PARTS = ("postings", "lengths")


@dataclass(frozen=True)
class SegmentParams:
    fanout: int = 4
    dead: float = 0.3
    places: int = 100


def _schema(part: str, id_type: str) -> str:
    return {
        "postings": f"document_id {id_type}, chunk_no int, n_terms long, col string, pos int, term string",
        "lengths": f"document_id {id_type}, chunk_no int, n_terms long",
        "terms": "term string",
        "gone": f"document_id {id_type}",
    }[part]


def _read(store: Versions, segments: Sequence[dict], part: str) -> DataFrame:
    each = [store.spark.read.schema(_schema(part, g["id_type"])).parquet(f"{store.root}/{g['folder']}/{part}").withColumn("segment", F.lit(i)) for i, g in enumerate(segments)]
    return reduce(DataFrame.unionByName, each)


def _live(store: Versions, segments: Sequence[dict], part: str) -> DataFrame:
    """Rows of the segments whose document no later one of them replaces."""
    rows = _read(store, segments, part)
    if any(g["n_gone"] for g in segments[1:]):
        gone = _read(store, segments, "gone").select(F.col("document_id").alias("gone_id"), F.col("segment").alias("last"))
        gone = F.broadcast(gone) if sum(g["n_gone"] for g in segments) <= SENT else gone
        rows = rows.join(gone, (F.col("document_id") == F.col("gone_id")) & (F.col("segment") < F.col("last")), "left_anti")
    return rows.drop("segment")


def merged(segments: Sequence[dict], n_documents: int, n_gone: int, params: SegmentParams) -> int:
    """How many of the newest segments a new one takes in that has so many documents, and replaces so many."""
    if n_gone + sum(g["n_gone"] for g in segments) > params.dead * (n_documents + sum(g["n_documents"] for g in segments)):
        return len(segments)
    size, n = params.places * n_documents + n_gone, 0
    for g in reversed(segments):
        weight = params.places * g["n_documents"] + g["n_gone"]
        if weight >= params.fanout * size:
            break
        size, n = size + weight, n + 1
    return n


def _dealt(store: Versions, rows: DataFrame, folders: Sequence[str]) -> DataFrame:
    """``rows``, read from the folders, dealt by document into so many partitions that their places are sorted in memory."""
    return rows.repartition(max(1, ceil(store.size(folders) / SHARE)), "document_id")


def change(store: Versions, version: Version, chunks: DataFrame, ids: DataFrame, params: SegmentParams = SegmentParams(), folders: Sequence[str] = ()) -> Version:
    """``version`` with the documents ``ids`` replaced in the index by ``chunks``, all of them of these documents: written, not published.

    ``chunks`` that were read from ``folders`` are dealt first, before they become
    places; a partition becomes one file of postings.
    """
    ids = ids.select("document_id").distinct()
    chunks = chunks.withColumn("chunk_no", F.col("chunk_no").cast("int"))
    n_ids = ids.count()
    n = merged(version.segments, 0 if chunks.isEmpty() else n_ids, n_ids if version.segments else 0, params)
    kept, taken = list(version.segments[: len(version.segments) - n]), list(version.segments[len(version.segments) - n :])
    parts = {"postings": s.postings(_dealt(store, chunks, folders) if folders else chunks), "lengths": s.lengths(chunks)}
    gone = ids
    if taken:
        replaced = F.broadcast(ids) if n_ids <= SENT else ids
        for part in _PARTS:
            old = _live(store, taken, part).join(replaced, "document_id", "left_anti")
            parts[part] = _dealt(store, old, [f"{g['folder']}/{part}" for g in taken]).unionByName(parts[part])
        gone = gone.union(_read(store, taken, "gone").select("document_id")).distinct()
    if not kept:
        gone = gone.limit(0)
    folder = store.folder("index")
    s.write_parts(parts["postings"], parts["lengths"], folder)
    gone.write.parquet(f"{folder}/gone")
    about = {"folder": folder.removeprefix(store.root + "/"), "id_type": dict(ids.dtypes)["document_id"]}
    n_documents = _read(store, [about], "lengths").select("document_id").distinct().count()
    n_gone = _read(store, [about], "gone").count() if kept else 0
    return Version(version.number, version.tables, [*kept, about | {"n_documents": n_documents, "n_gone": n_gone}], version.batches)


def read_index(store: Versions, version: Version | None = None) -> s.Index:
    """The index of a version (the latest)."""
    version = version or store.latest()
    if not version.segments:
        raise KeyError(f"no index in version {version.number}")
    lengths = _live(store, version.segments, "lengths")
    terms = _read(store, version.segments, "terms").drop("segment")  # those of replaced documents too: they meet no postings
    return s.Index(_live(store, version.segments, "postings"), lengths, s.corpus(lengths), terms)
