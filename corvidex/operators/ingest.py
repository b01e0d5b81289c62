"""Ingest as one plan: normalize, control fields, blocks, section paths, chunks, tags; rejects go aside with a code."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvidex.functions import control, fixed, text as tx
from corvidex.operators.segmentation import read_blocks


@dataclass(frozen=True)
class IngestParams:
    categories: Sequence[str] = tuple(fixed.CATEGORIES)
    admin_headings: Sequence[str] = tuple(fixed.ADMIN_HEADINGS)
    max_section_chars: int = 4000


def read_controls(files: DataFrame, params: IngestParams = IngestParams()) -> DataFrame:
    """``files`` (source_path, raw_content) with text, source_sha256, document_id, category, document_date, body and error_code."""
    f = files.withColumn("text", tx.preprocess(F.col("raw_content")))
    f = f.withColumns({"source_sha256": F.sha2("text", 256), "category": control.category(F.col("text"), params.categories), "document_date": control.document_date(F.col("text"), F.col("source_path")), "body": control.body(F.col("text"), params.categories)})
    error = F.when(F.col("category").isNull(), "E_NO_SCHEMA_ID").when(F.col("document_date").isNull(), "E_NO_DOCUMENT_DATE")
    return f.withColumns({"document_id": F.left("source_sha256", F.lit(32)), "error_code": error})


def last_uploads(read: DataFrame) -> DataFrame:
    """Of the files with equal text and no error, the one uploaded last (of the greatest path, where ``uploaded`` isn't known or equal); all others with an error."""
    order = [F.col("error_code").isNotNull(), *([F.desc_nulls_last("uploaded")] if "uploaded" in read.columns else []), F.desc("source_path")]
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    return read.withColumn("__n", n).where("`__n` = 1 OR error_code IS NOT NULL").drop("__n")


def section_paths(blocks: DataFrame) -> DataFrame:
    """Blocks other than headings, with section_path (open headings joined by `` > ``) and the nearest heading.

    A heading closes those of its level and deeper; level k is open where its
    last heading stands behind the last one of each lesser level.
    """
    w = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = blocks
    for k in range(1, 7):
        here = (F.col("type") == "heading") & (F.col("level") == k)
        b = b.withColumns({f"p{k}": F.max(F.when(here, F.col("pos"))).over(w), f"t{k}": F.last(F.when(here, F.col("content")), ignorenulls=True).over(w)})
    open_: list[Column] = []
    for k in range(1, 7):
        above = F.coalesce(F.greatest(*[F.coalesce(f"p{j}", F.lit(-1)) for j in range(1, k)], F.lit(-1), F.lit(-1)), F.lit(-1))
        open_.append(F.when(F.col(f"p{k}") > above, F.col(f"t{k}")))
    heading = F.coalesce(*reversed(open_))
    dropped = [f"{c}{k}" for k in range(1, 7) for c in "pt"]
    return b.withColumns({"section_path": F.concat_ws(" > ", *open_), "heading": heading}).where("type <> 'heading'").drop(*dropped)


def split_long(text: Column, most: int) -> Column:
    """Array of parts: paragraphs between blank lines packed up to ``most`` characters; one long paragraph stays whole."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n", -1), F.trim), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def add(acc: Column, p: Column) -> Column:
        over = (acc["open"] != "") & (acc["size"] + F.length(p) > most)
        fresh = F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), p.alias("open"), F.length(p).alias("size"))
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        more = F.struct(acc["done"].alias("done"), joined.alias("open"), (acc["size"] + F.length(p)).alias("size"))
        return F.when(over, fresh).otherwise(more)

    packed = F.aggregate(paragraphs, empty, add, lambda acc: F.array_append(acc["done"], acc["open"]))
    return F.when((F.length(text) <= most) | (F.size(paragraphs) <= 1), F.array(text)).otherwise(packed)


def chunkify(placed: DataFrame, params: IngestParams = IngestParams(), more: Sequence[str] = ()) -> DataFrame:
    """(document_id, ``more``, chunk_no, kind, text, section_path, heading): one chunk a block; long sections in parts.

    A paragraph that is all bold labels the next chunk; the last of several in
    a row counts; one with nothing behind it is a section of its own.
    """
    admin = F.coalesce(tx.fold(F.trim("heading")).isin(list(params.admin_headings)), F.lit(False))
    by_type = F.when(F.col("type") == "table", "table").when(F.col("type") == "list", "list").when((F.col("type") == "paragraph") & (F.col("subtype") == "fact"), "fact").otherwise("section")
    is_label = F.col("subtype") == "bold_label"
    w = Window.partitionBy("document_id").orderBy("pos")
    b = placed.where(is_label | (F.trim(F.regexp_replace("content", r"\s+", " ")) != ""))
    b = b.withColumns({"label": F.when(F.lag(is_label).over(w), F.lag("content").over(w)), "dangling": is_label & F.lead("pos").over(w).isNull()}).where(~is_label | F.col("dangling"))
    kind = F.when(F.col("dangling"), "section").when(admin, "meta").otherwise(by_type)
    b = b.withColumn("kind", kind)
    parts = F.when((F.col("kind") == "section") & ~F.col("dangling"), split_long(F.col("content"), params.max_section_chars)).otherwise(F.array("content"))
    each = b.select("document_id", *more, "pos", "kind", "section_path", "heading", "label", "dangling", F.posexplode(parts).alias("part", "text")).where(F.trim("text") != "")
    labelled = F.when((F.col("part") == 0) & F.col("label").isNotNull() & ~F.col("dangling"), F.concat("label", F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "part")) - 1
    return each.select("document_id", *more, number.alias("chunk_no"), "kind", labelled.alias("text"), "section_path", "heading")


def tag(chunks: DataFrame) -> DataFrame:
    """``chunks`` (with their document's category) with tags_text and chunk_id."""
    sources = [tx.nfkc(F.col("category")), F.col("kind"), F.col("section_path"), F.col("heading")]
    c = chunks.withColumn("tags_text", tx.tags(sources))
    return c.withColumn("chunk_id", tx.chunk_id(F.col("document_id"), F.col("section_path"), F.col("kind"), F.col("text")))


def tagged_chunks(good: DataFrame, params: IngestParams = IngestParams()) -> DataFrame:
    """Chunks of ``good`` (read controls, each document once) with their file's source_path and category, and whether the document holds equal ones (``doubled``).

    What chunks need of their document goes through the plan with its blocks, and
    all windows are by document, so texts are dealt and parsed once, and their
    blocks dealt once more behind the function for inline text.
    """
    more = ("source_path", "category")
    chunks = tag(chunkify(section_paths(read_blocks(good, *more)), params, more))
    n = F.count("*").over(Window.partitionBy("document_id", "chunk_id"))
    return chunks.withColumn("n", n).withColumn("doubled", F.max(F.col("n") > 1).over(Window.partitionBy("document_id"))).drop("n")


CHUNK = ["document_id", "chunk_no", "kind", "text", "section_path", "heading", "tags_text", "chunk_id"]


def ingest(files: DataFrame, indexed_at: str, params: IngestParams = IngestParams(), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, rejects); of files with equal normalized content the last upload counts.

    Rejects (source_path, error_code): no category, no date, no chunks, or two
    equal chunks in a document. The three share what is read and its chunks;
    ``keep`` may write those two and give them back, so that they are worked out
    once.
    """
    read = keep(last_uploads(read_controls(files, params)))
    good = read.where("error_code IS NULL")
    tagged = keep(tagged_chunks(good, params))
    verdict = tagged.groupBy("document_id").agg(F.max("doubled").alias("doubled"))
    judged = good.join(verdict, "document_id", "left")
    code = F.when(F.col("doubled").isNull(), "E_EMPTY_CHUNKS").when(F.col("doubled"), "E_DUPLICATE_CHUNK")
    late = judged.select("source_path", code.alias("error_code")).where("error_code IS NOT NULL")
    rejects = read.where("error_code IS NOT NULL").select("source_path", "error_code").unionByName(late)
    stored = judged.where("NOT doubled")
    documents = stored.select("document_id", "source_path", "source_sha256", "category", F.lit(indexed_at).alias("indexed_at"), "document_date", F.col("text").alias("raw_text"))
    return documents, tagged.where("NOT doubled").select(CHUNK), rejects
