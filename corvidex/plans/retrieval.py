"""Composed plans: retrieval of a request, baseline context, consult context, the tools' results."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from corvidex.functions import fixed
from corvidex.operators import bundle, catalog, search as s


@dataclass(frozen=True)
class Request:
    query: str
    filters: s.Filters = s.Filters()
    params: s.SearchParams = s.SearchParams()
    neighbour_width: int = 0  # 0: no neighbours
    with_full_text: bool = False


@dataclass(frozen=True)
class Response:
    terms: DataFrame
    chunks: DataFrame
    documents: DataFrame
    neighbours: DataFrame | None
    full_text: DataFrame | None


def retrieve(chunks: DataFrame, documents: DataFrame, request: Request, held: s.Index | None = None) -> Response:
    """Answer one request; its few compiled terms filter the postings where they are scanned."""
    terms = s.compile_query(chunks.sparkSession, {0: request.query}, request.params)
    hits = s.search(chunks, documents, terms, request.filters, request.params, held)
    around = s.neighbours(hits, chunks, request.neighbour_width) if request.neighbour_width > 0 else None
    whole = s.full_text(hits, documents) if request.with_full_text else None
    return Response(terms, hits, s.group_by_document(hits), around, whole)


@dataclass(frozen=True)
class RecencyParams:
    fetch: int = 5
    max_docs: int = 3
    per_doc: int = 2
    lookback_days: int = 365


def baseline(chunks: DataFrame, documents: DataFrame, terms: DataFrame, as_of: str, recency: RecencyParams = RecencyParams(), bundled: bundle.BundleParams = bundle.BundleParams(), params: s.SearchParams = s.SearchParams()) -> DataFrame:
    """(qid, pos, slot, body): hits of the last ``lookback_days`` and first chunks of recent documents, in one bundle.

    ``as_of`` stands for today, so that a run can be repeated.
    """
    from_date = (date.fromisoformat(as_of) - timedelta(days=recency.lookback_days)).isoformat()
    hits = s.search(chunks, documents, terms, s.Filters(from_date=from_date, to_date=as_of), params)
    recent = catalog.recency_chunks(documents, chunks, from_date, recency.fetch, recency.max_docs, recency.per_doc)
    recent = recent.withColumn("pos", (F.col("doc_pos") - 1) * recency.per_doc + F.col("in_doc"))
    columns = ["qid", "pos", "document_id", "chunk_no", "text", "section_path", "source_path", "category", "document_date"]
    recent = terms.select("qid").distinct().join(F.broadcast(recent)).select(columns)
    return bundle.build(bundle.merge(hits.select(columns), recent, s.KEY), bundled)


def consult(chunks: DataFrame, documents: DataFrame, terms: DataFrame, from_date: str, to_date: str | None, include_meta: bool = False, recency: RecencyParams = RecencyParams(fetch=50), bundled: bundle.BundleParams = bundle.BundleParams(10, 15000, 3, 8, 10, {}, 1000), params: s.SearchParams = s.SearchParams()) -> DataFrame:
    """As ``baseline`` with its own limits and dates; the recent documents ignore ``to_date``."""
    hits = s.search(chunks, documents, terms, s.Filters(from_date=from_date, to_date=to_date, exclude_meta=not include_meta), params)
    recent = catalog.recency_chunks(documents, chunks, from_date, recency.fetch, recency.max_docs, recency.per_doc)
    recent = recent.withColumn("pos", (F.col("doc_pos") - 1) * recency.per_doc + F.col("in_doc"))
    columns = ["qid", "pos", "document_id", "chunk_no", "text", "section_path", "source_path", "category", "document_date"]
    recent = terms.select("qid").distinct().join(F.broadcast(recent)).select(columns)
    return bundle.build(bundle.merge(hits.select(columns), recent, s.KEY), bundled)


@dataclass(frozen=True)
class ToolLimits:
    search_chunks: int = 10
    search_chars: int = 4000
    document_chunks: int = 200
    document_chars: int = 16000
    categories: tuple[str, ...] = field(default=())


def check_search_arguments(arguments: dict, limits: ToolLimits = ToolLimits()) -> str | None:
    """What is wrong with a search call's arguments, else None."""
    query, limit = arguments.get("query"), arguments.get("limit")
    if not isinstance(query, str) or not query.strip():
        return "query is required"
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        return "limit must be a positive integer"
    if (category := arguments.get("category")) is not None and limits.categories and category not in limits.categories:
        return "unknown category"
    dates = [arguments.get(k) for k in ("from_date", "to_date")]
    if any(d is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(d)) for d in dates):
        return "dates must be YYYY-MM-DD"
    return "from_date is after to_date" if all(dates) and dates[0] > dates[1] else None


def search_tool(chunks: DataFrame, documents: DataFrame, arguments: dict, limits: ToolLimits = ToolLimits()) -> str:
    """The text that the search tool answers with."""
    if error := check_search_arguments(arguments, limits):
        return f"Error: {error}"
    most = min(arguments["limit"], limits.search_chunks)
    filters = s.Filters(category=arguments.get("category"), from_date=arguments.get("from_date"), to_date=arguments.get("to_date"))
    found = retrieve(chunks, documents, Request(arguments["query"], filters, s.SearchParams(limit=most)))
    row = bundle.tool_result(bundle.tool_excerpts(found.chunks, limits.search_chars)).first()
    return row["result"] if row else bundle.no_match(arguments["query"])


def argument_error(limits: ToolLimits = ToolLimits()) -> Column:
    """What is wrong with a row of search calls (query, limit, category, from_date, to_date), else null; as ``check_search_arguments``."""
    dates = [F.coalesce(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(True)) for c in ("from_date", "to_date")]
    unknown = F.col("category").isNotNull() & ~F.col("category").isin(list(limits.categories)) if limits.categories else F.lit(False)
    return (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "query is required")
        .when(F.coalesce(F.col("limit"), F.lit(0)) <= 0, "limit must be a positive integer")
        .when(unknown, "unknown category")
        .when(~(dates[0] & dates[1]), "dates must be YYYY-MM-DD")
        .when(F.col("from_date") > F.col("to_date"), "from_date is after to_date")
    )


def search_tool_answers(chunks: DataFrame, documents: DataFrame, calls: DataFrame, limits: ToolLimits = ToolLimits(), params: s.SearchParams = s.SearchParams(), held: s.Index | None = None, aliases: Mapping = fixed.ALIASES) -> DataFrame:
    """(qid, result): the text that the search tool answers each call (qid, query, limit, category, from_date, to_date) with, as ``search_tool``, for all calls in one job."""
    judged = calls.withColumn("error", argument_error(limits))
    good = judged.where("error IS NULL")
    terms = s.compile_queries(good.select("qid", "query"), params, aliases)
    about = documents.select("document_id", "source_path", "category", "document_date")
    narrow = chunks.where("kind <> 'meta'").select(*s.KEY, "kind").join(about.select("document_id", "document_date"), "document_id")
    ranked = s.scores(s.parts(held or s.index(chunks), terms, params).join(narrow, s.KEY), terms, ("kind", "document_date"))
    dated = ranked.join(good.select("qid", "limit", "from_date", "to_date"), "qid")
    dated = dated.where("(from_date IS NULL OR document_date >= from_date) AND (to_date IS NULL OR document_date <= to_date)")
    top = s.rank_results(dated, replace(params, limit=limits.search_chunks)).where(F.col("pos") <= F.col("limit"))
    hits = top.drop("document_date").join(chunks.select(*s.KEY, "text", "section_path"), s.KEY).join(about, "document_id")
    answers = bundle.tool_result(bundle.tool_excerpts(hits, limits.search_chars))
    none = F.replace(F.lit(bundle.NO_MATCH), F.lit("{query}"), F.col("query"))
    error = F.concat(F.lit("Error: "), F.col("error"))
    return judged.join(answers, "qid", "left").select("qid", F.coalesce(error, "result", none).alias("result"))


def document_tool(chunks: DataFrame, documents: DataFrame, document_id: object, sections: list[str] | None = None, limits: ToolLimits = ToolLimits()) -> DataFrame:
    """(qid, result) of one document's chunks in order, of the named sections if there are any."""
    own = catalog.document_chunks(chunks, document_id, limits.document_chunks)
    own = catalog.section_filter(own, document_id, sections) if sections else own
    about = documents.select("document_id", "source_path", "category", "document_date")
    rows = own.join(about, "document_id").withColumns({"qid": F.lit(0), "pos": F.col("chunk_no")})
    return bundle.tool_result(bundle.tool_excerpts(rows, limits.document_chars))
