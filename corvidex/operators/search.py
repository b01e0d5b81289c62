"""Ranked text search: postings, matching, BM25 with field weights, filters, top-k, penalty and per-document cap.

Statistics (rows, document frequencies, average length) are those of the whole
index, before any filter. All functions take and give DataFrames; queries come
as rows (qid, term, is_prefix), so one job answers one query or a million.

What a term adds to a chunk's score doesn't depend on the query, so it is worked
out once for each term and chunk, and only then meets the queries, in partitions
dealt by chunk. Ranking reads two columns of a chunk; texts are joined to the
hits that are left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvidex.functions import fixed, text as tx
from corvidex.operators import ranking

KEY = ["document_id", "chunk_no"]


@dataclass(frozen=True)
class SearchParams:
    weights: Mapping[str, float] = None  # type: ignore[assignment]  # by column; see WEIGHTS
    k1: float = 1.2
    b: float = 0.75
    prelimit: int = 200
    limit: int = 20
    limit_per_document: int = 3
    meta_factor: float = 0.1
    prefix_min_length: int = 5
    prefixes: bool = True

    def weight(self, column: str) -> float:
        return (WEIGHTS if self.weights is None else self.weights)[column]


# Weights of the indexed columns.
WEIGHTS = {"text": 3.0, "heading": 2.0, "section_path": 1.0, "tags_text": 1.5}


def _n_terms(columns: Sequence[str]) -> Column:
    return reduce(add, [F.size(tx.index_tokens(F.col(c))) for c in columns]).cast("long")


def postings(chunks: DataFrame, columns: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """(document_id, chunk_no, n_terms, col, term, pos) of every term of the indexed columns; n_terms counts the chunk's. No shuffle."""
    by_column = F.array(*[F.struct(F.lit(c).alias("col"), tx.index_tokens(F.col(c)).alias("terms")) for c in columns])
    # The array is never empty; the outer form keeps a test of that, which would read the text once more, out of the plan.
    each = chunks.select(*KEY, _n_terms(columns).alias("n_terms"), by_column.alias("held")).select(*KEY, "n_terms", F.explode_outer("held").alias("x"))
    return each.select(*KEY, "n_terms", F.col("x.col").alias("col"), F.posexplode("x.terms").alias("pos", "term"))


def lengths(chunks: DataFrame, columns: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """(document_id, chunk_no, n_terms); chunks without terms count 0. No shuffle."""
    return chunks.select(*KEY, _n_terms(columns).alias("n_terms"))


def corpus(chunk_lengths: DataFrame) -> DataFrame:
    """One row: n_rows, avg_terms."""
    return chunk_lengths.agg(F.count("*").alias("n_rows"), (F.sum("n_terms") / F.count("*")).alias("avg_terms"))


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    terms: DataFrame | None = None  # a written index has its distinct terms, sorted


def index(chunks: DataFrame) -> Index:
    size = lengths(chunks)
    return Index(postings(chunks), size, corpus(size))


def write_parts(posts: DataFrame, sizes: DataFrame, path: str) -> None:
    """Write postings sorted by term in each partition, so that a query reads the pages of its terms alone, and the distinct terms.

    A place takes far more bytes than its word has in the text, so places aren't dealt anew: it is chunks that the caller deals.
    """
    posts.sortWithinPartitions("term", "document_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")
    stored = posts.sparkSession.read.schema(posts.schema).parquet(f"{path}/postings")
    stored.select("term").distinct().sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")


def write_index(chunks: DataFrame, path: str) -> None:
    """Write the index of ``chunks``, which ``read_index`` reads; an index that changes is kept in segments."""
    made = index(chunks)
    write_parts(made.postings, made.lengths, path)


def read_index(spark: SparkSession, path: str) -> Index:
    parts = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms")]
    return Index(parts[0], parts[1], corpus(parts[1]), parts[2])


def restrict(posts: DataFrame, terms: Sequence[tuple[str, bool]]) -> DataFrame:
    """The postings of a few (term, is_prefix), as a filter that reaches the Parquet scan."""
    whole = F.col("term").isin([t for t, prefix in terms if not prefix])
    return posts.where(reduce(or_, [F.col("term").startswith(t) for t, prefix in terms if prefix], whole))


def compile_query(spark: SparkSession, queries: Mapping[int, str], params: SearchParams = SearchParams(), aliases: Mapping = fixed.ALIASES) -> DataFrame:
    """(qid, term, is_prefix) of query texts: normalized words, aliases, and prefixes for long Cyrillic words.

    A query without words gives no rows, hence no results.
    """
    return compile_queries(spark.createDataFrame(list(queries.items()), "qid long, query string"), params, aliases)


def compile_queries(queries: DataFrame, params: SearchParams = SearchParams(), aliases: Mapping = fixed.ALIASES, normalized: bool = False) -> DataFrame:
    """(qid, term, is_prefix, words): ``words`` are the index terms of a token; a token of several is a phrase of them."""
    text = F.trim(F.col("query") if normalized else tx.normalize(F.col("query")))
    token = queries.select("qid", F.explode(tx.expand(tx.query_tokens(text), aliases)).alias("token"))
    words = token.select("qid", "token", tx.index_tokens(F.col("token")).alias("words")).where(F.size("words") > 0)
    term = F.concat_ws(" ", "words")
    prefix = (F.length("token") >= params.prefix_min_length) & F.col("token").rlike("^[\\x{0400}-\\x{04FF}]+$") & F.lit(params.prefixes)
    return words.select("qid", term.alias("term"), prefix.alias("is_prefix"), "words").distinct()


FEW = 1000  # query terms that go into a filter of the postings' scan
FEW_STARTS = 8  # prefixes that go into it, or are compared with each place one by one
BROADCAST_TERMS = 200_000  # rows of queries' terms that are sent to every task
SPREAD = 32  # partitions for each one of the postings' scan, in which chunks meet terms and queries


def by_chunk(places: DataFrame, posts: DataFrame) -> DataFrame:
    """``places`` dealt by chunk into so many partitions that one holds the places of a few MB of texts.

    Places shrink so much in the shuffle that its bytes don't tell what a task
    will hold. What follows is by chunk, so nothing is dealt anew up to the ranks.
    """
    return places.repartition(SPREAD * max(1, posts.rdd.getNumPartitions()), *KEY)


def _units(terms: DataFrame) -> DataFrame:
    """(q, is_prefix, words) of the distinct terms of all queries."""
    words = F.col("words") if "words" in terms.columns else F.array("term")
    return terms.select(F.col("term").alias("q"), "is_prefix", words.alias("words")).distinct()


def prefix_terms(terms: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, term) of the distinct ``terms`` that begin with one of ``starts``: joined by as many letters as the shortest has, then compared."""
    starts = starts.distinct()
    shortest = F.broadcast(starts.agg(F.min(F.length("start")).alias("n")))  # one row
    wanted = starts.join(shortest).select("start", F.left("start", F.col("n")).alias("head"))
    known = terms.select("term").distinct().join(shortest).select("term", F.left("term", F.col("n")).alias("head"))
    return known.join(wanted, "head").where(F.startswith("term", "start")).select("start", "term")


def with_starts(posts: DataFrame, starts: Sequence[str]) -> DataFrame:
    """``posts`` once for each of a few ``starts`` that its term begins with, as ``start``. No shuffle."""
    held = F.filter(F.array(*map(F.lit, starts)), lambda x: F.startswith(F.col("term"), x))
    return posts.select("*", F.explode(held).alias("start"))


def with_words(posts: DataFrame, words: DataFrame, starts: bool = True, sent: bool = True) -> DataFrame:
    """``posts`` with the columns of each of ``words`` (word, begins, ...) that is their term or, if it ``begins``, starts it.

    One scan and one equality join for both: a place has its term, and the letters
    as many as the shortest of the ``starts`` has, under which it meets few of them.
    """
    if not starts:
        at, keys = words.where("NOT begins").withColumn("key", F.col("word")), F.array(F.struct(F.lit(False).alias("begins"), F.col("term").alias("key")))
    else:
        shortest = F.broadcast(words.where("begins").agg(F.min(F.length("word")).alias("shortest")))  # one row
        at = words.join(shortest).withColumn("key", F.when(F.col("begins"), F.left("word", F.col("shortest"))).otherwise(F.col("word"))).drop("shortest")
        posts = posts.join(shortest)
        keys = F.array(F.struct(F.lit(False).alias("begins"), F.col("term").alias("key")), F.struct(F.lit(True).alias("begins"), F.left("term", F.col("shortest")).alias("key")))
    each = posts.withColumn("x", F.explode(keys)).select(*[c for c in posts.columns if c != "shortest"], "x.begins", "x.key")
    met = each.join(F.broadcast(at) if sent else at, ["begins", "key"])
    return met.where(~F.col("begins") | F.startswith("term", "word")).drop("key")


def match(posts: DataFrame, units: DataFrame, params: SearchParams = SearchParams(), starts: Sequence[str] | None = None, phrases: bool = True, terms: DataFrame | None = None) -> DataFrame:
    """(q, is_prefix, document_id, chunk_no, n_terms, f): the weighted frequency of each term, prefix or phrase in each chunk.

    ``starts`` are the prefixes, if they are few; many are looked up in the
    distinct ``terms`` first, and only theirs meet the postings. Rows are dealt
    by chunk.
    """
    kinds = [c for c in WEIGHTS if params.weights is None or c in params.weights]
    table = F.create_map(*[x for c in kinds for x in (F.lit(c), F.lit(float(params.weight(c))))])
    columns = ["q", "is_prefix", *KEY, "n_terms", "col", "size", "start"]
    # A word is a phrase of one, whose start is its place.
    alone = [F.lit(1).alias("size"), F.col("pos").alias("start")]
    single = units.where("size(words) = 1")
    found = posts.join(single.where("NOT is_prefix").select("q", "is_prefix"), F.col("term") == F.col("q")).select(*columns[:-2], *alone)
    if starts is None or len(starts):
        if starts is None:
            known = prefix_terms(posts if terms is None else terms, single.where("is_prefix").select(F.col("q").alias("start")))
            begun = posts.join(known, "term")
        else:
            begun = with_starts(posts, starts)
        found = found.unionByName(begun.select(F.col("start").alias("q"), F.lit(True).alias("is_prefix"), *columns[2:-2], *alone))
    if phrases:
        words = units.where("size(words) > 1").select("q", "is_prefix", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
        found = found.unionByName(posts.join(words, F.col("term") == F.col("word")).select(*columns[:-1], (F.col("pos") - F.col("at")).alias("start")))
    found = by_chunk(found, posts)
    if phrases:
        found = found.groupBy(columns).agg(F.count("*").alias("n")).where("n = size")
    return found.groupBy("q", "is_prefix", *KEY, "n_terms").agg(F.sum(F.element_at(table, F.col("col"))).alias("f"))


def bm25(matched: DataFrame, stats: DataFrame, params: SearchParams = SearchParams(), few: bool = False) -> DataFrame:
    """(q, is_prefix, document_id, chunk_no, part): what each term adds to a chunk's weighted BM25; frequencies of ``few`` terms are sent to every task."""
    df = matched.groupBy("q", "is_prefix").agg(F.count("f").alias("n_q"))  # of f, so that both sides of the join share one scan
    # Dealt by term, all chunks of a common one would meet in one task.
    scored = matched.join(F.broadcast(df) if few else df, ["q", "is_prefix"]).join(F.broadcast(stats))  # one row
    idf = F.log((F.col("n_rows") - F.col("n_q") + 0.5) / (F.col("n_q") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    norm = params.k1 * (1 - params.b + params.b * F.col("n_terms") / F.col("avg_terms"))
    return scored.select("q", "is_prefix", *KEY, (idf * F.col("f") * (params.k1 + 1) / (F.col("f") + norm)).alias("part"))


def parts(held: Index, terms: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(q, is_prefix, document_id, chunk_no, part) of all terms of the queries; few ones filter the postings where they are scanned."""
    units = _units(terms)
    few = units.limit(FEW + 1).collect()
    if len(few) <= FEW:
        posts = restrict(held.postings, [(w, r.is_prefix and len(r.words) == 1) for r in few for w in r.words])
        starts, phrases = [r.q for r in few if r.is_prefix and len(r.words) == 1], any(len(r.words) > 1 for r in few)
    else:
        posts, few = held.postings, None
        prefixes, phrases = units.agg(F.max("is_prefix"), F.max(F.size("words") > 1)).first()
        starts = None if prefixes else []
    sent = few is not None or units.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return bm25(match(posts, units, params, starts, phrases, held.terms), held.corpus, params, sent)


def exact_sum(x: str) -> Column:
    """The sum of a column of doubles below 2^29 in all, the same in whatever order: multiples of 2^-24 add up without error, and the rest is too small for its own to count."""
    high = F.floor(F.col(x) * 2.0**24) / F.lit(2.0**24)
    return F.sum(high) + F.sum(F.col(x) - high)


def scores(each: DataFrame, terms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(qid, document_id, chunk_no, rank) from ``parts``: BM25 as a negative number, the best first in ascending order; ``by`` names further columns of a chunk.

    Summed without regard to the order, and rounded to 12 places, so that equal
    chunks have equal ranks.
    """
    wanted = terms.select("qid", F.col("term").alias("q"), "is_prefix").distinct()
    if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        # All of a chunk's terms meet its queries where they are; nothing is dealt anew for the sum.
        wanted = F.broadcast(wanted)
    return each.join(wanted, ["q", "is_prefix"]).groupBy("qid", *KEY, *by).agg(F.round(-exact_sum("part"), 12).alias("rank"))


def best(each: DataFrame, allowed: DataFrame, wanted: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """``scores`` of the ``allowed`` chunks that may be among a query's first ``k``: every one of those, ties included, and few others.

    All chunks are summed up for all queries ``wanted`` (qid, q, is_prefix), which
    are sent to every task; a task leaves out what is behind its own first ``k``.
    """
    rows = [tuple(r) for r in wanted.select("qid", "q", "is_prefix").collect()]
    number = {t: i for i, t in enumerate(sorted({r[1:] for r in rows}))}
    qids = sorted({r[0] for r in rows})
    place = {q: i for i, q in enumerate(qids)}
    pairs = np.array(sorted((number[r[1:]], place[r[0]]) for r in rows), dtype=np.int64)
    numbers = each.sparkSession.createDataFrame([(*t, i) for t, i in number.items()], "q string, is_prefix boolean, no long")
    # Chunks that aren't allowed are left out behind the join, so that filters stay out of the scan, which then is shared with the frequencies'.
    told = each.join(F.broadcast(numbers), ["q", "is_prefix"]).join(allowed.select(*KEY, *by, F.lit(True).alias("allowed")), KEY, "left")
    told = told.select(*KEY, *by, "no", "part", "allowed").sortWithinPartitions(*KEY)
    kinds = {f.name: f.dataType.simpleString() for f in [*told.schema.fields, wanted.schema["qid"]]}
    run = ranking.first_sums(KEY, [*KEY, *by], pairs, pa.array(qids, to_arrow_type(wanted.schema["qid"].dataType)), k)
    found = told.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ["qid", *KEY, *by]) + ", score double")
    return found.select("qid", *KEY, *by, F.round(-F.col("score"), 12).alias("rank"))


@dataclass(frozen=True)
class Filters:
    category: str | None = None
    category_mode: str = "soft"
    document_id: object | None = None
    kinds: tuple[str, ...] | None = None
    section_prefix: str | None = None
    from_date: str | None = None
    to_date: str | None = None
    exclude_meta: bool = True


def apply_filters(hits: DataFrame, f: Filters) -> DataFrame:
    """Only the filters that are set; dates compare as text; a category filters in hard mode alone."""
    if f.category is not None and f.category_mode == "hard":
        hits = hits.where(F.col("category") == f.category)
    if f.document_id is not None:
        hits = hits.where(F.col("document_id") == f.document_id)
    if f.kinds is not None:
        hits = hits.where(F.col("kind").isin(list(f.kinds)))
    if f.section_prefix is not None:
        hits = hits.where(F.lower("section_path").startswith(f.section_prefix.lower()))
    if f.from_date is not None:
        hits = hits.where(F.col("document_date") >= f.from_date)
    if f.to_date is not None:
        hits = hits.where(F.col("document_date") <= f.to_date)
    return hits.where("kind <> 'meta'") if f.exclude_meta else hits


def _first(hits: DataFrame, n: int, by: Sequence[str], order: list, name: str) -> DataFrame:
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def rank_results(hits: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """Top ``prelimit``, then the penalty of meta chunks and a new order, then the cap by document, then ``limit``; adds ``pos`` from 1."""
    newest = [F.desc("document_date"), F.asc("document_id"), F.asc("chunk_no")]
    top = _first(hits, params.prelimit, ["qid"], [F.asc("rank"), *newest], "pre")
    if params.meta_factor < 1.0:
        top = top.withColumn("rank", F.when(F.col("kind") == "meta", F.col("rank") * params.meta_factor).otherwise(F.col("rank")))
    order = [F.asc("rank"), F.desc("document_date"), F.asc("pre")]
    if params.limit_per_document > 0:
        top = _first(top, params.limit_per_document, ["qid", "document_id"], order, "in_document").drop("in_document")
    return _first(top, params.limit, ["qid"], order, "pos").drop("pre")


def search(chunks: DataFrame, documents: DataFrame, terms: DataFrame, filters: Filters = Filters(), params: SearchParams = SearchParams(), held: Index | None = None) -> DataFrame:
    """Ranked, capped hits of every query, with the chunk's and the document's columns; ``held`` is a written index of ``chunks``."""
    about = documents.select("document_id", "source_path", "category", "document_date")
    allowed = apply_filters(chunks.select(*KEY, "kind", "section_path").join(about, "document_id"), filters).select(*KEY, "kind", "document_date")
    each = parts(held or index(chunks), terms, params)
    wanted = terms.select("qid", F.col("term").alias("q"), "is_prefix").distinct()
    by = ["kind", "document_date"]
    if FEW < wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        hits = best(each, allowed, wanted, params.prelimit, by)
    else:
        hits = scores(each.join(allowed, KEY), terms, by)
    top = rank_results(hits, params)
    rest = chunks.select(*KEY, *[c for c in chunks.columns if c not in (*KEY, "kind")])
    return top.join(rest, KEY).join(about.drop("document_date"), "document_id")


def phrase(posts: DataFrame, words: Sequence[str]) -> DataFrame:
    """Chunks that hold ``words`` in this order, one after another in one column: (document_id, chunk_no, n)."""
    wanted = posts.where(F.col("term").isin(list(dict.fromkeys(words))))
    places = None
    for i, word in enumerate(words):
        here = wanted.where(F.col("term") == word).select(*KEY, "col", (F.col("pos") - i).alias("start"))
        places = here if places is None else places.join(here, [*KEY, "col", "start"], "left_semi")
    return places.groupBy(*KEY).agg(F.count("*").alias("n"))


def all_terms(posts: DataFrame, words: Sequence[str], column: str | None = None) -> DataFrame:
    """Chunks that hold each of ``words``, in one column if it is named."""
    wanted = posts.where(F.col("term").isin(list(words)))
    wanted = wanted.where(F.col("col") == column) if column else wanted
    return wanted.groupBy(*KEY).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(set(words))).select(*KEY)


def group_by_document(hits: DataFrame) -> DataFrame:
    """(qid, document_id, group_pos, chunks): groups in the order of their best hit, hits in theirs."""
    each = hits.groupBy("qid", "document_id").agg(F.min("pos").alias("best"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "chunk_no"))), lambda x: x["chunk_no"]).alias("chunks"))
    return each.withColumn("group_pos", F.row_number().over(Window.partitionBy("qid").orderBy("best"))).drop("best")


def neighbours(hits: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """(qid, document_id, hit_no, chunk_no, kind, text) around each hit, itself left out.

    Numbers are cut into bins as wide as a hit's window, so a window touches two
    bins at most, and document and bin are the key of an equality join: a hit
    meets the chunks of two bins, not those of its whole document.
    """
    span = 2 * width + 1
    h = hits.select("qid", "document_id", F.col("chunk_no").alias("hit_no"))
    first, last = (F.floor((F.col("hit_no") + d) / span).cast("long") for d in (-width, width))
    h = h.withColumn("bin", F.explode(F.sequence(first, last)))
    near = F.col("chunk_no").between(F.col("hit_no") - width, F.col("hit_no") + width) & (F.col("chunk_no") != F.col("hit_no"))
    binned = chunks.select(*KEY, "kind", "text", F.floor(F.col("chunk_no") / span).cast("long").alias("bin"))
    return h.join(binned, ["document_id", "bin"]).where(near).drop("bin")


def full_text(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, document_id, raw_text) of the documents hit; a missing document has a null text."""
    return hits.select("qid", "document_id").distinct().join(documents.select("document_id", "raw_text"), "document_id", "left")


def documents_matching(posts: DataFrame, documents: DataFrame, word: str) -> DataFrame:
    """Documents with a chunk that holds ``word``."""
    return documents.join(posts.where(F.col("term") == word).select("document_id"), "document_id", "left_semi")
