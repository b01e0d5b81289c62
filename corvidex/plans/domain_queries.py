"""Named queries whose input is composed from the driver's rows, so that every rule under test is met, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvidex.functions import control, text as tx
from corvidex.operators import bundle, catalog, constraints, dialogue, ingest, library, search as s, segments, store
from corvidex.plans import prompts, retrieval
from corvidex.plans.queries import _CHUNKS, _DOCS, _MESSAGES, _RECENT_SQL, _data, _query, _ranked, _scored, _terms, _words, _WORDS_SQL
from corvidex.sources import corpus
from corvidex.sources.versions import Versions

# Retrieval


@_query(
    f"""WITH {_scored(_WORDS_SQL)}, {_ranked("document_date BETWEEN '2024-03-01' AND '2024-10-31'")}, {_RECENT_SQL.format(fetch=50, cutoff='2024-03-01', max_docs=3)},
u AS (SELECT 0 AS src, pos, document_id, chunk_no, text, section_path, source_path, category, document_date FROM ranked
 UNION ALL SELECT 1, (doc_pos - 1) * 2 + in_doc, document_id, chunk_no, text, section_path, source_path, category, document_date FROM recency),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY document_id, chunk_no ORDER BY src, pos) = 1),
n AS (SELECT * EXCLUDE (pos, text), left(text, 1000) AS text, row_number() OVER (ORDER BY src, pos) AS pos FROM o),
r AS (SELECT *, sum(length(text)) OVER (ORDER BY pos) AS used FROM n WHERE pos <= 10)
SELECT pos, CASE WHEN pos <= 3 THEN 'top' ELSE 'excerpt' END AS slot,
 '[' || pos || '] ' || source_path || ' | ' || document_date || ' | ' || category || ' | ' || coalesce(nullif(section_path, ''), '(no section)') || chr(10) || chr(10) || text AS body FROM r WHERE used <= 15000"""
)
def consult_bundle(spark, sf_dir):
    """Hits between two dates with administrative chunks, then recent documents, which ignore the later date."""
    chunks, docs = _data(spark, sf_dir)
    return retrieval.consult(chunks, docs, _words(spark), "2024-03-01", "2024-10-31", include_meta=True).select("pos", "slot", "body")


@_query(
    """WITH d AS (SELECT lang, doc_id, source, array_to_string(list_slice(string_split(text, chr(10)), 1, CASE lang WHEN 'en' THEN 2 WHEN 'fr' THEN 4 ELSE 6 END), chr(10)) AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents),
c AS (SELECT *, CASE WHEN length(t) <= 300 THEN t WHEN position(chr(10) IN reverse(left(t, 300))) > 0 AND 300 - position(chr(10) IN reverse(left(t, 300))) > 0 THEN left(t, 300 - position(chr(10) IN reverse(left(t, 300)))) ELSE left(t, 300) END AS x FROM d WHERE pos <= 30),
r AS (SELECT *, sum(length(x)) OVER (PARTITION BY lang ORDER BY pos) AS used FROM c)
SELECT lang AS qid, pos, CASE WHEN pos <= 4 THEN 'top' ELSE 'excerpt' END AS slot, '[' || pos || '] ' || source || ' | 2024 | ' || lang || ' | (no section)' || chr(10) || chr(10) || CASE WHEN pos <= 4 THEN array_to_string(list_slice(string_split(x, chr(10)), 1, 3), chr(10)) ELSE x END AS body FROM r WHERE used <= 4000"""
)
def bundle_limits(spark, sf_dir):
    """Texts of several lines under line limits by category, a character limit and a budget; each language is a query."""
    d = corpus.table(spark, sf_dir, "documents")
    pos = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    rows = d.select(F.col("lang").alias("qid"), pos.alias("pos"), "text", F.lit(None).cast("string").alias("section_path"), F.col("source").alias("source_path"), F.col("lang").alias("category"), F.lit("2024").alias("document_date"))
    return bundle.build(rows, bundle.BundleParams(30, 4000, 4, 3, 6, {"en": 2, "fr": 4}, 300))


_COMMON_SQL = "SELECT * FROM (VALUES (0, 'of', false), (0, 'de', false), (0, 'the', false)) t(qid, term, is_prefix)"


@_query(f"WITH {_scored(_COMMON_SQL)}, {_ranked('document_id = 8')} SELECT document_id, chunk_no, pos, round(rank, 9) AS rank FROM ranked")
def search_document(spark, sf_dir):
    """Ranked chunks of one document, scored by the whole index."""
    chunks, docs = _data(spark, sf_dir)
    return s.search(chunks, docs, _words(spark, ("of", "de", "the")), s.Filters(document_id=8, exclude_meta=False)).select("document_id", "chunk_no", "pos", F.round("rank", 9).alias("rank"))


@_query(
    f"""WITH {_DOCS}, {_CHUNKS}, d AS (SELECT document_id, chunk_no, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t, len(regexp_extract_all(lower(text || ' ' || coalesce(heading, '') || ' ' || coalesce(section_path, '') || ' ' || tags_text), '[\\p{{L}}\\p{{N}}]+')) AS n FROM chunks),
f AS (SELECT document_id, chunk_no, n, 3.0 * len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) AS f FROM d),
s AS (SELECT count(*) AS n_rows, avg(n) AS a, count(*) FILTER (f > 0) AS n_q FROM f),
i AS (SELECT *, CASE WHEN ln((n_rows - n_q + 0.5) / (n_q + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n_q + 0.5) / (n_q + 0.5)) END AS idf FROM s)
SELECT document_id, chunk_no, round(-idf * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n / a)), 9) AS rank FROM f, i WHERE f > 0"""
)
def search_token_phrase(spark, sf_dir):
    """A query token of two index terms is a phrase of them."""
    chunks, _ = _data(spark, sf_dir)
    terms = s.compile_query(spark, {0: "of_the"})
    return s.scores(s.parts(s.index(chunks), terms), terms).select("document_id", "chunk_no", F.round("rank", 9).alias("rank"))


_MORE = " Температура ТТГ 12 OF_the"


@_query(
    rf"""SELECT DISTINCT item_id AS qid, term, false AS is_prefix FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) WHERE NOT regexp_matches(term, '^[0-9]+$')
UNION SELECT item_id, term, is_prefix FROM benchmark, (VALUES ('температура', true), ('ттг', false), ('tsh', false), ('of the', false)) t(term, is_prefix)"""
)
def compiled_terms(spark, sf_dir):
    """Words of each benchmark item, with an alias, a phrase and a prefix behind them; numbers alone go."""
    items = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.concat("text", F.lit(_MORE)).alias("query"))
    return s.compile_queries(items).select("qid", "term", "is_prefix")


_CALLS_SQL = f"""calls AS (SELECT item_id AS qid, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE array_to_string(list_slice({_terms('text')}, 1, 3), ' ') END AS query, item_id % 13 AS lim,
 CASE WHEN item_id % 3 = 0 THEN '2024-03-01' END AS from_date, CASE WHEN item_id % 9 = 0 THEN '2024-02-01' WHEN item_id % 4 = 0 THEN '2024-09-30' WHEN item_id % 11 = 0 THEN '1.2.2024' END AS to_date FROM benchmark),
judged AS (SELECT *, CASE WHEN trim(query) = '' THEN 'query is required' WHEN lim <= 0 THEN 'limit must be a positive integer' WHEN NOT coalesce(regexp_full_match(to_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), true) THEN 'dates must be YYYY-MM-DD' WHEN from_date > to_date THEN 'from_date is after to_date' END AS error FROM calls)"""
_CALL_TERMS_SQL = "SELECT DISTINCT qid, unnest(string_split(query, ' ')) AS term, false AS is_prefix FROM judged WHERE error IS NULL"


@_query(
    f"""WITH {_CALLS_SQL}, {_scored(_CALL_TERMS_SQL)}, pre AS (SELECT h.*, lim, row_number() OVER (PARTITION BY qid ORDER BY rank, document_date DESC, document_id, chunk_no) AS pre FROM hits h JOIN judged USING (qid)
 WHERE kind <> 'meta' AND (from_date IS NULL OR document_date >= from_date) AND (to_date IS NULL OR document_date <= to_date)),
cap AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY rank, document_date DESC, pre) AS in_document FROM pre WHERE pre <= 200),
num AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, document_date DESC, pre) AS pos FROM cap WHERE in_document <= 3),
e AS (SELECT qid, pos, document_id || '#chunk_' || chunk_no || ' | ' || document_date || ' | ' || category || ' | ' || coalesce(section_path, '') || chr(10) || chr(10) || text AS x FROM num WHERE pos <= 10 AND pos <= lim),
w AS (SELECT qid, pos, x, 4000 - coalesce(sum(length(x)) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e),
y AS (SELECT qid, pos, CASE WHEN length(x) <= room THEN x WHEN room <= 15 THEN left(x, CAST(room AS BIGINT)) ELSE left(x, CAST(floor((room - 15) / 2.0) AS BIGINT)) || chr(10) || '…[truncated]…' || chr(10) || right(x, CAST(floor((room - 15) / 2.0) AS BIGINT)) END AS x FROM w WHERE room > 0),
a AS (SELECT qid, '## Top Matches' || chr(10) || chr(10) || max(x) FILTER (pos = 1) || coalesce(chr(10) || chr(10) || '## Additional Matches' || chr(10) || chr(10) || string_agg(x, chr(10) || chr(10) ORDER BY pos) FILTER (pos > 1), '') AS result FROM y GROUP BY qid)
SELECT qid, coalesce('Error: ' || error, result, 'No matches found for query: "' || query || '"') AS result FROM judged LEFT JOIN a USING (qid)"""
)
def search_tool_answers(spark, sf_dir):
    """Answers to a search call for each benchmark item, of its first words, some of them with bad arguments or without a match."""
    chunks, docs = _data(spark, sf_dir)
    n = F.col("item_id")
    words = F.array_join(F.slice(tx.index_tokens(F.col("text")), 1, 3), " ")
    to = F.when(n % 9 == 0, "2024-02-01").when(n % 4 == 0, "2024-09-30").when(n % 11 == 0, "1.2.2024")
    calls = corpus.table(spark, sf_dir, "benchmark").select(n.alias("qid"), F.when(n % 7 == 0, " ").otherwise(words).alias("query"), (n % 13).alias("limit"), F.lit(None).cast("string").alias("category"), F.when(n % 3 == 0, "2024-03-01").alias("from_date"), to.alias("to_date"))
    return retrieval.search_tool_answers(chunks, docs, calls, aliases={})


# The library


def _numbered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks as the library takes them."""
    chunks, docs = _data(spark, sf_dir)
    id_ = F.concat_ws("#", F.col("document_id").cast("string"), F.col("chunk_no").cast("string"))
    return docs, chunks.withColumns({"chunk_id": id_, "chunk_no": F.col("chunk_no").cast("int")})


def _changed_library(spark, sf_dir) -> Versions:
    """A library that took all documents, then a tenth again without administrative chunks, then lost a tenth; in a new shared folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = library.open_library(spark, f"{folder}/library-{uuid.uuid4().hex}", 8)
    docs, chunks = _numbered(spark, sf_dir)
    library.put(held, docs, chunks)
    again = F.col("document_id") % 10 == 1
    library.put(held, docs.where(again).withColumn("category", F.lit("again")), chunks.where(again & (F.col("kind") != "meta")))
    library.remove(held, docs.where("document_id % 10 = 0"))
    return held


_LIBRARY_SQL = _CHUNKS.replace("chunks AS", "every AS") + """,
chunks AS (SELECT * EXCLUDE (chunk_no), row_number() OVER (PARTITION BY document_id ORDER BY chunk_no) - 1 AS chunk_no FROM every WHERE document_id % 10 <> 0 AND (document_id % 10 <> 1 OR kind <> 'meta'))"""


@_query(f"WITH {_scored(_WORDS_SQL).replace(_CHUNKS, _LIBRARY_SQL)} SELECT document_id, chunk_no, round(rank, 9) AS rank FROM hits")
def library_search(spark, sf_dir):
    """Scores from the index segments of a library after changes of documents, equal to those of its chunks as they are then."""
    held = segments.read_index(_changed_library(spark, sf_dir))
    words = _words(spark)
    return s.scores(s.parts(held, words), words).select("document_id", "chunk_no", F.round("rank", 9).alias("rank"))


@_query(f"WITH {_DOCS}, {_LIBRARY_SQL} SELECT c.document_id, CASE WHEN c.document_id % 10 = 1 THEN 'again' ELSE category END AS category, count(*) AS n_chunks, max(chunk_no) AS last_no, max(length(raw_text)) AS n_chars FROM chunks c JOIN docs USING (document_id) GROUP BY ALL")
def library_documents(spark, sf_dir):
    """Documents and chunks of the library's last version."""
    held = _changed_library(spark, sf_dir)
    rows = held.read("chunks").groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_no").alias("last_no"))
    docs = held.read("documents").select("document_id", "category", F.length("raw_text").alias("n_chars"))
    return rows.join(docs, "document_id").select("document_id", "category", "n_chunks", "last_no", "n_chars")


# Catalog


@_query(f"WITH {_DOCS} SELECT document_id, source_path FROM docs WHERE source_sha256 = (SELECT source_sha256 FROM docs WHERE document_id = 9) ORDER BY document_id LIMIT 1")
def find_by_hash(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    wanted = docs.where("document_id = 9").first()["source_sha256"]
    return catalog.find_by_hash(docs, wanted).select("document_id", "source_path")


@_query(f"WITH {_CHUNKS} SELECT document_id, chunk_no, section_path FROM chunks WHERE trim(string_split(section_path, ' > ')[1]) IN ('src1', 'src2')")
def section_filter(spark, sf_dir):
    return catalog.section_filter(corpus.chunks(spark, sf_dir), None, ["SRC1", "src2"]).select("document_id", "chunk_no", "section_path")


# Control fields and ingest

_KEY = "s_suppkey"
_DATE_SQL = "strftime(DATE '2024-01-01' + CAST(s_suppkey % 300 AS INTEGER), '{form}')"


def _day(form: str) -> Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col(_KEY) % 300).cast("int")), form)


@_query(
    f"""SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE {_DATE_SQL.format(form='%Y-%m-%d')} END AS found_date, 'Анализы' AS category,
 CASE s_suppkey % 5 WHEN 0 THEN 'a' || chr(10) || chr(10) || 'b' WHEN 1 THEN 'text' WHEN 2 THEN '**дата рождения:** 01.01.1990' || chr(10) || '**дата валидации:** ' || {_DATE_SQL.format(form='%d.%m.%Y')} || chr(10) || 'text'
 WHEN 3 THEN '**дата валидации:** 02.02.2002' || chr(10) || '**дата:** ' || {_DATE_SQL.format(form='%d/%m/%Y')} ELSE '**дата печати:** 01.01.2020' END AS body FROM supplier"""
)
def control_dates(spark, sf_dir):
    """Dates from front matter, file names, fallback and plain markers, with excluded markers beside them; marks and CR line ends go."""
    k = F.col(_KEY) % 5
    category = "категория: анализы"
    text = (
        F.when(k == 0, F.concat(F.lit("﻿---\r\ndate: "), _day("yyyy-MM-dd"), F.lit(f"\r\n---\r\n{category}\r\na\r\r\u0007b")))
        .when(k == 1, f"{category}\ntext")
        .when(k == 2, F.concat(F.lit(f"{category}\n**Дата рождения:** 01.01.1990\n**Дата валидации:** "), _day("dd.MM.yyyy"), F.lit("\ntext")))
        .when(k == 3, F.concat(F.lit(f"{category}\n**Дата валидации:** 02.02.2002\n**Дата:** "), _day("dd/MM/yyyy")))
        .otherwise(f"{category}\n**Дата печати:** 01.01.2020")
    )
    path = F.when(k == 1, F.concat(_day("yyyy-MM-dd"), F.lit("_report.md"))).otherwise("report.md")
    read = ingest.read_controls(corpus.table(spark, sf_dir, "supplier").select(F.col(_KEY).alias("key"), path.alias("source_path"), text.alias("raw_content")))
    return read.select("key", F.col("document_date").alias("found_date"), "category", "body")


def _report(spark, sf_dir) -> DataFrame:
    """A Markdown file for each supplier, with every kind of block that makes a chunk."""
    template = (
        "# Отчет\n**Категория:** Анализы\n**Дата:** {day}\n\n## Пациент\nНомер {k}\n\n## Кровь\n**Общий анализ:**\n\n| показатель | значение |\n|---|---|\n| ТТГ | {k} |\n\n**Вывод**: норма {k}\n\n"
        "### Детали\nтекст {k}\n\n- один\n- два {k}\n\n#### Глубже\nеще {k}\n\n## Пусто\n\n## Итог\n> цитата {k}\n\n**Хвост**\n"
    )
    d = corpus.table(spark, sf_dir, "supplier")
    text = prompts.render(template, {"day": _day("yyyy-MM-dd"), "k": F.col(_KEY)})
    return d.select(F.concat(F.lit("r"), F.col(_KEY).cast("string"), F.lit(".md")).alias("source_path"), text.alias("raw_content"))


_REPORT_CHUNKS = [
    ("section", "'дата: ' || {day}", "отчет"), ("meta", "'номер ' || k", "отчет > пациент"), ("table", "'общий анализ:' || chr(10) || 'показатель | значение' || chr(10) || 'ттг | ' || k", "отчет > кровь"),
    ("fact", "'вывод: норма ' || k", "отчет > кровь"), ("section", "'текст ' || k", "отчет > кровь > детали"), ("list", "'- один' || chr(10) || '- два ' || k", "отчет > кровь > детали"),
    ("section", "'еще ' || k", "отчет > кровь > детали > глубже"), ("section", "'цитата ' || k", "отчет > итог"), ("section", "'хвост'", "отчет > итог"),
]


@_query(
    "WITH r AS (SELECT s_suppkey AS k FROM supplier) "
    + " UNION ALL ".join(
        f"SELECT 'r' || k || '.md' AS source_path, {n} AS chunk_no, '{kind}' AS kind, {text.format(day=_DATE_SQL.format(form='%Y-%m-%d').replace('s_suppkey', 'k'))} AS text, '{path}' AS section_path, '{path.split(' > ')[-1]}' AS heading FROM r"
        for n, (kind, text, path) in enumerate(_REPORT_CHUNKS)
    )
)
def ingest_reports(spark, sf_dir):
    """All chunks of ingested files of known structure."""
    read = ingest.last_uploads(ingest.read_controls(_report(spark, sf_dir)))
    return ingest.tagged_chunks(read.where("error_code IS NULL")).where("NOT doubled").select("source_path", "chunk_no", "kind", "text", "section_path", "heading")


@_query("SELECT 'r' || s_suppkey || '.md' AS source_path, 'Анализы' AS category, " + _DATE_SQL.format(form="%Y-%m-%d") + " AS document_date, '2025-01-01' AS indexed_at FROM supplier")
def ingest_documents(spark, sf_dir):
    return ingest.ingest(_report(spark, sf_dir), "2025-01-01")[0].select("source_path", "category", "document_date", "indexed_at")


@_query(
    f"""WITH {_DOCS}, f AS (SELECT document_id, CASE document_id % 8 WHEN 0 THEN 'E_EMPTY_CHUNKS' WHEN 1 THEN 'E_DUPLICATE_CHUNK' WHEN 2 THEN 'E_NO_SCHEMA_ID' WHEN 3 THEN 'E_NO_DOCUMENT_DATE' END AS error_code FROM docs)
SELECT document_id AS key, error_code FROM f WHERE error_code IS NOT NULL"""
)
def ingest_rejects(spark, sf_dir):
    """Files of documents that have no chunk, two equal ones, no category or no date, beside good ones; the document's number is the file's name."""
    d = corpus.documents(spark, sf_dir)
    k = F.col("document_id") % 8
    category, date = F.when(k == 2, "").otherwise("категория: анализы\n"), F.when(k == 3, "").otherwise(F.concat(F.lit("**Дата:** "), "document_date", F.lit("\n")))
    number = F.concat(F.lit("n"), F.col("document_id").cast("string"))
    body = F.when(k == 0, F.concat(F.lit("\n# "), number)).when(k == 1, F.concat(F.lit("\n"), number, F.lit("\n\n"), number)).otherwise(F.concat(F.lit("\n"), number))
    # Without a chunk, only headings may be there: the date is in the name.
    text = F.when(k == 0, F.concat(F.lit("категория: анализы\n"), body)).otherwise(F.concat(date, category, body))
    name = F.when(k == 0, F.concat("document_date", F.lit("_"), number)).otherwise(number)
    rejects = ingest.ingest(d.select(F.concat(name, F.lit(".md")).alias("source_path"), text.alias("raw_content")), "2025-01-01")[2]
    return rejects.select(F.regexp_extract("source_path", r"n(\d+)\.md$", 1).cast("long").alias("key"), "error_code")


@_query(
    """SELECT sha256(lower(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'))) AS text_sha256, max(doc_id) AS key FROM documents GROUP BY ALL"""
)
def last_uploads(spark, sf_dir):
    """Of the documents with equal text, as files of one name uploaded in the order of their numbers, the last one."""
    d = corpus.table(spark, sf_dir, "documents")
    head = "категория: анализы\n**дата:** 2024-01-01\n\n"
    files = d.select(F.lit("a.md").alias("source_path"), F.concat(F.lit(head), F.coalesce("text", F.lit(""))).alias("raw_content"), F.col("doc_id").alias("uploaded"))
    kept = ingest.last_uploads(ingest.read_controls(files))
    return kept.select(F.sha2(F.substr("text", F.lit(len(head) + 1)), 256).alias("text_sha256"), F.col("uploaded").alias("key"))


@_query("SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN 'ldl лпнп' WHEN 1 THEN 'алт алтаст аст' ELSE 'ttgx кровь' END AS tags FROM supplier")
def tags_of_terms(spark, sf_dir):
    """Tags with aliases, dashes, slashes, units, stop words and numbers in the text."""
    k = F.col(_KEY) % 3
    text = F.when(k == 0, "ЛПНП, 12 ммоль/л").when(k == 1, "алт-аст для 2024").otherwise("(кровь) ttgx/ мг")
    return corpus.table(spark, sf_dir, "supplier").select(F.col(_KEY).alias("key"), tx.tags([tx.normalize(text)]).alias("tags"))


# Dialogue, store and prompts


_SHA = "left(sha256(text || '|' || kind), 32)"


@_query(
    f"""WITH {_DOCS}, {_CHUNKS}, d AS (SELECT document_id, category, CASE WHEN document_id % 5 = 0 THEN NULL ELSE raw_text END AS raw_text FROM docs WHERE document_id % 10 <> 0),
c AS (SELECT document_id, chunk_no // 2 AS chunk_no, {_SHA} AS chunk_id, kind, CASE WHEN chunk_no % 9 = 8 THEN NULL ELSE text END AS text FROM chunks)
SELECT 'chunks' AS "table", 'unique chunk_id' AS rule, chunk_id AS key, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'chunks', 'unique document_id, chunk_no', document_id || '|' || chunk_no, count(*) FROM c GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'chunks', 'document_id refers to documents', CAST(document_id AS VARCHAR), count(*) FROM c WHERE document_id NOT IN (SELECT document_id FROM d) GROUP BY ALL
UNION ALL SELECT 'documents', 'raw_text is not null', CAST(document_id AS VARCHAR), 1 FROM d WHERE raw_text IS NULL
UNION ALL SELECT 'chunks', 'text is not null', chunk_id, 1 FROM c WHERE text IS NULL
UNION ALL SELECT 'chunks', 'kind is known', chunk_id, 1 FROM c WHERE kind = 'meta'"""
)
def constraint_violations(spark, sf_dir):
    """Every row that breaks a rule, of documents and chunks with repeated keys, lost references, nulls and an unknown kind."""
    chunks, docs = _data(spark, sf_dir)
    d = docs.where("document_id % 10 <> 0").withColumn("raw_text", F.when(F.col("document_id") % 5 != 0, F.col("raw_text")))
    id_ = F.left(F.sha2(F.concat_ws("|", "text", "kind"), 256), F.lit(32))
    c = chunks.select("document_id", F.expr("chunk_no DIV 2").alias("chunk_no"), id_.alias("chunk_id"), "kind", F.when(F.col("chunk_no") % 9 != 8, F.col("text")).alias("text"))
    rules = [*constraints.LIBRARY, constraints.Holds("chunks", "kind is known", "kind IN ('section', 'table', 'list', 'fact')", "chunk_id")]
    return constraints.violations({"documents": d, "chunks": c}, rules)


@_query(
    f"WITH {_MESSAGES}, c AS (SELECT session_id, seq, seq % 4 AS n FROM messages) SELECT session_id, seq, i AS call_no, 't' || i AS name, i < 2 AS allowed FROM (SELECT session_id, seq, unnest(range(0, n)) AS i FROM c WHERE n > 0)"
)
def tool_budget(spark, sf_dir):
    """Up to three calls a message under a budget of two."""
    m = corpus.messages(spark, sf_dir)
    calls = F.transform(F.sequence(F.lit(0), (F.col("seq") % 4 - 1).cast("int")), lambda i: F.concat(F.lit('{"id":"x","name":"t'), i.cast("string"), F.lit('","arguments":{}}')))
    m = m.where("seq % 4 > 0").withColumn("tool_calls_json", F.concat(F.lit("["), F.array_join(calls, ","), F.lit("]")))
    return dialogue.call_budget(m, 2)


@_query("SELECT conv_id AS session_id, turn + 1 AS seq, role FROM conversations WHERE conv_id % 2 = 1 UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn), 'new' FROM conversations WHERE conv_id % 2 = 0 AND role <> 'system'")
def replace_messages(spark, sf_dir):
    m = corpus.messages(spark, sf_dir).select("session_id", "seq", "role")
    return store.replace_messages(m, m.where("session_id % 2 = 0 AND role <> 'system'").withColumn("role", F.lit("new")))


@_query("SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY ALL")
def delete_sessions(spark, sf_dir):
    m = corpus.messages(spark, sf_dir)
    gone = m.where("session_id % 3 = 0").select("session_id")
    return store.delete({"messages": m}, gone, "session_id")["messages"].groupBy("session_id").agg(F.count("*").alias("n"))


@_query(f"WITH {_DOCS}, d AS (SELECT document_id // 2 AS document_id, category, document_id AS version FROM docs WHERE document_id % 4 < 2 QUALIFY row_number() OVER (PARTITION BY document_id // 2 ORDER BY document_id DESC) = 1) SELECT document_id, category FROM docs WHERE document_id NOT IN (SELECT document_id FROM d) UNION ALL SELECT document_id, category FROM d")
def upsert_last_wins(spark, sf_dir):
    """Of new rows with equal keys the last one counts."""
    docs = corpus.documents(spark, sf_dir).select("document_id", "category")
    new = docs.where("document_id % 4 < 2").select(F.expr("document_id DIV 2").alias("document_id"), "category", F.col("document_id").alias("version"))
    return store.upsert(docs, new, ["document_id"], "version")


def _profiles(spark, sf_dir) -> DataFrame:
    c = corpus.table(spark, sf_dir, "customer")
    some = lambda n, word: F.transform(F.filter(F.array(*[F.lit(i) for i in range(1, 4)]), lambda i: i <= n), lambda i: F.concat(F.lit(word), i.cast("string")))
    k = F.col("c_custkey")
    return c.select(k.alias("owner"), F.col("c_name").alias("name"), (k % 90).cast("int").alias("age"), F.when(k % 2 == 0, "f").otherwise("m").alias("sex"), F.lit("1980-01-01").alias("date_of_birth"),
                    some(k % 3, "c").alias("chronic_conditions"), some(k % 2, "m").alias("current_medications"), some(k % 4, "a").alias("allergies"))


def _some(n: str, word: str) -> str:
    return f"list_transform(range(1, {n} + 1), lambda i: '{word}' || i)"


_PROFILES = f"p AS (SELECT c_custkey AS owner, c_name AS name, c_custkey % 90 AS age, CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'm' END AS sex, {_some('c_custkey % 3', 'c')} AS cc, {_some('c_custkey % 2', 'm')} AS cm, {_some('c_custkey % 4', 'a')} AS al FROM customer)"


@_query(f"WITH {_PROFILES} SELECT owner, CASE WHEN owner % 2 = 0 THEN 'new ' || name ELSE name END AS name, array_to_string(al, '+') AS allergies, trim(name) <> '' AND age > 0 AS is_complete FROM p")
def profile_upsert(spark, sf_dir):
    """Profiles stored, half of them replaced, and read again."""
    p = _profiles(spark, sf_dir)
    stored = store.upsert_profile(store.upsert_profile(p.limit(0).select("owner", "name", "age", "sex", "date_of_birth", *[F.to_json(c).alias(f"{c}_json") for c in ("chronic_conditions", "current_medications", "allergies")]), p), p.where("owner % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")))
    return dialogue.profile_complete(store.read_profile(stored)).select("owner", "name", F.array_join("allergies", "+").alias("allergies"), "is_complete")


def _listed(x: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, ', ') ELSE 'None' END"


@_query(
    f"""WITH {_PROFILES} SELECT owner, 'Age ' || age || ': ' || sex || '; ' || {_listed('cc')} || '; ' || {_listed('cm')} || '; ' || {_listed('al')} || '; 2025-01-01' || chr(10) || CASE WHEN owner % 5 = 0 THEN '(no documents in knowledge base)' ELSE 'document_id | date | category | sections' || chr(10) || name || ' | d' END AS system,
 'Age: ' || age || ' years' || chr(10) || 'Sex: ' || sex || CASE WHEN len(cc) > 0 THEN chr(10) || 'Chronic conditions: ' || array_to_string(cc, ', ') ELSE '' END || CASE WHEN len(cm) > 0 THEN chr(10) || 'Current medications: ' || array_to_string(cm, ', ') ELSE '' END || CASE WHEN len(al) > 0 THEN chr(10) || 'Allergies: ' || array_to_string(al, ', ') ELSE '' END || '|' || name || '|' || array_to_string(cc, chr(10) || chr(10)) || '|' || array_to_string(al, chr(10) || chr(10)) AS consult,
 name || ' {{kb_excerpts}}' || '|' || CASE WHEN len(cc) > 0 THEN array_to_string(cc, chr(10) || chr(10)) ELSE 'No relevant excerpts found.' END || '|' || CASE WHEN len(al) > 0 THEN array_to_string(al, chr(10) || chr(10)) ELSE 'No additional evidence.' END AS message FROM p"""
)
def rendered_prompts(spark, sf_dir):
    """System and user texts of each profile; braces in a value stay as they are."""
    p = _profiles(spark, sf_dir)
    index = prompts.document_index(F.when(F.col("owner") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat("name", F.lit(" | d")))))
    system = prompts.system_message("Age {age}: {sex}; {chronic_conditions}; {current_medications}; {allergies}; {now_date}\n{document_index}", "2025-01-01", index)
    consult = prompts.consult_message("{patient_info}|{user_request}|{top_chunks}|{kb_excerpts}", F.col("name"), F.col("chronic_conditions"), F.col("allergies"))
    message = prompts.user_message("{user_request}|{top_chunks}|{kb_excerpts}", F.concat("name", F.lit(" {kb_excerpts}")), F.col("chronic_conditions"), F.col("allergies"))
    return p.select("owner", system.alias("system"), consult.alias("consult"), message.alias("message"))
