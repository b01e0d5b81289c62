"""Named queries over the driver's tables for every family of operators, and the same in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvidex.functions import control, text as tx
from corvidex.operators import bundle, catalog, dialogue, expressions, ingest, search as s, store
from corvidex.plans import retrieval
from corvidex.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The tables as documents, chunks and messages, in SQL.
_DOCS = """docs AS (SELECT doc_id AS document_id, source AS source_path, lang AS category,
 strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%d') AS document_date,
 strftime(DATE '2025-01-01' + CAST((doc_id * 7) % 365 AS INTEGER), '%Y-%m-%d') AS indexed_at,
 sha256(text) AS source_sha256, text AS raw_text FROM documents)"""
_CHUNKS = """lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS text,
 unnest(range(0, len(string_split(text, chr(10))))) AS chunk_no FROM documents),
chunks AS (SELECT doc_id AS document_id, chunk_no,
 CASE WHEN chunk_no % 7 = 3 THEN 'meta' WHEN chunk_no % 7 = 5 THEN 'fact' ELSE 'section' END AS kind, text,
 CASE WHEN chunk_no % 5 <> 4 THEN source || ' > part ' || (chunk_no % 3) END AS section_path,
 CASE WHEN chunk_no % 5 <> 4 THEN 'part ' || (chunk_no % 3) END AS heading, lang AS tags_text
 FROM lines WHERE trim(text) <> '')"""
_MESSAGES = """messages AS (SELECT conv_id AS session_id, turn + 1 AS seq, role, text AS content,
 CASE WHEN role = 'assistant' AND (conv_id + turn) % 5 = 0 THEN '[{"id":"c' || turn || '","name":"kb.search_chunks","arguments":{}}]' END AS tool_calls_json
 FROM conversations)"""
_TERM = r"'[\p{L}\p{N}]+'"


def _terms(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), {_TERM})"


_POSTS = "posts AS (" + " UNION ALL ".join(f"SELECT document_id, chunk_no, '{c}' AS col, {w} AS w, unnest({_terms(c)}) AS term, unnest(range(0, len({_terms(c)}))) AS pos FROM chunks" for c, w in s.WEIGHTS.items()) + ")"
_STATS = f"sizes AS (SELECT document_id, chunk_no, {' + '.join(f'len({_terms(c)})' for c in s.WEIGHTS)} AS n_terms FROM chunks), stats AS (SELECT count(*) AS n_rows, sum(n_terms) / CAST(count(*) AS DOUBLE) AS avg_terms FROM sizes)"


def _scored(queries: str) -> str:
    """SQL of ``hits``: scored chunks with their details; ``queries`` gives (qid, term, is_prefix)."""
    return f"""{_DOCS}, {_CHUNKS}, {_POSTS}, {_STATS}, q AS ({queries}),
m AS (SELECT q.qid, q.term AS q, p.document_id, p.chunk_no, sum(p.w) AS f FROM posts p JOIN q ON p.term = q.term WHERE NOT q.is_prefix GROUP BY ALL
 UNION ALL SELECT q.qid, q.term AS q, p.document_id, p.chunk_no, sum(p.w) AS f FROM posts p JOIN q ON starts_with(p.term, q.term) WHERE q.is_prefix GROUP BY ALL),
freq AS (SELECT qid, q, count(*) AS n_q FROM m GROUP BY ALL),
idf AS (SELECT qid, q, CASE WHEN ln((n_rows - n_q + 0.5) / (n_q + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n_q + 0.5) / (n_q + 0.5)) END AS idf FROM freq, stats),
scored AS (SELECT m.qid, m.document_id, m.chunk_no, round(-sum(idf * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n_terms / avg_terms))), 12) AS rank
 FROM m JOIN idf USING (qid, q) JOIN sizes USING (document_id, chunk_no), stats GROUP BY ALL),
hits AS (SELECT s.*, c.kind, c.text, c.section_path, c.heading, c.tags_text, d.source_path, d.category, d.document_date
 FROM scored s JOIN chunks c USING (document_id, chunk_no) JOIN docs d USING (document_id))"""


def _ranked(where: str, prelimit: int = 200, factor: float = 0.1, per_document: int = 3, limit: int = 20) -> str:
    """SQL of ``ranked``: the order of top, penalty, cap and limit."""
    cap = f"WHERE in_document <= {per_document}" if per_document > 0 else ""
    return f"""pre AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, document_date DESC, document_id, chunk_no) AS pre FROM hits WHERE {where}),
pen AS (SELECT * EXCLUDE (rank), CASE WHEN kind = 'meta' AND {factor} < 1 THEN rank * CAST({factor} AS DOUBLE) ELSE rank END AS rank FROM pre WHERE pre <= {prelimit}),
cap AS (SELECT *, row_number() OVER (PARTITION BY qid, document_id ORDER BY rank, document_date DESC, pre) AS in_document FROM pen),
num AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, document_date DESC, pre) AS pos FROM cap {cap}),
ranked AS (SELECT * FROM num WHERE pos <= {limit})"""


def _wide(df: DataFrame) -> DataFrame:
    """Integers as longs, as SQL has them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: _wide(f(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


WORDS = ("attion", "thanedble", "oredble")
_WORDS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"(0, '{w}', false)" for w in WORDS) + ") t(qid, term, is_prefix)"
_HIT = ["document_id", "chunk_no", "pos", "rank", "kind", "category", "document_date"]
_HIT_SQL = "SELECT document_id, chunk_no, pos, round(rank, 9) AS rank, kind, category, document_date FROM ranked"


def _words(spark: SparkSession, words=WORDS, prefix: bool = False) -> DataFrame:
    return spark.createDataFrame([(0, w, prefix) for w in words], "qid long, term string, is_prefix boolean")


def _hits(df: DataFrame) -> DataFrame:
    return df.select(*_HIT).withColumn("rank", F.round("rank", 9))


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return corpus.chunks(spark, sf_dir), corpus.documents(spark, sf_dir)


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('true', 20, 1.0, 0, 20)} {_HIT_SQL}")
def search_top(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return _hits(s.search(chunks, docs, _words(spark), s.Filters(exclude_meta=False), s.SearchParams(prelimit=20, meta_factor=1.0, limit_per_document=0)))


@_query(f"WITH {_scored(_WORDS_SQL)} SELECT document_id, chunk_no, round(rank, 9) AS rank FROM hits")
def search_all_scores(spark, sf_dir):
    chunks, _ = _data(spark, sf_dir)
    return s.scores(s.parts(s.index(chunks), _words(spark)), _words(spark)).select("document_id", "chunk_no", F.round("rank", 9).alias("rank"))


_FILTERED = "kind <> 'meta' AND category = 'en' AND kind IN ('section', 'fact') AND lower(section_path) LIKE 'src1%' AND document_date BETWEEN '2024-02-01' AND '2024-11-30'"


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked(_FILTERED)} {_HIT_SQL}")
def search_filtered(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    f = s.Filters("en", "hard", None, ("section", "fact"), "src1", "2024-02-01", "2024-11-30")
    return _hits(s.search(chunks, docs, _words(spark), f))


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('true')} {_HIT_SQL}")
def search_penalty_cap(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return _hits(s.search(chunks, docs, _words(spark), s.Filters(exclude_meta=False)))


_STEMS = ("thane", "ored")


@_query(f"WITH {_scored('SELECT * FROM (VALUES ' + ', '.join(f'''(0, '{w}', true)''' for w in _STEMS) + ') t(qid, term, is_prefix)')}, {_ranked('''kind <> 'meta' ''')} {_HIT_SQL}")
def search_prefix(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return _hits(s.search(chunks, docs, _words(spark, _STEMS, True)))


_ALIASED = "SELECT * FROM (VALUES (0, 'attion', false), (0, 'thanedble', false)) t(qid, term, is_prefix)"


@_query(f"WITH {_scored(_ALIASED)}, {_ranked("kind <> 'meta' ")} {_HIT_SQL}")
def search_alias(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return _hits(s.search(chunks, docs, s.compile_query(spark, {0: "ATTION, 12!"}, aliases={"attion": ["thanedble"]})))


_ITEMS_SQL = rf"SELECT DISTINCT item_id AS qid, term, false AS is_prefix FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) WHERE NOT regexp_matches(term, '^[0-9]+$')"


@_query(f"WITH {_scored(_ITEMS_SQL)}, {_ranked('''kind <> 'meta' ''', limit=10)} SELECT qid, document_id, chunk_no, pos, round(rank, 9) AS rank FROM ranked")
def search_batch(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    terms = s.compile_queries(corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")), aliases={}, normalized=True)
    return s.search(chunks, docs, terms, params=s.SearchParams(limit=10)).select("qid", "document_id", "chunk_no", "pos", F.round("rank", 9).alias("rank"))


@_query(f"WITH {_CHUNKS}, {_POSTS} SELECT a.document_id, a.chunk_no, count(*) AS n FROM posts a JOIN posts b ON a.document_id = b.document_id AND a.chunk_no = b.chunk_no AND a.col = b.col AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY ALL")
def search_phrase(spark, sf_dir):
    return s.phrase(s.postings(corpus.chunks(spark, sf_dir)), ["of", "the"])


@_query(f"WITH {_CHUNKS}, {_POSTS} SELECT document_id, chunk_no FROM posts WHERE term IN ('the', 'of', 'in') AND col = 'text' GROUP BY ALL HAVING count(DISTINCT term) = 3")
def search_all_terms(spark, sf_dir):
    return s.all_terms(s.postings(corpus.chunks(spark, sf_dir)), ["the", "of", "in"], "text")


_LEAF = "SELECT qid, {n} AS leaf, p.document_id, p.chunk_no, sum(p.w) AS f FROM posts p JOIN w ON {on} GROUP BY ALL"
_LEAVES_SQL = f"""w AS (SELECT item_id AS qid, {_terms('text')} AS t FROM benchmark WHERE len({_terms('text')}) >= 6),
leaves AS (SELECT qid, 0 AS leaf, p.document_id, p.chunk_no, sum(p.w) AS f FROM posts p JOIN posts r ON r.document_id = p.document_id AND r.chunk_no = p.chunk_no AND r.col = p.col AND r.pos = p.pos + 1 JOIN w ON p.term = t[1] AND r.term = t[2] GROUP BY ALL
 UNION ALL {_LEAF.format(n=1, on="p.term = t[3]")} UNION ALL {_LEAF.format(n=2, on="p.term = t[4] AND p.col = 'text'")}
 UNION ALL {_LEAF.format(n=3, on="starts_with(p.term, t[5])")} UNION ALL {_LEAF.format(n=4, on="p.term = t[6]")}),
freq AS (SELECT qid, leaf, count(*) AS n_q FROM leaves GROUP BY ALL),
idf AS (SELECT qid, leaf, CASE WHEN ln((n_rows - n_q + 0.5) / (n_q + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_rows - n_q + 0.5) / (n_q + 0.5)) END AS idf FROM freq, stats),
part AS (SELECT l.*, idf * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * n_terms / avg_terms)) AS part FROM leaves l JOIN idf USING (qid, leaf) JOIN sizes USING (document_id, chunk_no), stats)"""


@_query(f"WITH {_CHUNKS}, {_POSTS}, {_STATS}, {_LEAVES_SQL} SELECT qid, document_id, chunk_no, round(-sum(part), 9) AS rank FROM part GROUP BY ALL HAVING bool_or(leaf IN (0, 1)) AND bool_or(leaf IN (2, 3)) AND NOT bool_or(leaf = 4)")
def search_expressions(spark, sf_dir):
    """For each benchmark item, a phrase or a word, and a word of the text or a prefix, but not a sixth word."""
    t = tx.index_tokens(F.col("text"))
    form = F.format_string('("%s %s" OR %s) AND (text : %s OR %s*) NOT %s', *[F.get(t, i) for i in range(6)])
    queries = corpus.table(spark, sf_dir, "benchmark").where(F.size(t) >= 6).select(F.col("item_id").alias("qid"), form.alias("query"))
    return expressions.search_expressions(s.index(corpus.chunks(spark, sf_dir)), queries, places=9).select("qid", "document_id", "chunk_no", "rank")


@_query(f"WITH {_DOCS}, {_CHUNKS}, {_POSTS} SELECT category, count(*) AS n FROM docs WHERE document_id IN (SELECT document_id FROM posts WHERE term = 'attion') GROUP BY ALL")
def documents_matching(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return catalog.category_counts(s.documents_matching(s.postings(chunks), docs, "attion"))


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('''kind <> 'meta' ''')} SELECT qid, document_id, array_to_string(list(chunk_no ORDER BY pos), ',') AS chunks, row_number() OVER (PARTITION BY qid ORDER BY min(pos)) AS group_pos FROM ranked GROUP BY qid, document_id")
def group_by_document(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    grouped = s.group_by_document(s.search(chunks, docs, _words(spark)))
    return grouped.withColumn("chunks", F.array_join(F.col("chunks").cast("array<string>"), ","))


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('''kind <> 'meta' ''')} SELECT r.document_id, r.chunk_no AS hit_no, c.chunk_no, c.kind FROM ranked r JOIN chunks c ON c.document_id = r.document_id AND c.chunk_no BETWEEN r.chunk_no - 2 AND r.chunk_no + 2 AND c.chunk_no <> r.chunk_no")
def neighbours(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return s.neighbours(s.search(chunks, docs, _words(spark)), chunks, 2).select("document_id", "hit_no", "chunk_no", "kind")


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('''kind <> 'meta' ''')} SELECT document_id, length(raw_text) AS n_chars, source_sha256 FROM docs WHERE document_id IN (SELECT document_id FROM ranked)")
def full_text(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    whole = s.full_text(s.search(chunks, docs, _words(spark)), docs)
    return whole.select("document_id", F.length("raw_text").alias("n_chars"), F.sha2("raw_text", 256).alias("source_sha256"))


@_query(f"WITH {_CHUNKS}, f AS (SELECT document_id, trim(string_split(section_path, ' > ')[1]) AS section, min(chunk_no) AS first_no FROM chunks WHERE kind <> 'meta' AND section_path IS NOT NULL GROUP BY ALL) SELECT document_id, array_to_string(list(section ORDER BY first_no, section), ',') AS sections FROM f GROUP BY ALL")
def top_sections(spark, sf_dir):
    return catalog.top_sections(corpus.chunks(spark, sf_dir)).select("document_id", F.array_join("sections", ",").alias("sections"))


@_query(f"WITH {_DOCS} SELECT document_id, indexed_at FROM docs WHERE category = 'en' ORDER BY indexed_at DESC, document_id DESC LIMIT 50")
def documents_by_recency(spark, sf_dir):
    return catalog.by_recency(corpus.documents(spark, sf_dir), 50, "en").select("document_id", "indexed_at")


@_query(
    f"""WITH {_DOCS}, {_CHUNKS}, newest AS (SELECT document_id, document_date, category FROM docs WHERE document_date >= '2024-03-01' ORDER BY document_date DESC, document_id LIMIT 200),
f AS (SELECT document_id, trim(string_split(section_path, ' > ')[1]) AS section, min(chunk_no) AS first_no FROM chunks WHERE kind <> 'meta' AND section_path IS NOT NULL GROUP BY ALL),
g AS (SELECT document_id, array_to_string(list(section ORDER BY first_no, section), ', ') AS sections FROM f GROUP BY ALL)
SELECT document_id, document_date, category, document_id || ' | ' || document_date || ' | ' || category || ' | ' || coalesce(sections, '—') AS line FROM newest LEFT JOIN g USING (document_id)"""
)
def list_docs(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    listed = catalog.list_docs(docs, chunks, 200, "2024-03-01")
    return listed.select("document_id", "document_date", "category", tx.index_line(F.col("document_id"), F.col("document_date"), F.col("category"), F.col("sections")).alias("line"))


@_query(f"WITH {_CHUNKS} SELECT document_id, chunk_no, kind, text FROM chunks WHERE kind <> 'meta' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY chunk_no) <= 20")
def document_chunks(spark, sf_dir):
    return catalog.document_chunks(corpus.chunks(spark, sf_dir), None, 20).select("document_id", "chunk_no", "kind", "text")


@_query(f"WITH {_DOCS} SELECT category, count(*) AS n FROM docs GROUP BY ALL")
def category_counts(spark, sf_dir):
    return catalog.category_counts(corpus.documents(spark, sf_dir))


@_query(f"WITH {_DOCS}, {_CHUNKS} SELECT category, count(*) AS n_chunks, round(avg(length(text)), 4) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM chunks JOIN docs USING (document_id) GROUP BY ALL")
def chunk_statistics(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return catalog.chunk_statistics(chunks, docs)


_RECENT_SQL = """fetched AS (SELECT * FROM docs ORDER BY indexed_at DESC, document_id DESC LIMIT {fetch}),
recent AS (SELECT *, row_number() OVER (ORDER BY indexed_at DESC, document_id DESC) AS doc_pos FROM fetched WHERE document_date >= '{cutoff}'),
rc AS (SELECT c.*, r.source_path, r.category, r.document_date, r.doc_pos, row_number() OVER (PARTITION BY c.document_id ORDER BY chunk_no) AS in_doc
 FROM chunks c JOIN recent r USING (document_id) WHERE c.kind <> 'meta' AND doc_pos <= {max_docs}),
recency AS (SELECT * FROM rc WHERE in_doc <= 2)"""


@_query(f"WITH {_DOCS}, {_CHUNKS}, {_RECENT_SQL.format(fetch=50, cutoff='2024-04-01', max_docs=20)} SELECT document_id, chunk_no, doc_pos, in_doc FROM recency")
def recency_chunks(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return catalog.recency_chunks(docs, chunks, "2024-04-01", 50, 20, 2).select("document_id", "chunk_no", "doc_pos", "in_doc")


_BUNDLE_SQL = """u AS (SELECT 0 AS src, pos, document_id, chunk_no, text, section_path, source_path, category, document_date FROM ranked
 UNION ALL SELECT 1, (doc_pos - 1) * 2 + in_doc, document_id, chunk_no, text, section_path, source_path, category, document_date FROM recency),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, chunk_no ORDER BY src, pos) AS rn FROM u) WHERE rn = 1),
n AS (SELECT * EXCLUDE (pos), row_number() OVER (ORDER BY src, pos) AS pos FROM o),
r AS (SELECT *, sum(length(text)) OVER (ORDER BY pos) AS used FROM n WHERE pos <= 20)
SELECT pos, CASE WHEN pos <= 5 THEN 'top' ELSE 'excerpt' END AS slot,
 '[' || pos || '] ' || source_path || ' | ' || document_date || ' | ' || category || ' | ' || coalesce(nullif(section_path, ''), '(no section)') || chr(10) || chr(10) || text AS body FROM r WHERE used <= 12000"""


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('''kind <> 'meta' AND document_date BETWEEN '2024-01-01' AND '2024-12-31' ''')}, {_RECENT_SQL.format(fetch=5, cutoff='2024-01-01', max_docs=3)}, {_BUNDLE_SQL}")
def baseline_bundle(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return retrieval.baseline(chunks, docs, _words(spark), "2024-12-31").select("pos", "slot", "body")


_TOOL_SQL = """e AS (SELECT pos, document_id || '#chunk_' || chunk_no || ' | ' || document_date || ' | ' || category || ' | ' || coalesce(section_path, '') || chr(10) || chr(10) || text AS x FROM ranked),
w AS (SELECT pos, x, {budget} - coalesce(sum(length(x)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e)
SELECT pos, CASE WHEN length(x) <= room THEN x WHEN room <= 15 THEN left(x, CAST(room AS BIGINT))
 ELSE left(x, CAST(floor((room - 15) / 2.0) AS BIGINT)) || chr(10) || '…[truncated]…' || chr(10) || right(x, CAST(floor((room - 15) / 2.0) AS BIGINT)) END AS excerpt FROM w WHERE room > 0"""


@_query(f"WITH {_scored(_WORDS_SQL)}, {_ranked('''kind <> 'meta' ''')}, {_TOOL_SQL.format(budget=2000)}")
def tool_excerpts(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    return bundle.tool_excerpts(s.search(chunks, docs, _words(spark)), 2000).select("pos", "excerpt")


@_query(f"WITH {_MESSAGES}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM messages WHERE role IN ('user', 'assistant') AND tool_calls_json IS NULL) SELECT session_id, seq, role, content FROM v WHERE n BETWEEN 2 AND 4")
def message_page(spark, sf_dir):
    return dialogue.page(corpus.messages(spark, sf_dir), 1, 3).select("session_id", "seq", "role", "content")


@_query(f"WITH {_MESSAGES} SELECT session_id, count(*) FILTER (role = 'user') AS turns FROM messages GROUP BY ALL")
def user_turns(spark, sf_dir):
    return dialogue.user_turns(corpus.messages(spark, sf_dir))


@_query(f"WITH {_MESSAGES}, v AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS n FROM messages WHERE role = 'assistant' AND tool_calls_json IS NULL) SELECT session_id, seq, content FROM v WHERE n = 1")
def last_assistant(spark, sf_dir):
    return dialogue.last_assistant(corpus.messages(spark, sf_dir))


_WINDOW_SQL = """back AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS u FROM messages),
start AS (SELECT session_id, max(seq) FILTER (role = 'user' AND u = {turns}) AS s FROM back GROUP BY ALL),
windowed AS (SELECT m.* FROM messages m JOIN start USING (session_id) WHERE s IS NULL OR seq >= s)"""


@_query(f"WITH {_MESSAGES}, {_WINDOW_SQL.format(turns=2)} SELECT session_id, seq, role FROM windowed")
def turn_window(spark, sf_dir):
    return dialogue.turn_window(corpus.messages(spark, sf_dir), 2).select("session_id", "seq", "role")


def _sessions(messages: DataFrame) -> DataFrame:
    n = F.count("*")
    return messages.groupBy("session_id").agg(F.when(n > 2, F.concat(F.lit("so far "), n.cast("string"))).alias("summary"), F.when(F.max("session_id") % 3 == 0, "pinned").when(F.max("session_id") % 3 == 1, "archived").otherwise("active").alias("status"), F.max(F.length("content")).alias("updated_at"))


_SESSIONS = "sessions AS (SELECT session_id, CASE WHEN count(*) > 2 THEN 'so far ' || count(*) END AS summary, CASE session_id % 3 WHEN 0 THEN 'pinned' WHEN 1 THEN 'archived' ELSE 'active' END AS status, max(length(content)) AS updated_at FROM messages GROUP BY session_id)"


@_query(f"WITH {_MESSAGES}, {_SESSIONS}, {_WINDOW_SQL.format(turns=1)} SELECT session_id, -2 AS ord, 'system' AS role, 'Be brief.' AS content FROM sessions UNION ALL SELECT session_id, -1, 'system', summary FROM sessions WHERE summary IS NOT NULL UNION ALL SELECT session_id, seq, role, content FROM windowed")
def context_assembly(spark, sf_dir):
    m = corpus.messages(spark, sf_dir)
    return dialogue.context(m, _sessions(m), "Be brief.", 1)


@_query(f"WITH {_MESSAGES}, {_SESSIONS} SELECT session_id, CASE WHEN status = 'pinned' THEN 'active' ELSE status END AS status, updated_at FROM sessions WHERE status IN ('active', 'pinned')")
def list_sessions(spark, sf_dir):
    return dialogue.list_sessions(_sessions(corpus.messages(spark, sf_dir))).select("session_id", "status", "updated_at")


@_query(
    f"""WITH {_MESSAGES}, {_WINDOW_SQL.format(turns=1)}, i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS idx FROM messages),
due AS (SELECT session_id FROM messages GROUP BY ALL HAVING count(*) FILTER (role = 'user') > 0 AND count(*) FILTER (role = 'user') % 2 = 0), f AS (SELECT session_id, min(seq) AS from_seq FROM windowed GROUP BY ALL)
SELECT session_id, seq, idx FROM i JOIN due USING (session_id) JOIN f USING (session_id) WHERE seq < from_seq AND idx >= session_id % 2"""
)
def compression_slice(spark, sf_dir):
    m = corpus.messages(spark, sf_dir)
    cursors = m.select("session_id").distinct().withColumn("cursor", F.col("session_id") % 2)
    return dialogue.to_compress(m, cursors, 1, 2).select("session_id", "seq", "idx")


@_query(
    f"""WITH {_MESSAGES}, i AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS idx, count(*) FILTER (role = 'user') OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM messages),
due AS (SELECT session_id, nth AS n, row_number() OVER (PARTITION BY session_id ORDER BY nth) - 1 AS slice FROM i WHERE role = 'user' AND nth % 2 = 0 AND nth >= 2),
w AS (SELECT d.session_id, d.slice, i.idx AS upto FROM due d JOIN i ON i.session_id = d.session_id AND i.role = 'user' AND i.nth = d.n - 1)
SELECT i.session_id, min(slice) AS slice, idx, seq, role FROM i JOIN w ON w.session_id = i.session_id AND upto > idx GROUP BY ALL"""
)
def compression_slices(spark, sf_dir):
    """Slices of each session for windows of two turns that are due at every second."""
    return dialogue.compression_slices(corpus.messages(spark, sf_dir), 2, 2).select("session_id", "slice", "idx", "seq", "role")


@_query(f"WITH {_MESSAGES} SELECT session_id, string_agg(CASE WHEN tool_calls_json IS NOT NULL THEN '[assistant]: ' || coalesce(content, '') || chr(10) || '[tool calls]: kb.search_chunks' ELSE '[' || role || ']: ' || coalesce(content, '') END, chr(10) ORDER BY seq) AS history FROM messages GROUP BY ALL")
def serialized_history(spark, sf_dir):
    return dialogue.serialize(corpus.messages(spark, sf_dir))


@_query(f"WITH {_MESSAGES} SELECT session_id, seq, 0 AS call_no, 'kb.search_chunks' AS name, true AS allowed FROM messages WHERE tool_calls_json IS NOT NULL")
def tool_calls(spark, sf_dir):
    return dialogue.call_budget(corpus.messages(spark, sf_dir), 5)


@_query(
    f"""WITH {_CHUNKS} SELECT document_id, chunk_no, left(sha256(document_id || '|' || coalesce(section_path, '') || '|' || kind || '|' || text), 32) AS chunk_id,
 CASE WHEN length(text) <= 80 THEN text WHEN 80 <= 15 THEN left(text, 80) ELSE left(text, 32) || chr(10) || '…[truncated]…' || chr(10) || right(text, 32) END AS middle, trim(string_split(section_path, ' > ')[1]) AS top FROM chunks"""
)
def chunk_functions(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    return c.select("document_id", "chunk_no", tx.chunk_id(F.col("document_id"), F.col("section_path"), F.col("kind"), F.col("text")).alias("chunk_id"), tx.cut_middle(F.col("text"), F.lit(80)).alias("middle"), tx.top_section(F.col("section_path")).alias("top"))


@_query(
    """SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS first_lines, left(sha256(text), 32) AS document_id,
 CASE WHEN length(text) <= 200 THEN text WHEN position(chr(10) IN reverse(left(text, 200))) > 0 AND 200 - position(chr(10) IN reverse(left(text, 200))) > 0 THEN left(text, 200 - position(chr(10) IN reverse(left(text, 200)))) ELSE left(text, 200) END AS first_chars FROM documents"""
)
def text_limits(spark, sf_dir):
    d = corpus.table(spark, sf_dir, "documents")
    t = F.col("text")
    return d.select("doc_id", tx.first_lines(t, 3).alias("first_lines"), tx.document_id(t).alias("document_id"), tx.first_chars(t, 200).alias("first_chars"))


@_query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(text, '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$')), ' ') AS tokens FROM documents")
def query_tokens(spark, sf_dir):
    return corpus.table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.query_tokens(F.col("text")), " ").alias("tokens"))


@_query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS iso FROM events"""
)
def iso_dates(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events")
    written = F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyyMMdd")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "d/M/yy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return e.select("event_id", control.iso_date(written).alias("iso"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as Markdown files: title, category and date lines in front of the text; every ninth without a category, every eleventh without a date."""
    d = corpus.documents(spark, sf_dir)
    names = F.array(*[F.lit(c) for c in ("Анализы", "Диагноз", "Выписка")])
    named = F.when(F.col("document_id") % 9 == 0, "").otherwise(F.concat(F.lit("**Категория:** "), F.get(names, (F.col("document_id") % 3).cast("int")), F.lit("\n")))
    dated = F.when(F.col("document_id") % 11 == 0, "").otherwise(F.concat(F.lit("**Дата:** "), F.col("document_date"), F.lit("\n")))
    title = F.concat(F.lit("# part "), (F.col("document_id") % 5).cast("string"), F.lit("\n"))
    return d.select(F.concat("source_path", F.lit("_"), F.col("document_id").cast("string"), F.lit(".md")).alias("source_path"), F.concat(title, named, dated, F.lit("\n"), F.col("raw_text")).alias("raw_content"), F.col("document_id").alias("key"), "document_date")


@_query(
    f"""WITH {_DOCS} SELECT document_id AS key, CASE WHEN document_id % 9 = 0 THEN NULL ELSE ['Анализы', 'Диагноз', 'Выписка'][CAST(document_id % 3 AS INTEGER) + 1] END AS category,
 CASE WHEN document_id % 11 = 0 THEN NULL ELSE document_date END AS found_date, CASE WHEN document_id % 9 = 0 THEN 'E_NO_SCHEMA_ID' WHEN document_id % 11 = 0 THEN 'E_NO_DOCUMENT_DATE' END AS error_code FROM docs"""
)
def control_fields(spark, sf_dir):
    read = ingest.read_controls(_files(spark, sf_dir).withColumnRenamed("document_date", "expected"))
    return read.select("key", "category", F.col("document_date").alias("found_date"), "error_code")


@_query()
def ingest_chunks(spark, sf_dir):
    _, chunks, _ = ingest.ingest(_files(spark, sf_dir).select("source_path", "raw_content"), "2025-01-01")
    return chunks


@_query()
def page_blocks(spark, sf_dir):
    """Blocks and section paths of the pages' text, their headings and paragraphs written as Markdown."""
    p = corpus.table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?i)<h([1-6])[^>]*>", "\n\n\u0001$1 ")
    for k in range(1, 7):
        body = F.replace(body, F.lit(f"\u0001{k} "), F.lit("#" * k + " "))
    body = F.regexp_replace(F.regexp_replace(body, r"(?i)</(p|h[1-6]|div|article)>|<p[^>]*>|<br\s*/?>", "\n\n"), r"<[^>]+>", "")
    blocks = ingest.read_blocks(p.select(F.col("page_id").alias("document_id"), body.alias("body")))
    return ingest.section_paths(blocks).select(F.col("document_id").alias("page_id"), "pos", "type", "content", "subtype", "section_path", "heading")


@_query(f"WITH {_CHUNKS} SELECT document_id, chunk_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(heading, '') || ' ' || coalesce(section_path, '') || ' ' || kind), ' '), lambda t: t), lambda t: length(t) >= 3 AND NOT regexp_matches(t, '[0-9]')))), ' ') AS tags FROM chunks")
def chunk_tags(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    return c.select("document_id", "chunk_no", tx.tags([F.col("heading"), F.col("section_path"), F.col("kind")]).alias("tags"))


_LEVELS = ", ".join(f"max(CASE WHEN h AND level = {k} THEN pos END) OVER w AS p{k}, last_value(CASE WHEN h AND level = {k} THEN content END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3))


@_query(
    f"""WITH {_CHUNKS}, b AS (SELECT document_id, chunk_no AS pos, chunk_no % 4 = 0 AS h, 1 + (chunk_no // 4) % 3 AS level, text AS content FROM chunks),
x AS (SELECT *, {_LEVELS} FROM b WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
y AS (SELECT document_id, pos, content, t1 AS a, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END AS b, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END AS c FROM x WHERE NOT h)
SELECT document_id, pos, content, concat_ws(' > ', a, b, c) AS section_path, coalesce(c, b, a) AS heading FROM y"""
)
def section_paths(spark, sf_dir):
    """Lines as blocks: every fourth line is a heading of level 1 to 3."""
    c = corpus.chunks(spark, sf_dir)
    n = F.col("chunk_no")
    blocks = c.select("document_id", n.alias("pos"), F.when(n % 4 == 0, "heading").otherwise("paragraph").alias("type"), (1 + F.floor(n / 4) % 3).alias("level"), F.col("text").alias("content"))
    return ingest.section_paths(blocks).select("document_id", "pos", "content", "section_path", "heading")


def _changed(docs: DataFrame) -> DataFrame:
    return docs.where("document_id % 3 = 0").withColumns({"document_id": F.when(F.col("document_id") % 2 == 0, F.col("document_id")).otherwise(-F.col("document_id")), "category": F.lit("new")})


@_query(f"WITH {_DOCS}, fresh AS (SELECT CASE WHEN document_id % 2 = 0 THEN document_id ELSE -document_id END AS document_id, 'new' AS category FROM docs WHERE document_id % 3 = 0) SELECT document_id, category FROM docs WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_documents(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return store.upsert(docs, _changed(docs), ["document_id"]).select("document_id", "category")


@_query(f"WITH {_CHUNKS} SELECT document_id, chunk_no, text FROM chunks WHERE document_id % 2 = 1 UNION ALL SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_no) - 1, 'new ' || text FROM chunks WHERE document_id % 2 = 0 AND kind <> 'meta'")
def replace_chunks(spark, sf_dir):
    chunks = corpus.chunks(spark, sf_dir)
    new = chunks.where("document_id % 2 = 0 AND kind <> 'meta'").withColumn("text", F.concat(F.lit("new "), "text"))
    return store.replace_chunks(chunks, new).select("document_id", "chunk_no", "text")


@_query(f"WITH {_DOCS}, {_CHUNKS}, gone AS (SELECT document_id FROM docs WHERE category = 'fr') SELECT 'documents' AS name, count(*) AS n FROM docs WHERE document_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN (SELECT * FROM gone)")
def delete_documents(spark, sf_dir):
    chunks, docs = _data(spark, sf_dir)
    left = store.delete({"documents": docs, "chunks": chunks}, docs.where("category = 'fr'"), "document_id")
    return left["documents"].agg(F.lit("documents").alias("name"), F.count("*").alias("n")).unionByName(left["chunks"].agg(F.lit("chunks").alias("name"), F.count("*").alias("n")))


@_query(f"WITH {_CHUNKS} SELECT left(sha256(document_id || '|' || coalesce(section_path, '') || '|' || kind || '|' || text), 32) AS chunk_id, count(*) AS n FROM chunks GROUP BY ALL HAVING count(*) > 1")
def repeated_chunks(spark, sf_dir):
    c = corpus.chunks(spark, sf_dir)
    return store.repeated_chunks(c.select(tx.chunk_id(F.col("document_id"), F.col("section_path"), F.col("kind"), F.col("text")).alias("chunk_id")))


@_query("SELECT min(doc_id) AS document_id, sha256(text) AS source_sha256, count(*) AS n FROM documents GROUP BY sha256(text)")
def dedup_by_hash(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    return docs.groupBy("source_sha256").agg(F.min("document_id").alias("document_id"), F.count("*").alias("n"))


@_query(
    """WITH old AS (SELECT conv_id AS session_id, count(*) AS updated_at, min(turn) AS created_at FROM conversations WHERE conv_id % 3 <> 0 GROUP BY ALL),
new AS (SELECT conv_id AS session_id, count(*) + 100 AS updated_at, min(turn) + 7 AS created_at FROM conversations WHERE conv_id % 2 = 0 GROUP BY ALL)
SELECT * FROM old WHERE session_id NOT IN (SELECT session_id FROM new) UNION ALL SELECT n.session_id, n.updated_at, coalesce(o.created_at, n.created_at) FROM new n LEFT JOIN old o USING (session_id)"""
)
def merge_sessions(spark, sf_dir):
    c = corpus.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    old = c.where("session_id % 3 <> 0").groupBy("session_id").agg(F.count("*").alias("updated_at"), F.min("turn").alias("created_at"))
    new = c.where("session_id % 2 = 0").groupBy("session_id").agg((F.count("*") + 100).alias("updated_at"), (F.min("turn") + 7).alias("created_at"))
    return store.merge_sessions(old, new)


@_query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY ALL")
def date_window(spark, sf_dir):
    e = corpus.table(spark, sf_dir, "events").where(F.date_format("ts", "yyyy-MM-dd").between("2024-01-05", "2024-01-20"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
