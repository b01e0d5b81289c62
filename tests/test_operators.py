import sqlite3

import pytest
from pyspark.sql import functions as F

from corvidex.operators import bundle, catalog, dialogue, ingest, search as s, store
from corvidex.plans import retrieval
from corvidex.sources import corpus
from corvidex.streaming import inbox

CHUNKS = "document_id string, chunk_no int, kind string, text string, section_path string, heading string, tags_text string"
DOCS = "document_id string, source_path string, category string, document_date string, indexed_at string, raw_text string"
# Weights under which the expected scores below were taken from SQLite's full-text index.
OLD = {"text": 1.0, "heading": 2.5, "section_path": 2.0, "tags_text": 3.5}


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("d1", 0, "section", "острая боль в животе справа, температура", "жалобы > общие", "общие", "жалобы боль"),
        ("d1", 1, "meta", "врач: боль, живот", "врач", "врач", "врач"),
        ("d1", 2, "section", "температура нормальная и стул обычный", None, None, None),
        ("d2", 0, "table", "живот мягкий | болит | справа", "осмотр", "осмотр", "осмотр"),
        ("d2", 1, "section", "рекомендации: покой и диета", "осмотр > план", "план", "план"),
        ("d2", 2, "fact", "температура: 36 6", "осмотр > план", "план", "план"),
        ("d3", 0, "section", "without a word of it", None, None, "other"),
        ("d3", 1, "section", "the pain in the belly, the pain", "intro", "intro", "pain"),
    ]
    docs = [(f"d{i}", f"d{i}.md", "Анализы" if i % 2 else "Диагноз", f"2024-0{i}-01", f"2025-0{4 - i}-01", "raw") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(docs, DOCS)


def ranks(found):
    return {(r.document_id, r.chunk_no): r["rank"] for r in found.collect()}


@pytest.mark.parametrize("query, match", [("боль живот", "боль OR живот"), ("температура", "температур*"), ("the pain", "the OR pain"), ("план осмотр диета", "план OR осмотр OR диета")])
def test_bm25_equals_sqlite(spark, small, query, match):
    chunks, _ = small
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, heading, section_path, tags_text)")
    keys = []
    for r in chunks.collect():
        keys.append((r.document_id, r.chunk_no))
        db.execute("INSERT INTO f VALUES (?, ?, ?, ?)", (r.text, r.heading, r.section_path, r.tags_text))
    expected = {keys[i - 1]: x for i, x in db.execute("SELECT rowid, bm25(f, 1.0, 2.5, 2.0, 3.5) FROM f WHERE f MATCH ?", (match,))}
    terms = [(0, t.rstrip("*"), t.endswith("*")) for t in match.split(" OR ")]
    terms = spark.createDataFrame(terms, "qid long, term string, is_prefix boolean")
    got = ranks(s.scores(s.parts(s.index(chunks), terms, s.SearchParams(OLD)), terms))
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_compiled_query_and_empty_query(spark, small):
    terms = {(r.qid, r.term, r.is_prefix) for r in s.compile_query(spark, {1: "Температура ТТГ 12 pain", 2: " !? "}).collect()}
    assert terms == {(1, "температура", True), (1, "ттг", False), (1, "tsh", False), (1, "pain", False)}
    chunks, docs = small
    assert s.search(chunks, docs, s.compile_query(spark, {2: " !? "})).count() == 0


def test_statistics_ignore_filters(spark, small):
    chunks, docs = small
    terms = s.compile_query(spark, {0: "боль живот температура"})
    free = ranks(s.search(chunks, docs, terms, s.Filters(exclude_meta=False), s.SearchParams(meta_factor=1.0, limit_per_document=0)))
    cut = ranks(s.search(chunks, docs, terms, s.Filters(document_id="d2"), s.SearchParams(meta_factor=1.0)))
    assert cut and all(free[k] == v and k[0] == "d2" for k, v in cut.items())


def test_penalty_cap_and_order(spark, small):
    chunks, docs = small
    terms = s.compile_query(spark, {0: "боль живот температура врач"})
    plain = s.search(chunks, docs, terms, s.Filters(exclude_meta=False), s.SearchParams(meta_factor=1.0)).orderBy("pos").collect()
    low = s.search(chunks, docs, terms, s.Filters(exclude_meta=False), s.SearchParams(meta_factor=0.001)).orderBy("pos").collect()
    assert low[-1].kind == "meta" and plain[-1].kind != "meta"
    one = s.search(chunks, docs, terms, s.Filters(exclude_meta=False), s.SearchParams(limit_per_document=1)).collect()
    assert len({r.document_id for r in one}) == len(one)
    assert [r.pos for r in plain] == list(range(1, len(plain) + 1)) and all(a["rank"] <= b["rank"] for a, b in zip(plain, plain[1:], strict=False))


@pytest.mark.parametrize(
    "filters, left",
    [
        (s.Filters(category="Диагноз"), {"d1", "d2"}), (s.Filters(category="Диагноз", category_mode="hard"), {"d2"}), (s.Filters(kinds=("fact",)), {"d2"}),
        (s.Filters(from_date="2024-02-01"), {"d2"}), (s.Filters(to_date="2024-01-31"), {"d1"}), (s.Filters(section_prefix="Осмотр"), {"d2"}),
    ],
)
def test_filters(spark, small, filters, left):
    chunks, docs = small
    assert {r.document_id for r in s.search(chunks, docs, s.compile_query(spark, {0: "температура живот"}), filters).collect()} == left


def test_phrase_and_all_terms(spark, small):
    posts = s.postings(small[0])
    assert {(r.document_id, r.chunk_no, r.n) for r in s.phrase(posts, ["the", "pain"]).collect()} == {("d3", 1, 2)}
    assert {(r.document_id, r.chunk_no) for r in s.all_terms(posts, ["живот", "болит"]).collect()} == {("d2", 0)}


def test_retrieve_with_neighbours_and_text(spark, small):
    found = retrieval.retrieve(*small, retrieval.Request("живот болит", neighbour_width=1, with_full_text=True))
    assert {(r.document_id, r.hit_no, r.chunk_no) for r in found.neighbours.collect()} >= {("d2", 0, 1)}
    assert {r.raw_text for r in found.full_text.collect()} == {"raw"} and found.documents.first().group_pos == 1


def test_written_index_answers_alike_and_is_pruned(spark, small, tmp_path):
    chunks, docs = small
    s.write_index(chunks, str(tmp_path))
    held = s.read_index(spark, str(tmp_path))
    request = retrieval.Request("температура живот")
    fresh, stored = (sorted(map(tuple, retrieval.retrieve(chunks, docs, request, h).chunks.collect())) for h in (None, held))
    assert fresh == stored and fresh
    plan = s.restrict(held.postings, [("живот", False), ("темпер", True)])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(In(term, [живот])" in plan or "PushedFilters: [Or(EqualTo(term,живот)" in plan


def test_catalog(spark, small):
    chunks, docs = small
    assert {r.document_id: r.sections for r in catalog.list_docs(docs, chunks, 3).collect()} == {"d1": ["жалобы"], "d2": ["осмотр"], "d3": ["intro"]}
    assert [r.document_id for r in catalog.by_recency(docs, 2).collect()] == ["d1", "d2"]
    assert [r.chunk_no for r in catalog.document_chunks(chunks, "d1", 5).collect()] == [0, 2]
    assert {(r.document_id, r.chunk_no) for r in catalog.recency_chunks(docs, chunks, "2024-02-01", 2, 3, 2).collect()} == {("d2", 0), ("d2", 1)}
    assert [r.chunk_no for r in catalog.section_filter(chunks, "d2", ["ОСМОТР"]).collect()] == [0, 1, 2]


def bundle_rows(spark, rows):
    return spark.createDataFrame([(0, i + 1, "d", n, t, "s" if n % 2 else None, "p.md", c, "2024-01-01") for i, (n, t, c) in enumerate(rows)], "qid int, pos int, document_id string, chunk_no int, text string, section_path string, source_path string, category string, document_date string")


def test_bundle(spark):
    first = bundle_rows(spark, [(1, "a\nb\nc", "X"), (2, "d", "Y")])
    second = bundle_rows(spark, [(2, "again", "Y"), (3, "e" * 10, "Y"), (4, "f" * 200, "Y")])
    params = bundle.BundleParams(max_chunks=4, max_chars=20, top_chunks=1, top_lines=1, max_lines=5, category_lines={"X": 2}, max_chunk_chars=10)
    got = [(r.pos, r.slot, r.body) for r in bundle.build(bundle.merge(first, second, ["document_id", "chunk_no"]), params).orderBy("pos").collect()]
    head = "p.md | 2024-01-01"
    assert got == [(1, "top", f"[1] {head} | X | s\n\na"), (2, "excerpt", f"[2] {head} | Y | (no section)\n\nd"), (3, "excerpt", f"[3] {head} | Y | s\n\n" + "e" * 10)]


@pytest.mark.parametrize("budget", [10, 40, 60, 90, 120, 400])
def test_tool_excerpts_equal_the_loop(spark, budget):
    rows = [(1, "x" * 30, "A"), (2, "y" * 5, "A"), (3, "z" * 50, "B")]
    got = [r.excerpt for r in bundle.tool_excerpts(bundle_rows(spark, rows), budget).orderBy("pos").collect()]
    used, expected, mark = 0, [], "\n…[truncated]…\n"
    for n, t, c in rows:
        e = f"d#chunk_{n} | 2024-01-01 | {c} | {'s' if n % 2 else ''}\n\n{t}"
        room = budget - used
        if room <= 0:
            break
        if len(e) > room:
            half = (room - len(mark)) // 2
            expected.append(e[:room] if room <= len(mark) else e[:half] + mark + e[len(e) - half :])
            break
        expected.append(e)
        used += len(e)
    assert got == expected
    text = bundle.tool_result(bundle.tool_excerpts(bundle_rows(spark, rows), budget)).first().result
    assert text.startswith("## Top Matches\n\n" + expected[0]) and ("## Additional Matches" in text) == (len(expected) > 1)


def messages(spark, roles):
    rows = [(1, i + 1, r, f"m{i}", '[{"id":"1","name":"kb.search_chunks","arguments":{"q":1}}]' if r == "call" else ("not json" if r == "bad" else None)) for i, r in enumerate(roles)]
    rows = [(a, b, "assistant" if c in ("call", "bad") else c, d, e) for a, b, c, d, e in rows]
    return spark.createDataFrame(rows, "session_id long, seq int, role string, content string, tool_calls_json string")


@pytest.mark.parametrize("turns", [0, 1, 2, 3, 9])
def test_turn_window(spark, turns):
    roles = ["system", "user", "assistant", "user", "call", "tool", "assistant", "user"]
    users = [i for i, r in enumerate(roles) if r == "user"]
    start = len(roles) if turns <= 0 else users[-turns] if turns <= len(users) else 0
    got = sorted(r.seq for r in dialogue.turn_window(messages(spark, roles), turns).collect())
    assert got == list(range(start + 1, len(roles) + 1))


def test_dialogue(spark):
    m = messages(spark, ["user", "call", "tool", "assistant", "bad"])
    assert [r.seq for r in dialogue.page(m, 1, 5).orderBy("seq").collect()] == [4]
    assert dialogue.last_assistant(m).first().content == "m3" and dialogue.user_turns(m).first().turns == 1
    assert dialogue.serialize(m).first().history == "[user]: m0\n[assistant]: m1\n[tool calls]: kb.search_chunks\n[tool result]: m2\n[assistant]: m3\n[assistant]: m4"
    assert [(r.call_no, r.allowed) for r in dialogue.call_budget(m, 0).collect()] == [(0, False)]
    long = messages(spark, ["user", "assistant"] * 4)
    cursor = spark.createDataFrame([(1, 2)], "session_id long, cursor int")
    assert sorted(r.seq for r in dialogue.to_compress(long, cursor, 3, 2).collect()) == []
    assert sorted(r.seq for r in dialogue.to_compress(long, cursor, 1, 2).collect()) == [3, 4, 5, 6]
    assert dialogue.to_compress(long, cursor, 1, 3).count() == 0
    people = spark.createDataFrame([("A", 3, "f", "2000-01-01"), (" ", 3, "f", "x"), ("B", None, "m", "x")], "name string, age int, sex string, date_of_birth string")
    assert [r.is_complete for r in dialogue.profile_complete(people).collect()] == [True, False, False]


FILE = """# Отчёт
**Категория:** Анализы
**Дата:** 05.03.2024

## Пациент
Иванов

## Кровь
**Общий анализ:**

| показатель | значение |
|---|---|
| ТТГ | 2 |

**Вывод**: норма

### Детали
текст

## Итог
**Хвост**
"""


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_path string, raw_content string")


def test_ingest(spark):
    same_chunks = "**Категория:** Диагноз\n**Дата:** 2024-01-01\n\nа\n\nа\n"
    got = ingest.ingest(files(spark, ("a.md", FILE), ("b.md", FILE), ("c.md", "x\n**Дата:** 01.01.2024"), ("d.md", "категория: анализы\nx"), ("e-20240101.md", "категория: анализы"), ("f.md", same_chunks)), "2025-01-01")
    documents, chunks, rejects = ([r.asDict() for r in df.collect()] for df in got)
    assert len(documents) == 1 and documents[0]["category"] == "Анализы" and documents[0]["document_date"] == "2024-03-05"
    rows = [(c["chunk_no"], c["kind"], c["text"], c["section_path"]) for c in sorted(chunks, key=lambda c: c["chunk_no"])]
    assert rows == [
        (0, "section", "дата: 05.03.2024", "отчет"),
        (1, "meta", "иванов", "отчет > пациент"),
        (2, "table", "общий анализ:\nпоказатель | значение\nттг | 2", "отчет > кровь"),
        (3, "fact", "вывод: норма", "отчет > кровь"),
        (4, "section", "текст", "отчет > кровь > детали"),
        (5, "section", "хвост", "отчет > итог"),
    ]
    assert chunks[0]["tags_text"] and len(chunks[0]["chunk_id"]) == 32
    codes = {r["source_path"]: r["error_code"] for r in rejects}
    assert codes == {"c.md": "E_NO_SCHEMA_ID", "d.md": "E_NO_DOCUMENT_DATE", "e-20240101.md": "E_EMPTY_CHUNKS", "f.md": "E_DUPLICATE_CHUNK"}


@pytest.mark.parametrize("most", [3, 5, 8, 100])
def test_split_long_equals_the_loop(spark, most):
    text = "aaa\n\nbb\n\n\n\ncccc\n\nd\n\neeeeeeeee"
    parts, current = [], []
    for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if current and sum(map(len, current)) + len(p) > most:
            parts.append("\n\n".join(current))
            current = []
        current.append(p)
    parts.append("\n\n".join(current))
    got = spark.createDataFrame([(text,)], "t string").select(ingest.split_long(F.col("t"), most).alias("x")).first().x
    assert got == (parts if len(text) > most else [text])


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, store.delete({"t": old}, new, "id")["t"].collect())) == [(1, "a")]
    assert store.last_of_each(new.union(new.limit(1)), ["id"], "v").count() == 2
    m = spark.createDataFrame([(1, 5, "x"), (2, 1, "y")], "session_id int, seq int, content string")
    n = spark.createDataFrame([(1, 7, "p"), (1, 9, "q")], "session_id int, seq int, content string")
    assert sorted(map(tuple, store.replace_messages(m, n).collect())) == [(1, 1, "p"), (1, 2, "q"), (2, 1, "y")]


def test_tools(spark, small):
    assert retrieval.check_search_arguments({"query": " "}) == "query is required"
    assert retrieval.check_search_arguments({"query": "x", "limit": True}) and retrieval.check_search_arguments({"query": "x", "limit": 1, "from_date": "2024-02-01", "to_date": "2024-01-01"})
    assert retrieval.search_tool(*small, {"query": "живот", "limit": 3}).startswith("## Top Matches")
    assert "No matches" in retrieval.search_tool(*small, {"query": "неттакого", "limit": 3})
    assert "d2#chunk_1" in retrieval.document_tool(*small, "d2", ["осмотр"]).first().result


def test_files_versions_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(FILE)
    (tmp_path / "in/skip.txt").write_text("x")
    read = corpus.markdown_files(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in read.collect()] == [("a.md", FILE)]
    seen = []
    stream = inbox.watch(spark, str(tmp_path / "in"), lambda n, d, c, r: seen.append((d.count(), c.count(), r.count())), str(tmp_path / "cp"), "2025-01-01")
    stream.awaitTermination(120)
    assert seen == [(1, 6, 0)]
