"""The store of documents, chunks and index: what a change rewrites, whole versions, merges, repeated batches."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from corvidex.operators import constraints, library as lib, search as s, segments
from corvidex.sources.versions import Conflict
from corvidex.streaming import inbox

DOCS = "document_id string, source_path string, source_sha256 string, category string, indexed_at string, document_date string, raw_text string"
CHUNKS = "document_id string, chunk_no int, chunk_id string, kind string, text string, section_path string, heading string, tags_text string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


def rows(ids, version=0):
    r = random.Random(version)
    docs = [(i, f"{i}.md", f"sha{i}", "en", "2025-01-01", "2024-01-01", f"{i} v{version}") for i in ids]
    chunks = [(i, 10 * k, f"{i}-{k}-{version}", "section", " ".join(r.choice(WORDS) for _ in range(5)), None, f"v{version}", None) for i in ids for k in range(3)]
    return docs, chunks


def frames(spark, ids, version=0):
    docs, chunks = rows(ids, version)
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(chunks, CHUNKS)


def files(path):
    return set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))


def scored(held, spark):
    terms = spark.createDataFrame([(0, "alpha", False), (1, "be", True)], "qid long, term string, is_prefix boolean")
    return sorted(tuple(r) for r in s.scores(s.parts(held, terms), terms).collect())


def test_change_rewrites_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "kb")
    store = lib.open_library(spark, root, 16)
    ids = [f"d{i}" for i in range(100)]
    first = lib.put(store, *frames(spark, ids))
    before = dict(first.tables["chunks"]["buckets"])
    old = files(root)
    second = lib.put(store, *frames(spark, ["d1", "new"], 1))
    after = second.tables["chunks"]["buckets"]
    touched = {r.b for r in spark.createDataFrame([("d1",), ("new",)], "k string").select(F.pmod(F.xxhash64("k"), F.lit(16)).cast("string").alias("b")).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched and old <= files(root)
    new = {f for f in files(root) - old if f"{os.sep}chunks{os.sep}" in f}
    assert 1 <= len(new) <= 2 * len(touched)
    got = {(r.document_id, r.chunk_no, r.heading) for r in store.read("chunks").collect()}
    assert got == {(i, k, "v1" if i in ("d1", "new") else "v0") for i in [*ids, "new"] for k in range(3)}
    # A reader of the first version still sees all of it.
    assert {r.raw_text for r in store.read("documents", first).collect()} == {f"{i} v0" for i in ids}


def test_remove_and_lookup(spark, tmp_path):
    store = lib.open_library(spark, str(tmp_path / "kb"), 8)
    lib.put(store, *frames(spark, [f"d{i}" for i in range(30)]))
    number = lib.remove(store, spark.createDataFrame([("d3",), ("d4",), ("absent",)], "document_id string")).number
    assert number == 2 and lib.remove(store, spark.createDataFrame([("absent",)], "document_id string")).number == 2
    left = {f"d{i}" for i in range(30)} - {"d3", "d4"}
    assert {r.document_id for r in store.read("documents").collect()} == left == {r.document_id for r in store.read("chunks").collect()}
    assert {k[1] for k in scored(segments.read_index(store), spark)} <= left
    found = lib.find(store, ["d5", "d3"])
    assert [r.document_id for r in found.collect()] == ["d5"] and len(found.inputFiles()) < len(store.read("documents").inputFiles())
    everything = lib.remove(store, store.read("documents").select("document_id"))
    assert store.read("documents").count() == 0 and everything.tables["chunks"]["buckets"] == {}
    lib.put(store, *frames(spark, ["d1"], 7))
    assert store.read("chunks").count() == 3 and {k[1] for k in scored(segments.read_index(store), spark)} <= {"d1"}


def rows_read(df):
    """The result, and how many rows the scan gave."""
    found = df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return found, sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookups_read_few_row_groups(spark, tmp_path):
    store = lib.open_library(spark, str(tmp_path / "kb"), 64)
    docs = spark.range(6400).select(*[F.concat(F.lit(p), F.sha2(F.col("id").cast("string"), 256)).alias(c) for c, p in (("document_id", "d"), ("source_path", "p"), ("source_sha256", ""))], *[F.lit("x").alias(c) for c in ("category", "indexed_at", "document_date", "raw_text")])
    store.publish(store.change(store.latest(), "documents", docs))
    wanted = docs.first()
    found, n = rows_read(lib.find_by_hash(store, wanted.source_sha256))
    assert [r.document_id for r in found] == [wanted.document_id] and n <= 6400 / 16
    found, n = rows_read(lib.find(store, [wanted.document_id]))
    assert [r.source_sha256 for r in found] == [wanted.source_sha256] and n <= 6400 / 16
    found, n = rows_read(lib.find_by_hash(store, "absent"))
    assert found == [] and n <= 6400 / 16


def test_failed_write_stays_unseen_and_one_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    store = lib.open_library(spark, str(tmp_path / "kb"), 4)
    lib.put(store, *frames(spark, ["a", "b"]))
    before = scored(segments.read_index(store), spark)
    with monkeypatch.context() as m:
        m.setattr(segments, "change", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            lib.put(store, *frames(spark, ["a", "c"], 1))  # documents and chunks are written already
    assert store.latest().number == 1 and {r.document_id for r in store.read("documents").collect()} == {"a", "b"}
    assert scored(segments.read_index(store), spark) == before
    parent = store.latest()
    one = store.change(parent, "documents", frames(spark, ["x"])[0])
    two = store.change(parent, "documents", frames(spark, ["y"])[0])
    assert store.publish(one).number == 2
    with pytest.raises(Conflict):
        store.publish(two)
    assert {r.document_id for r in store.read("documents").collect()} == {"a", "b", "x"}
    assert store.vacuum() > 0 and {r.document_id for r in store.read("documents").collect()} == {"a", "b", "x"}
    assert scored(segments.read_index(store), spark) == before and store.numbers() == [2]


def test_segments_equal_a_rebuild_after_many_changes(spark, tmp_path):
    store = lib.open_library(spark, str(tmp_path / "kb"), 2)
    r = random.Random(1)
    held, most = {}, 0
    for n in range(50):
        ids = [f"d{i}" for i in range(24)] if n == 0 else sorted({f"d{r.randrange(40)}" for _ in range(r.choice([1, 1, 2]))})
        _, chunks = frames(spark, ids, n)
        if n % 7 == 5:
            gone, ids = ids, []
        else:
            gone = ids
        after = segments.change(store, store.latest(), chunks if ids else chunks.limit(0), spark.createDataFrame([(i,) for i in gone], "document_id string"))
        store.publish(after)
        for i in gone:
            held.pop(i, None)
        held |= dict.fromkeys(ids, n)
        most = max(most, len(after.segments))
    whole = [c for i, n in held.items() for c in rows([i], n)[1]]
    whole = {(c[0], c[1]): c for i, n in held.items() for c in whole if c[0] == i}
    stored = segments.read_index(store)
    kept = {(x.document_id, x.chunk_no): x.n_terms for x in stored.lengths.collect()}
    assert kept.keys() == whole.keys() and 2 <= most <= 6
    # Texts were drawn for the ids of a change together, so the rebuild takes them from the postings' own rows.
    words = stored.postings.where("col = 'text'").groupBy("document_id", "chunk_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ").alias("text"))
    fresh = words.select("document_id", "chunk_no", "text", F.lit(None).cast("string").alias("section_path"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("string").alias("tags_text"))
    fresh = fresh.join(spark.createDataFrame([(i, f"v{n}") for i, n in held.items()], "document_id string, h string"), "document_id").drop("heading").withColumnRenamed("h", "heading")
    assert scored(stored, spark) == scored(s.index(fresh), spark)


def test_number_of_segments_grows_with_the_logarithm():
    params, held = segments.SegmentParams(), []
    for n in range(2000):
        k = segments.merged(held, 1, 0, params)
        taken = held[len(held) - k :]
        held = held[: len(held) - k] + [{"n_documents": 1 + sum(g["n_documents"] for g in taken), "n_gone": 0}]
        assert len(held) <= 8, n
    assert segments.merged([{"n_documents": 100, "n_gone": 0}, {"n_documents": 10, "n_gone": 30}], 1, 5, params) == 2


def test_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    store = lib.open_library(spark, str(tmp_path / "kb"), 2)
    inbox_at = tmp_path / "in"
    inbox_at.mkdir()
    write = lambda name, day, text: (inbox_at / name).write_text(f"# T\n**Категория:** Анализы\n**Дата:** 2024-01-0{day}\n\n{text}\n")
    write("a.md", 1, "alpha beta")
    write("b.md", 2, "gamma")
    run = lambda: inbox.into(store, str(inbox_at), str(tmp_path / "cp"), "2025-01-01").awaitTermination()
    publish = type(store).publish
    with monkeypatch.context() as m:
        # The version is published, and the stream fails before it can note the batch.
        m.setattr(type(store), "publish", lambda self, v: (publish(self, v), (_ for _ in ()).throw(RuntimeError("lost")))[0])
        with pytest.raises(Exception, match="lost"):
            run()
    assert store.latest().number == 1
    run()
    assert store.latest().number == 1 and store.read("documents").count() == 2
    write("c.md", 3, "alpha delta")
    with monkeypatch.context() as m:
        # Documents and chunks are written, the index isn't.
        m.setattr(segments, "change", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run()
    assert store.read("documents").count() == 2
    run()
    assert store.latest().number == 2 and {r.source_path for r in store.read("documents").collect()} == {"a.md", "b.md", "c.md"}
    assert len([k for k in scored(segments.read_index(store), spark) if k[0] == 0]) == 2


def test_what_breaks_a_rule_is_refused_whole(spark, tmp_path):
    store = lib.open_library(spark, str(tmp_path / "kb"), 2)
    docs, chunks = frames(spark, ["a", "b"])
    bad = {
        "unique chunk_id": (docs, chunks.withColumn("chunk_id", F.lit("same"))),
        "refers to documents": (docs.where("document_id = 'a'"), chunks),
        "text is not null": (docs, chunks.withColumn("text", F.when(F.col("document_id") == "a", F.col("text")))),
        "unique document_id": (docs.union(docs), chunks),
    }
    for message, (d, c) in bad.items():
        with pytest.raises(constraints.Violation, match=message):
            lib.put(store, d, c)
    assert store.numbers() == []


def test_neighbours_meet_the_bins_of_their_window_alone(spark):
    chunks = spark.range(200_000).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("chunk_no"), F.lit("section").alias("kind"), F.lit("t").alias("text"))
    hits = spark.range(2000).select(F.lit(0).alias("qid"), F.lit("d").alias("document_id"), (F.col("id") * 97).cast("int").alias("chunk_no"))
    for width in (0, 1, 3):
        found = s.neighbours(hits, chunks, width)
        want = {(97 * i, n) for i in range(2000) for n in range(97 * i - width, 97 * i + width + 1) if n >= 0 and n != 97 * i}
        assert {(r.hit_no, r.chunk_no) for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(bin#" in plan.split("Join Inner")[1].split("\n")[0]


def test_last_of_repeated_documents_and_batches(spark, tmp_path):
    store = lib.open_library(spark, str(tmp_path / "kb"), 2)
    docs, chunks = frames(spark, ["a"])
    both = docs.withColumn("at", F.lit(1)).unionByName(docs.withColumns({"source_path": F.lit("later.md"), "at": F.lit(2)}))
    lib.put(store, both, chunks, ("s", 3), "at")
    assert [r.source_path for r in store.read("documents").collect()] == ["later.md"]
    assert lib.put(store, docs, chunks, ("s", 3)).number == lib.put(store, docs, chunks, ("s", 2)).number == 1
    assert lib.put(store, docs, chunks, ("t", 0)).number == 2


def test_change_writes_its_own_rows_until_much_of_a_bucket_is_gone(spark, tmp_path):
    root = str(tmp_path / "kb")
    store = lib.open_library(spark, root, 1)
    ids = [f"d{i}" for i in range(10)]
    lib.put(store, *frames(spark, ids))
    old = files(root)
    lib.put(store, *frames(spark, ["d1", "new"], 1))
    wrote = lambda kind: spark.read.parquet(*[f for f in files(root) - old if f"{os.sep}{kind}{os.sep}" in f]).count()
    assert (wrote("documents"), wrote("documents-gone"), wrote("chunks"), wrote("chunks-gone")) == (2, 1, 6, 1)
    lib.put(store, *frames(spark, ["d1", "d2", "d3", "d4"], 2))
    layers = store.latest().tables["chunks"]["buckets"]["0"]
    assert [n for _, n in layers["layers"]] == [7, 4] and layers["gone"] == []
    got = {(r.document_id, r.chunk_no, r.heading) for r in store.read("chunks").collect()}
    assert got == {(i, k, "v2" if i in ("d1", "d2", "d3", "d4") else "v1" if i == "new" else "v0") for i in [*ids, "new"] for k in range(3)}
    assert store.vacuum() > 0 and store.read("chunks").count() == 33


def test_places_of_a_written_index_are_not_dealt(spark, tmp_path, monkeypatch):
    seen = []
    write = s.write_parts
    monkeypatch.setattr(segments.s, "write_parts", lambda posts, sizes, path: (seen.append(posts._jdf.queryExecution().executedPlan().toString()), write(posts, sizes, path)))
    store = lib.open_library(spark, str(tmp_path / "kb"), 1)
    lib.put(store, *frames(spark, ["a", "b"]))
    (plan,) = seen
    below = plan[plan.rindex("Generate") :]
    assert plan.count("Exchange") == 1 == below.count("Exchange")
    held = segments.read_index(store).postings
    assert held.count() == 2 * 3 * (5 + 1)


def test_removal_rewrites_no_places(spark, tmp_path):
    store = lib.open_library(spark, str(tmp_path / "kb"), 1)
    lib.put(store, *frames(spark, [f"d{i}" for i in range(50)]))
    before = list(lib.put(store, *frames(spark, [f"d{i}" for i in range(10)], 1)).segments)
    after = lib.remove(store, spark.createDataFrame([("d1",), ("d2",), ("d20",)], "document_id string"))
    assert list(after.segments[:-1]) == before and len(before) == 2 and (after.segments[-1]["n_documents"], after.segments[-1]["n_gone"]) == (0, 3)
    live = {f"d{i}" for i in range(50)} - {"d1", "d2", "d20"}
    assert {r.document_id for r in segments.read_index(store).lengths.collect()} == live
    # What comes back counts, and the ids of a removal go into the next segment.
    after = lib.put(store, *frames(spark, ["d1", "d2"], 2))
    assert list(after.segments[:-1]) == before and after.segments[-1]["n_gone"] == 3
    assert {r.document_id for r in segments.read_index(store).postings.collect()} == live | {"d1", "d2"}


def test_removals_by_themselves_are_few_segments():
    params, held = segments.SegmentParams(), [{"n_documents": 10_000, "n_gone": 0}]
    for n in range(2000):
        k = segments.merged(held, 0, 1, params)
        taken = held[len(held) - k :]
        held = held[: len(held) - k] + [{"n_documents": 0, "n_gone": 1 + sum(g["n_gone"] for g in taken)}]
        assert len(held) <= 9 and held[0]["n_documents"] == 10_000, n
