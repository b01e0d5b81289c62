"""Sums of many queries in blocks equal plain ones, and leave out only what is behind the first."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvidex.operators import ranking, search as s


@pytest.mark.parametrize("block, n_queries", [(2_000_000, 6), (40, 6), (1, 6), (2_000_000, 400), (300, 400)])
def test_blocks_equal_plain_sums(monkeypatch, block, n_queries):
    monkeypatch.setattr(ranking, "BLOCK", block)
    r = random.Random(3)
    pairs = sorted({(r.randrange(12), r.randrange(n_queries)) for _ in range(30)} | {(11, 0)})
    rows = [(d, c, no, r.choice([0.5, 0.25, 1.0]), r.random() < 0.9 or None) for d in range(25) for c in range(r.randrange(4)) for no in sorted(r.sample(range(12), r.randrange(1, 6)))]
    names = ["document_id", "chunk_no", "no", "part", "allowed"]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 7])], names) for i in range(0, len(rows), 7)]
    want = {}
    for d, c, no, part, allowed in rows:
        for q in [q for n, q in pairs if n == no and allowed]:
            want[q, d, c] = want.get((q, d, c), 0) + part
    for k in (1, 3, 1000):
        run = ranking.first_sums(s.KEY, s.KEY, np.array(pairs), pa.array(range(n_queries)), k)
        got = [tuple(x.values()) for b in run(iter(batches)) for x in b.to_pylist()]
        found = {x[:3]: x[3] for x in got}
        assert len(found) == len(got) and found.items() <= want.items()
        for q in range(n_queries):
            mine, all_ = [sorted((x for key, x in some.items() if key[0] == q), reverse=True) for some in (found, want)]
            assert all_[:k] == mine[:k]
            if len(all_) >= k:  # with all that tie with the last one
                assert [x for x in all_ if x >= all_[k - 1]] == [x for x in mine if x >= all_[k - 1]]
            if block > 1000 and len(all_) >= k:
                assert len(mine) == len([x for x in all_ if x >= all_[k - 1]])


def test_searches_of_many_and_of_few_terms_agree(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    rows = [(i // 3, i % 3, "meta" if i % 7 == 3 else "section", " ".join(r.choice(words) for _ in range(r.randrange(1, 9))), "a", "b", "en") for i in range(240)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_no int, kind string, text string, section_path string, heading string, tags_text string")
    documents = spark.createDataFrame([(i, f"p{i}", "en", f"2024-01-{1 + i % 28:02}") for i in range(80)], "document_id long, source_path string, category string, document_date string")
    terms = spark.createDataFrame([(q, w, False) for q in range(9) for w in r.sample(words, 4)], "qid long, term string, is_prefix boolean")
    params = s.SearchParams(prelimit=12, limit=8)
    key = lambda df: sorted(tuple(x) for x in df.select("qid", "pos", *s.KEY, "rank", "kind", "text").collect())
    want = key(s.search(chunks, documents, terms, params=params))
    monkeypatch.setattr(s, "FEW", 10)  # fewer than the terms of all queries
    many = s.search(chunks, documents, terms, params=params)
    assert key(many) == want != []
    # Rows of chunks, terms and queries aren't joined, grouped and sorted for the first ones.
    assert "MapInArrow" in many._jdf.queryExecution().optimizedPlan().toString()
