"""Empty tables, repeated rows and long values for the operators and stages, and toxicity by hand."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from corvidex.llm import decontamination, secret_scan, toxicity, url_filters
from tests.llm.cases import frame, words


def buckets(text, params, n=5):
    """The hash buckets of a text's character n-grams; few n-grams share one."""
    padded = f" {text.lower()} "
    grams = {padded[i : i + n] for i in range(len(padded) - n + 1)}
    found = set(toxicity._present([text], params, None)[1].tolist())
    assert len(grams) - 2 <= len(found) <= len(grams)
    return found


def test_toxicity_by_hand(spark):
    docs = [(i, words(i, 12) + (" scoundrel" if i % 3 == 0 else " darling")) for i in range(60)]
    toxic = {i: int(i % 3 == 0) for i, _ in docs}
    params = toxicity.ToxicityParams(orders=(5,), features=100_000, min_documents=1)
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"), params)
    count = [Counter(g for i, t in docs if toxic[i] == y for g in buckets(t, params)) for y in (0, 1)]
    n = [sum(v == y for v in toxic.values()) for y in (0, 1)]
    ratio = lambda g: math.log((count[1][g] + 1) / (n[1] + 2)) - math.log((count[0][g] + 1) / (n[0] + 2))
    new = [(100, docs[0][1] + " more words"), (101, ""), (102, "darling darling")]
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, docs + new), model).collect()}
    for i, t in docs + new:
        _, feature = toxicity._present([t], params, model.slot)
        known = [g for g in buckets(t, params) if count[0][g] + count[1][g]]
        assert sorted(model.ratio[feature]) == pytest.approx(sorted(map(ratio, known)))
        norm = math.sqrt(max(sum(ratio(g) ** 2 for g in known), 1e-12))
        z = sum(model.weight[feature]) / norm + model.bias
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)))
        # A learnt weight times the ratio: the same feature weighs the same in every text.
        assert np.isfinite(model.weight).all()
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_url_filters_on_empty_repeated_and_long(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    schema = "page_id long, url string"
    assert url_filters.judge(spark.createDataFrame([], schema), labels).count() == 0
    long = "http://a.com/en/" + "x/" * 50_000
    rows = [(1, long), (1, long), (2, None)]
    got = [(r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, schema), labels).collect()]
    assert sorted(got) == [(1, "a.com", 100_004, "com/en/", "block")] * 2 + [(2, "", 0, None, "allow")]


def test_empty_tables(spark, tmp_path):
    assert secret_scan.scan_secrets(frame(spark, [])).count() == 0
    bench = spark.createDataFrame([("x", words(5, 40))], "item_id string, text string")
    assert decontamination.contaminated(frame(spark, []), bench).count() == 0
    assert [tuple(r)[:2] for r in decontamination.contaminated(frame(spark, [(1, words(5, 40))]), bench).collect()] == [(1, "x")]
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_sample_is_bounded_by_rows_of_documents(spark):
    """Of an id with many rows, one text is learnt from."""
    params = toxicity.ToxicityParams(train_rows=2)
    docs = frame(spark, [(1, words(k, 20)) for k in range(300)] + [(2, words(500, 20)), (3, words(501, 20))])
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, params).collect()
    assert len(sample) <= 2 and len({r.doc_id for r in sample}) == len(sample)
    again = toxicity._sample(docs.repartition(5, "text"), labels, params).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, sample))
