"""Hard negatives against a sort of all pairs, with many ties, several rounds of anchors, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvidex.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, vector array<double>"


def expected(rows, every=100):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            x = (label, v)
            good[i] = min(good.get(i, x), x)
    whole = {i: [int(np.floor(256.0 * x)) for x in v] for i, (_, v) in good.items()}
    out = []
    for a, (label, _) in good.items():
        if a % every:
            continue
        scored = [(sum(map(int.__mul__, whole[a], whole[i])), i) for i in good if len(whole[i]) == len(whole[a])]
        first = sorted((-s, i) for s, i in scored if i != a and good[i][0] == label)[:5]
        others = sorted((-s, i) for s, i in scored if good[i][0] != label)
        for p, i in first:
            fit = [(s, n) for s, n in others if -80 * p <= -100 * s <= -100 * p][:5]
            out += [(a, i, k + 1, n, -p, -s) for k, (s, n) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=100, params=hn.HardNegativeParams()):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.col("vec_id"), "score": F.lit(1)}).repartition(3)
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % every == 0, params).collect())


def test_against_all_pairs(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(4), [r.randrange(-2, 6) / 4 for _ in range(5)]) for i in range(900)]  # coarse: very many ties
    want = expected(rows, 10)
    assert want and mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, hn.HardNegativeParams(anchor_values=60, cells=500)) == want


def test_whole_table(spark):
    from corvidex.llm import queries

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    rows = [(x.vec_id, (x.label + 1) % 10 if x.vec_id % 7 == 0 else x.label, x.embedding) for x in table]
    assert sorted(tuple(x) for x in queries.op13_hard_negatives(spark, "/root/testdata/sf0.1").collect()) == expected(rows)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [1.0, 0.4]), (2, 3, [9.0, 9.0]), (1, 1, [1.0, 0.5]), (3, None, [1.0, 0.5]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]),
        (7, 2, [inf, 1.0]), (None, 2, [1.0, 0.4]), (8, 2, [1.0, 0.4, 0.0]), (100, 7, [1.0, 1.0]), (200, 5, []), (201, 5, []), (202, 6, []), (300, 1, [-1.0, -1.0]), (9, 2, [0.0, 0.0]), (10, 2, [0.6, 0.6]),
    ]
    assert mined(spark, rows) == expected(rows) != []
    assert mined(spark, []) == []
    big = [(0, 1, [1e7, 3.0]), (1, 1, [9e6, 1.0]), (2, 2, [8.9e6, 0.0]), (3, 2, [7e6, 0.0]), (4, 2, [-1e7, 1.0]), (5, 2, [8.5e6, 1.25])]
    assert mined(spark, big) == expected(big) != []
    beyond = mined(spark, [(0, 1, [1e300, 0.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e300, 2.0])])
    assert beyond == [(0, 1, 1, 2, (1 << 63) - 1, (1 << 63) - 1)]


def test_crowd_of_one_vector(spark):
    rows = [(i, i % 3, [1.0, 2.0]) for i in range(3000)] + [(3000 + i, 1, [1.0, 1.0 + i / 8]) for i in range(300)]
    assert mined(spark, rows, 500) == expected(rows, 500)


def test_keys_sort_as_their_parts():
    r = random.Random(1)
    parts = [(r.choice([-5, 0, 7]), r.choice([-(1 << 63), -3, 0, 3, (1 << 63) - 1]), r.randrange(2), r.randrange(-9, 9)) for _ in range(500)]
    keys = pa.concat_arrays([hn.pack(np.array([a]), np.array([s]), k, np.array([i])) for a, s, k, i in parts])
    assert list(zip(*hn.unpack(keys), strict=True)) == parts
    assert [parts[i] for i in sorted(range(500), key=lambda i: keys[i].as_py())] == sorted(parts, key=lambda x: (x[0], -x[1], x[2], x[3]))


@pytest.mark.parametrize("kept", [1, 3])
def test_stream_holds_open_windows_alone(kept):
    params = hn.HardNegativeParams(negatives=kept)
    pairs = [(1, 100, 0, 5), (1, 90, 1, 6), (1, 85, 1, 7), (1, 84, 0, 8), (1, 84, 1, 9), (1, 70, 1, 10), (1, 60, 1, 11), (2, 9, 1, 3)]
    keys = pa.concat_arrays([hn.pack(np.array([a]), np.array([s]), k, np.array([i])) for a, s, k, i in pairs])
    batches = [pa.RecordBatch.from_arrays([keys.slice(i, 2)], ["key"]) for i in range(0, len(keys), 2)]
    got = [tuple(x.values()) for b in hn._mined(params)(iter(batches)) for x in b.to_pylist()]
    want = [(1, 5, 1, 6, 100, 90), (1, 5, 2, 7, 100, 85), (1, 5, 3, 9, 100, 84), (1, 8, 1, 9, 84, 84), (1, 8, 2, 10, 84, 70)]
    assert got == [x for x in want if x[2] <= kept]
