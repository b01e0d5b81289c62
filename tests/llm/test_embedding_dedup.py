"""Near vectors against all pairs, with crowds of copies and near copies, chains, and odd rows."""

import numpy as np

from corvidex.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    """(vec_id, n_links, component_id, kept) by comparing all pairs; ``rows`` are (vec_id, vector)."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in good})
    links, near = {x: 0 for x in good}, {x: {x} for x in good}
    for d in {len(v) for _, v in good}:
        mine = [x for x in good if len(x[1]) == d]
        x = np.array([v for _, v in mine], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(x @ x.T >= 0.95), strict=True):
            if i < j:
                a, b = mine[i], mine[j]
                links[a] += 1
                links[b] += 1
                if near[a] is not near[b]:
                    both = near[a] | near[b]
                    for y in both:
                        near[y] = both
    out = []
    for i, v in rows:
        key = (i, tuple(np.float32(x) for x in v)) if v and None not in v else None
        if key in links:
            least = min(y[0] for y in near[key])
            out.append((i, links[key], least, i == least))
        else:
            out.append((i, 0, i, True))
    return out


def check(spark, rows, params=ed.NearVectorParams(), partitions=4):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)
    df = df.withColumns({"key": df.vec_id, "no": df.vec_id, "root": df.vec_id}).repartition(partitions)
    key = lambda x: tuple((y is None, y) for y in x)
    got = sorted((tuple(r) for r in ed.near_vectors(df, params).collect()), key=key)
    assert got == sorted(expected(rows), key=key)


def near(r, base, spread):
    return (base + spread * np.linalg.norm(base) / np.sqrt(len(base)) * r.standard_normal(len(base))).astype(np.float32)


def groups(seed, spreads, strangers=800, d=24):
    r = np.random.default_rng(seed)
    rows = [r.standard_normal(d) for _ in range(strangers)]
    for n, spread in spreads:
        base = r.standard_normal(d)
        rows += [near(r, base, spread) for _ in range(n)]
    copy = r.standard_normal(d)
    rows += [copy] * 40
    r.shuffle(rows)
    return [(int(i), v.astype(np.float32).tolist()) for i, v in zip(r.permutation(len(rows)) * 3, rows, strict=True)]


def test_against_all_pairs(spark):
    check(spark, groups(1, [(2, 0.1)] * 60 + [(30, 0.15), (400, 0.1), (150, 0.25)]))


def test_cells_of_a_core_and_others(spark):
    # Blocks of 32: a core is counted as a whole, the others in cells, links within and between them included.
    params = ed.NearVectorParams(block=32, window=16)
    check(spark, groups(2, [(300, 0.1), (200, 0.2), (120, 0.27)], strangers=200), params)


def test_chain_and_borders(spark):
    # Each vector links with its neighbours on an arc alone; windows of 8 over many partitions.
    angle = np.arange(300) * 0.1
    rows = [(i, [float(np.cos(a / 10)) * (1 + i), float(np.sin(a / 10)) * (1 + i), 0.0]) for i, a in enumerate(angle)]
    check(spark, rows, ed.NearVectorParams(window=8, block=64), 8)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, nan]), (8, [inf, 1.0]), (9, [1e30, 0.0]),
        (10, [1e-30, 0.0]), (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0]), (13, [-1.0, 0.0]), (14, [0.0, 1.0]), (14, [0.0, 2.0]), (15, [-0.0, 5.0]), (3, [7.0, 0.0]),
    ]
    check(spark, rows)
    check(spark, [])
    check(spark, [(5, [1.0, 2.0])])


def test_window_alone_finds_pairs(spark):
    """The share of planted pairs at 0.95 to 0.96 that the passes connect."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        a = r.standard_normal(64)
        b = r.standard_normal(64)
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.9501 + 0.009 * r.random()
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = ed.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).where("n_links > 0").count()
    assert got >= 0.995 * len(rows)
