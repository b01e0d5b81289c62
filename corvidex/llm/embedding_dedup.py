"""Embedding near-dedup: sorted passes over concatenated random hashes, then exact counts inside the groups found.

Equal vectors form a class, and one of each goes on. Each pass has its own
random hashes: a hash is the number of the largest coordinate, with its sign, of
a random projection, and a vector's key is a run of hashes. Vectors are ordered
by keys over all workers, each is compared with the ``window`` vectors behind it,
across the borders of partitions too, and pairs at the similarity or above in
double precision are links. Of its links a worker returns a spanning set, and
those of all passes are united to components.

The number of passes follows from the number of vectors: a pair at the
similarity itself shares the hashes that leave no more than a window of strangers
with probability p, and 1 - (1 - p)^passes meets the recall asked for. A window
is too narrow for a crowd of near vectors, so their links aren't counted from
windows: inside each component, all vectors are compared in cells of bounded
size, spread over tasks. In a component of more than one cell, vectors within
half the angle of a link around one of its vectors are all linked with each
other; they are counted without comparing them among themselves.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without an id, link with nothing (the component of a row
without an id is null, and it is kept); vectors of different lengths don't link;
rows that repeat an id and vector count once and are all returned; several
vectors of one id are vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from corvidex.llm._session import Scratch, cut
from corvidex.llm.jaccard_join import components

_EPS = 1e-9  # radians by which bounds of angles are narrowed


@dataclass(frozen=True)
class NearVectorParams:
    similarity: float = 0.95
    window: int = 128
    recall: float = 0.9999  # of pairs at the similarity itself; nearer ones are found more often
    width: int = 32  # coordinates of a projection; a hash has twice as many values
    hashes: int = 6  # of a key
    crowding: int = 8  # how much fuller than the mean a stretch of keys may be
    partition: int = 1 << 16  # vectors of a sorted partition, about
    block: int = 1024  # vectors of a block; a cell holds two

    def passes(self, n: int) -> int:
        """The number of passes for ``n`` different vectors."""
        strangers = n * self.crowding / self.window
        prefix = min(self.hashes, math.ceil(math.log(strangers, 2 * self.width))) if strangers > 1 else 0
        p = self._agreement() ** prefix
        return 1 if p >= self.recall else math.ceil(math.log(1 - self.recall) / math.log(1 - p))

    def _agreement(self) -> float:
        """The chance that two vectors at the similarity have one hash in common, from 20,000 draws."""
        x, y = np.random.default_rng(3).standard_normal((2, 20_000, self.width))
        y = self.similarity * x + math.sqrt(1 - self.similarity**2) * y
        at, to = np.abs(x).argmax(1), np.abs(y).argmax(1)
        i = np.arange(len(x))
        return float(np.mean((at == to) & ((x[i, at] > 0) == (y[i, to] > 0))))


def valid(vector: Column) -> Column:
    """Whether all components are finite and one at least isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each length of vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    start = np.cumsum(ends) - ends
    for d in np.unique(ends):
        rows = np.flatnonzero(ends == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _keys(number: int, params: NearVectorParams):
    """mapInArrow: each vector's key in pass ``number``."""
    bits = int(2 * params.width - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            key = np.zeros(b.num_rows, np.int64)
            for rows, x in _units(b.column("vector")):
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([7, number, d]).standard_normal((d, params.hashes * params.width))
                y = (x @ planes[d]).reshape(len(rows), params.hashes, params.width)
                top = np.abs(y).argmax(axis=2)
                value = 2 * top + (np.take_along_axis(y, top[:, :, None], 2)[:, :, 0] > 0)
                for k in range(params.hashes):
                    key[rows] = (key[rows] << bits) | value[:, k]
            yield pa.RecordBatch.from_arrays([b.column("no"), pa.array(key), b.column("vector")], ["no", "key", "vector"])

    return run


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that links (a, b) connect each of ``n`` indexes with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _near(ids: np.ndarray, x: np.ndarray, params: NearVectorParams) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) of a spanning set among sorted vectors, each compared with the window behind it."""
    n, w, step = len(ids), params.window, 256
    left, right = [], []
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        s = x[lo:hi] @ x[lo : hi + w].T
        i, j = np.nonzero(s >= params.similarity)
        ahead = (j > i) & (j - i <= w)
        left.append(lo + i[ahead])
        right.append(lo + j[ahead])
    label = spanning(np.concatenate(left), np.concatenate(right), n) if left else np.arange(n)
    linked = np.flatnonzero(label != np.arange(n))
    return ids[label[linked]], ids[linked]


_BORDER = "u long, v long, at long, place long, vector "


def _windows(params: NearVectorParams):
    """mapInArrow over one sorted partition: its links, and its first and last ``window`` vectors for the borders.

    Border rows carry ``at``, the border's number, and their ``place`` on it:
    the last vectors of partition i and the first of i + 1 meet at border i.
    """
    w = params.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        tail = None
        for b in batches:
            b = b.select(["no", "vector"])
            if seen < w:
                yield _border(b.slice(0, w - seen), part - 1, w + seen)
            seen += b.num_rows
            here = pa.Table.from_batches([*([tail] if tail else []), b]).combine_chunks()
            ids = here["no"].to_numpy()
            for rows, x in _units(here["vector"]):
                yield _links(*_near(ids[rows], x, params), b.schema.field("vector").type)
            tail = here.slice(max(0, here.num_rows - w)).to_batches()[0]
        if tail:
            yield _border(tail, part, w - tail.num_rows)

    return run


def _links(u: np.ndarray, v: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none, none, pa.nulls(len(u), kind)], ["u", "v", "at", "place", "vector"])


def _border(b: pa.RecordBatch, at: int, place: int) -> pa.RecordBatch:
    n = b.num_rows
    return pa.RecordBatch.from_arrays([b.column("no"), pa.nulls(n, pa.int64()), pa.array(np.full(n, at)), pa.array(np.arange(place, place + n)), b.column("vector")], ["u", "v", "at", "place", "vector"])


def _borders(params: NearVectorParams):
    """applyInArrow: links of the at most two windows that meet at a border."""

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("place").combine_chunks()
        ids, out = held["u"].to_numpy(), []
        for rows, x in _units(held["vector"]):
            out.append(_links(*_near(ids[rows], x, params), pa.float32()).select(["u", "v"]))
        return pa.Table.from_batches(out)

    return run


def _pass(vectors: DataFrame, number: int, partitions: int, params: NearVectorParams) -> DataFrame:
    kind = dict(vectors.dtypes)["vector"]
    keyed = vectors.mapInArrow(_keys(number, params), f"no long, key long, vector {kind}")
    order = [F.size("vector"), "key", "no"]
    placed = keyed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return placed.mapInArrow(_windows(params), _BORDER + kind).select(F.lit(number).alias("pass"), "*")


def _links_of(passes: DataFrame, partitions: int, params: NearVectorParams) -> DataFrame:
    """(u, v) of all passes, those across borders included."""
    border = passes.where(F.col("at").between(0, partitions - 2)).groupBy("pass", "at").applyInArrow(_borders(params), "u long, v long")
    return passes.where("v IS NOT NULL").select("u", "v").unionByName(border).distinct()


def _cells(params: NearVectorParams):
    """mapInArrow over rows sorted by cell: for each vector of a cell, the number of vectors in it that link with it."""

    def cell(rows: pa.Table, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        no, m, block = (rows[c].to_numpy() for c in ("no", "m", "block"))
        ((_, x),) = _units(rows["vector"])
        a = np.flatnonzero(block == lo)
        if lo == hi:
            s = x @ x.T >= params.similarity
            np.fill_diagonal(s, False)
            return no, s @ m
        b = np.flatnonzero(block == hi)
        s = x[a] @ x[b].T >= params.similarity
        return np.concatenate([no[a], no[b]]), np.concatenate([s @ m[b], s.T @ m[a]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        here = None

        def done() -> pa.RecordBatch:
            no, n = cell(pa.Table.from_batches(held), *here)
            return pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(n, pa.int64())], ["no", "n"])

        for b in batches:
            cells = np.stack([b.column("lo").to_numpy(), b.column("hi").to_numpy()], 1)
            starts = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)])).tolist() if len(cells) else []
            for lo, hi in zip(starts, [*starts[1:], len(cells)], strict=True):
                if here != (now := tuple(cells[lo].tolist())):
                    if held:
                        yield done()
                    here, held = now, []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield done()

    return run


def _counts(groups: DataFrame, scratch: Scratch, params: NearVectorParams) -> DataFrame:
    """(no, n): how many vectors link with each vector of ``groups`` (root, no, m, vector), its own copies left out."""
    sizes = scratch.keep(groups.groupBy("root").agg(F.count("*").alias("size")))
    groups = groups.join(sizes, "root")
    small = groups.where(F.col("size") <= params.block).select(F.col("root").alias("lo"), F.col("root").alias("hi"), F.col("root").alias("block"), "no", "m", "vector")
    # In large components, the angle to the vector of the component's own number splits the members into a core and the others.
    large = groups.where(F.col("size") > params.block)
    pivot = large.where("no = root").select("root", F.col("vector").alias("pivot"))
    of = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(of(F.col(a)), of(F.col(b)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("vector", "pivot") / F.sqrt(dot("vector", "vector")) / F.sqrt(dot("pivot", "pivot"))
    angle = math.acos(params.similarity) / 2 - _EPS
    core = F.coalesce(cosine >= math.cos(angle), F.lit(False))  # where squares overflow the quotient is no number, and the row isn't of the core
    large = large.join(pivot, "root").select("root", "no", "m", "vector", core.alias("core"))
    large = scratch.keep(large)
    by = large.groupBy("root", "core").agg(F.count("*").alias("k"), F.sum("m").alias("all"))
    parts = F.ceil(F.col("k") / params.block).cast("int")
    by = scratch.keep(by.select("root", "core", "all", parts.alias("parts")))
    in_core = large.where("core").join(by.where("core").select("root", "all"), "root").select("no", (F.col("all") - F.col("m")).alias("n"))
    name = lambda part: F.xxhash64("root", "core", part)
    placed = large.join(by, ["root", "core"]).select("root", "core", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int").alias("part"), "no", "m", "vector")
    blocks = by.select("root", "core", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("root", "core", "part", name("part").alias("block"))
    outer = blocks.where("NOT core").select("root", F.col("block").alias("other"))
    # Each block of a component's others meets each of its blocks once; blocks of the core don't meet each other.
    pairs = blocks.join(outer, "root").where("core OR block <= other").select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    pairs = scratch.keep(pairs.distinct())
    meets = pairs.select(F.col("lo").alias("block"), "lo", "hi").unionByName(pairs.where("lo <> hi").select(F.col("hi").alias("block"), "lo", "hi"))
    crowded = placed.select(name("part").alias("block"), "no", "m", "vector").join(meets, "block").select("lo", "hi", "block", "no", "m", "vector")
    cells = small.unionByName(crowded).repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    compared = cells.mapInArrow(_cells(params), "no long, n long")
    return compared.unionByName(in_core).groupBy("no").agg(F.sum("n").alias("n"))


def near_vectors(embeddings: DataFrame, params: NearVectorParams = NearVectorParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``embeddings`` (vec_id, embedding)."""
    ok = valid(F.col("embedding")) & F.col("vec_id").isNotNull()
    k = [F.when(ok, F.xxhash64(*seed, F.col("embedding"))) for seed in ((), (F.lit(7),))]
    rows = embeddings.select("vec_id", "embedding", k[0].alias("k1"), k[1].alias("k2"))
    with Scratch(embeddings.sparkSession) as scratch:
        classes = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("c"), F.count_distinct("vec_id").alias("m"), F.first("embedding").alias("vector"))
        classes = scratch.keep(classes.withColumn("no", F.monotonically_increasing_id()))
        n = classes.count()
        vectors = classes.select("no", "vector")
        partitions = max(1, min(n // (4 * params.window), max(n // params.partition, embeddings.sparkSession.sparkContext.defaultParallelism)))
        found = None
        for number in range(params.passes(n) if n > 1 else 0):
            found = scratch.add(_pass(vectors, number, partitions, params), "passes")
        if found is None:
            near = classes.select("no", F.lit(0).cast("long").alias("n"), F.col("c").alias("component_id")).limit(0)
        else:
            found = scratch.keep(components(scratch.keep(_links_of(found, partitions, params))).select(F.col("node").alias("no"), "root"))
            groups = scratch.keep(found.join(classes.select("no", "c", "m", "vector"), "no"))
            least = groups.groupBy("root").agg(F.min("c").alias("component_id"))
            counted = _counts(groups.select("root", "no", "m", "vector"), scratch, params)
            near = groups.select("no", "root").join(least, "root").join(counted, "no", "left").select("no", F.coalesce("n", F.lit(0)).alias("n"), "component_id")
        # Classes of one vector without a link need no row.
        known = classes.select("k1", "k2", "c", "m", "no").join(near, "no", "left").where("m > 1 OR n > 0")
        links = (F.col("m") - 1 + F.coalesce("n", F.lit(0))).cast("long")
        known = cut(known.select("k1", "k2", links.alias("n_links"), F.coalesce("component_id", "c").alias("component_id")))
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
