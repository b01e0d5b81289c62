"""Hard-negative mining: pair scores in packed keys, dealt and sorted by a secondary-sort shuffle, and read as a stream.

A pair's key packs the anchor, the score in descending order, the kind (positives
before negatives of the same score) and the other row's id into bytes whose order
is theirs. Keys are dealt by anchor and sorted inside partitions
(``repartitionAndSortWithinPartitions``, as DataFrames have it). An iterator then
reads each anchor's pairs from the highest score down: a positive opens its
window, a negative goes to all open windows that it fits, and a window that is
full or fallen below is closed. It holds the open windows and nothing else.

Scores are made in blocks: a bounded part of the anchors is sent to the tasks,
which read all rows against it. Of an anchor's pairs, a task passes on only those
that can be among its first: its own first positives; then, with the windows of
the anchor's final positives known, its own first negatives of each window. So
the shuffle holds a few pairs for each anchor and task, and no anchor is large.

Defined cases: rows take no part whose id, label or vector is null, or whose
vector has a null or non-finite component; of several rows of an id, the one of
the least label, then the least vector, stands for all; vectors of different
lengths don't meet; an anchor without positives gives no rows; scores outside 64
bits count as the nearest 64-bit value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from corvidex.llm._session import Scratch, cut

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_EXACT = 1 << 38  # scores up to this, times a batch's rows, are exact in double precision


@dataclass(frozen=True)
class HardNegativeParams:
    positives: int = 5
    negatives: int = 5
    lowest: tuple[int, int] = (80, 100)  # a negative's least share of the positive's score
    scale: int = 256  # components become floor(scale * x)
    anchor_values: int = 1 << 22  # components of the anchors that tasks hold at once, about
    cells: int = 1 << 21  # scores that a task holds at once


@dataclass
class _Anchors:
    """Anchors of one length of vectors, and the windows of their positives (none yet: no columns)."""

    ids: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    windows: np.ndarray  # positives' scores, the lowest long where there is none

    @property
    def largest(self) -> float:
        return float(np.abs(self.vectors).max(initial=0.0))


def _by_length(held: pa.Table | pa.RecordBatch, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of vectors to (rows, integer vectors as doubles)."""
    column = held["vector"]
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    start = np.cumsum(size) - size
    out = {}
    with np.errstate(over="ignore"):
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            out[d] = rows, np.nan_to_num(np.floor(flat[start[rows][:, None] + np.arange(d)] * scale))
    return out


def _scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products as 64-bit integers; ``most`` is the largest component of all rows of ``a``'s table."""
    if most * float(np.abs(b).max(initial=0.0)) * max(a.shape[1], 1) <= _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in x] for x in b]
    return np.array([[min(max(sum(map(int.__mul__, x, y)), _LOW + 1), _HIGH) for y in whole] for x in ([int(v) for v in r] for r in a)], np.int64).reshape(len(a), len(b))


def _first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, whether there is one) of the ``k`` best allowed scores of each row, the earlier column before in ties."""
    n = score.shape[1]
    if n <= k:
        key = np.where(allowed, score, _LOW)
        order = np.argsort(-key.astype(object) if (score == _LOW).any() else ~key, axis=1, kind="stable")
        return order, np.take_along_axis(allowed, order, 1)
    if np.abs(score).max(initial=0) <= _EXACT:  # score and column fit into one integer
        key = np.where(allowed, score * n - np.arange(n), _LOW)
        top = np.argpartition(key, n - k, axis=1)[:, n - k :]
        order = np.take_along_axis(top, np.argsort(~np.take_along_axis(key, top, 1), axis=1, kind="stable"), 1)
    else:
        order = np.argsort(~np.where(allowed, score, _LOW), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(allowed, order, 1)


class _Best:
    """The ``k`` best (score, id) of each of ``n`` lists; the smaller id comes first in ties."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id, self.there = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), np.zeros((n, 0), bool)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, there: np.ndarray) -> None:
        """Put candidates into the lists ``at``."""
        if not there.any():
            return
        if self.score.shape[1] < self.k:
            more = self.k - self.score.shape[1]
            self.score, self.id, self.there = (np.pad(x, ((0, 0), (0, more))) for x in (self.score, self.id, self.there))
        score, ids, there = (np.concatenate([x[at], y], 1) for x, y in ((self.score, score), (self.id, ids), (self.there, there)))
        order = np.lexsort((ids, ~score, ~there), axis=1)[:, : self.k]
        for mine, x in ((self.score, score), (self.id, ids), (self.there, there)):
            mine[at] = np.take_along_axis(x, order, 1)


def _positives(held: list[_Anchors], params: HardNegativeParams) -> tuple[list[_Best], callable]:
    best = [_Best(len(a.ids), params.positives) for a in held]

    def see(i: int, rows: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        a = held[i]
        for value in np.intersect1d(label, a.label):
            mine, those = np.flatnonzero(a.label == value), np.flatnonzero(label == value)
            for lo in range(0, len(mine), step := max(1, params.cells // len(those))):
                at = mine[lo : lo + step]
                score = _scores(a.vectors[at], x[those], a.largest)
                column, there = _first(score, rows[those][None, :] != a.ids[at][:, None], params.positives)
                best[i].add(at, np.take_along_axis(score, column, 1), rows[those][column], there)

    return best, see


def _negatives(held: list[_Anchors], params: HardNegativeParams) -> tuple[list[_Best], callable]:
    """Lists are those of all windows of an anchor, one after another."""
    best = [_Best(a.windows.size, params.negatives) for a in held]
    num, den = params.lowest

    def see(i: int, rows: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        a, width = held[i], held[i].windows.shape[1]
        for lo in range(0, len(a.ids), step := max(1, params.cells // max(1, len(rows)))):
            at = np.arange(lo, min(lo + step, len(a.ids)))
            score = _scores(a.vectors[at], x, a.largest)
            other = label[None, :] != a.label[at][:, None]
            for w in range(width):
                top = a.windows[at, w]
                low = np.array([-(-num * t // den) for t in top.tolist()], np.int64)  # the least integer of the share or more
                allowed = other & (score <= top[:, None]) & (score >= low[:, None]) & (top > _LOW)[:, None]
                some = np.flatnonzero(allowed.any(axis=1))
                if len(some):
                    column, there = _first(score[some], allowed[some], params.negatives)
                    best[i].add(at[some] * width + w, np.take_along_axis(score[some], column, 1), rows[column], there)

    return best, see


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, other: np.ndarray) -> pa.Array:
    """Keys whose order as bytes is that of (anchor, descending score, kind, other id)."""
    flip = np.uint64(1 << 63)
    parts = [anchor.astype(np.int64).view(np.uint64) ^ flip, ~(score.astype(np.int64).view(np.uint64) ^ flip), other.astype(np.int64).view(np.uint64) ^ flip]
    a, s, o = (x.astype(">u8").view(np.uint8).reshape(-1, 8) for x in parts)
    raw = np.concatenate([a, s, np.full((len(a), 1), kind, np.uint8), o], axis=1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())]).cast(pa.binary())


def unpack(keys: pa.Array) -> tuple[list[int], list[int], list[int], list[int]]:
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 25)
    flip = np.uint64(1 << 63)
    whole = lambda x: np.ascontiguousarray(x).view(">u8").ravel().astype(np.uint64)
    a, s, o = whole(raw[:, :8]) ^ flip, ~whole(raw[:, 8:16]) ^ flip, whole(raw[:, 17:]) ^ flip
    return tuple(x.view(np.int64).tolist() for x in (a, s)) + (raw[:, 16].tolist(), o.view(np.int64).tolist())


_KEY = "anchor_id long, key binary"


def _scan(shared: Broadcast, make: callable, kind: int, params: HardNegativeParams):
    """mapInArrow over rows (vec_id, label, vector): keys of the best pairs of each anchor in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Anchors] = shared.value
        best, see = make(held, params)
        lengths = {a.vectors.shape[1]: i for i, a in enumerate(held)}
        for b in batches:
            ids, label = b.column("vec_id").to_numpy(), b.column("label").to_numpy()
            for d, (rows, x) in _by_length(b, params.scale).items():
                if d in lengths:
                    order = np.argsort(ids[rows], kind="stable")
                    see(lengths[d], ids[rows][order], label[rows][order], x[order])
        for a, found in zip(held, best, strict=True):
            at, column = np.nonzero(found.there)
            anchor = a.ids[at // max(1, len(found.there) // max(1, len(a.ids)))]
            score, other = found.score[at, column], found.id[at, column]
            keep = np.unique(np.stack([anchor, score, other]), axis=1) if len(at) else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keep[0]), pack(keep[0], keep[1], kind, keep[2])], ["anchor_id", "key"])

    return run


def _sorted(keys: DataFrame) -> DataFrame:
    return keys.repartition("anchor_id").sortWithinPartitions("key")


def _leading(params: HardNegativeParams):
    """mapInArrow over sorted keys: the first positives of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = None, 0
        for b in batches:
            out = []
            for anchor, score, _, other in zip(*unpack(b.column("key")), strict=True):
                here, n = (here, n + 1) if anchor == here else (anchor, 1)
                if n <= params.positives:
                    out.append((anchor, score, other))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_score", "positive_id"])

    return run


def _mined(params: HardNegativeParams):
    """mapInArrow over sorted keys: negatives of each positive, from a stream of pairs."""
    num, den = params.lowest
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, windows = None, []  # windows: [positive id, its score, negatives so far]
        for b in batches:
            out = []
            for anchor, score, kind, other in zip(*unpack(b.column("key")), strict=True):
                if anchor != here:
                    here, windows = anchor, []
                if kind == 0:
                    windows.append([other, score, 0])
                    continue
                windows = [w for w in windows if den * score >= num * w[1] and w[2] < params.negatives]
                for w in windows:
                    if score <= w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], other, w[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _held(anchors: pa.Table, params: HardNegativeParams) -> list[_Anchors]:
    ids, label = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy()
    return [_Anchors(ids[rows], label[rows], x, np.zeros((len(rows), 0), np.int64)) for rows, x in _by_length(anchors, params.scale).values()]


def _open(held: list[_Anchors], positives: pa.Table, params: HardNegativeParams) -> list[_Anchors]:
    """``held`` with the positives' scores as windows."""
    of: dict[int, list[int]] = {}
    for anchor, score in zip(positives["anchor_id"].to_pylist(), positives["positive_score"].to_pylist(), strict=True):
        of.setdefault(anchor, []).append(score)
    for a in held:
        rows = [sorted(set(of.get(i, ())), reverse=True) for i in a.ids.tolist()]
        a.windows = np.array([x + [_LOW] * (params.positives - len(x)) for x in rows], np.int64).reshape(len(rows), params.positives)
    return held


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, is_anchor: Column, params: HardNegativeParams = HardNegativeParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, label, vector).

    ``is_anchor`` is a condition on ``vec_id``.
    """
    spark = rows.sparkSession
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
    with Scratch(spark) as scratch:
        least = F.min(F.struct("label", "vector")).alias("x")
        rows = scratch.keep(rows.groupBy("vec_id").agg(least).select("vec_id", "x.label", "x.vector"))
        anchors = rows.where(is_anchor)
        n, longest = anchors.agg(F.count("*"), F.max(F.size("vector"))).first()
        passes = math.ceil(n * max(longest or 1, 1) / params.anchor_values)
        out = spark.createDataFrame([], SCHEMA)
        for number in range(passes):
            part = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number).toArrow()
            if not part.num_rows:
                continue
            held = _held(part, params)
            first = spark.sparkContext.broadcast(held)
            pairs = _sorted(rows.mapInArrow(_scan(first, _positives, 0, params), _KEY))
            positives = scratch.keep(pairs.mapInArrow(_leading(params), "anchor_id long, positive_score long, positive_id long"))
            second = spark.sparkContext.broadcast(_open(held, positives.toArrow(), params))
            opened = positives.mapInArrow(_keyed, _KEY)
            pairs = _sorted(opened.unionByName(rows.mapInArrow(_scan(second, _negatives, 1, params), _KEY)))
            out = out.unionByName(cut(pairs.mapInArrow(_mined(params), SCHEMA)))
            first.unpersist()
            second.unpersist()
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: keys of positives."""
    for b in batches:
        anchor, score, other = (b.column(c).to_numpy() for c in ("anchor_id", "positive_score", "positive_id"))
        yield pa.RecordBatch.from_arrays([b.column("anchor_id"), pack(anchor, score, 0, other)], ["anchor_id", "key"])
