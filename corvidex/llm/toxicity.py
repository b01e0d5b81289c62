"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

``fit`` learns from labelled documents; ``score`` reads whole texts. A feature
is the presence of a hashed character n-gram (lower-cased code points, the text
bounded by spaces), scaled by the log ratio of its smoothed shares in toxic and
clean documents; the vector has unit length, and a logistic regression weighs it.

Defined cases: a null or empty text scores as the model's bias alone; rows
without a usable label are not learnt from; repeated labels of a document count
once, toxic if any says so; without any labelled row of both kinds, ``fit``
gives a model that scores every text by the share of toxic labels (0 if none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvidex.llm._session import cut
from corvidex.llm._text import distinct, mix, slices

_U = np.uint64


@dataclass(frozen=True)
class ToxicityParams:
    orders: tuple[int, ...] = (5, 6, 7)
    hash_bits: int = 20
    features: int = 32768  # kept: those of the largest |ratio| * sqrt(documents)
    min_documents: int = 3
    train_rows: int = 8000  # bound of the labelled sample that the classifier is fitted on
    steps: int = 100
    ridge: float = 0.1  # over the number of rows
    threshold: float = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    slot: np.ndarray  # hash bucket to feature, -1 where none
    weight: np.ndarray  # log-count ratio times learnt weight
    ratio: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _runs(texts: list[str], limit: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, text index of each): texts bounded by spaces, joined up to ``limit``; longer ones in overlapping parts."""
    points, rows, size = [], [], 0
    for i, text in enumerate(texts):
        p = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        for lo in range(0, max(len(p) - overlap, 1), limit):
            part = p[lo : lo + limit + overlap]
            if points and size + len(part) > limit:
                yield np.concatenate(points), np.concatenate(rows)
                points, rows, size = [], [], 0
            points.append(part)
            rows.append(np.full(len(part), i, np.int64))
            size += len(part)
    if points:
        yield np.concatenate(points), np.concatenate(rows)


def _present(texts: list[str], params: ToxicityParams, slot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) once for each feature that a text has."""
    width = int(slot.max()) + 2 if slot is not None else 1 << params.hash_bits
    found = [np.zeros(0, np.int64)]
    for points, rows in _runs(texts, 1 << 18, max(params.orders) - 1):
        value, here = np.zeros(len(points), _U), [found[0]]
        for n in range(1, max(params.orders) + 1):
            if len(points) < n:
                break
            value = value[: len(points) - n + 1] * _U(0x9E3779B97F4A7C15) + (points[n - 1 :] + _U(n))
            if n in params.orders:
                bucket = (mix(value) >> _U(64 - params.hash_bits)).astype(np.int64)
                row = rows[: len(bucket)]
                keep = row == rows[n - 1 :]
                if slot is not None:
                    bucket = slot[bucket].astype(np.int64)
                    keep &= bucket >= 0
                here.append(row[keep] * width + bucket[keep])
        found.append(distinct(np.concatenate(here)))
    key = distinct(np.concatenate(found))
    return key // width, key % width


def _sample(documents: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """At most ``train_rows`` labelled documents, chosen by a hash of their id: (doc_id, toxic, text); of an id's texts, the one of the least hash."""
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.train_rows)
    )
    found = documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", "toxic", "x.text")


def fit(documents: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    sample = cut(_sample(documents, labels, params))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << params.hash_bits), np.int64)
        docs = np.zeros(2, np.int64)
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            docs += np.bincount(toxic, minlength=2)
            for lo, texts in slices(b, "text"):
                row, bucket = _present(texts, params, None)
                for y in (0, 1):
                    total[y] += np.bincount(bucket[toxic[lo + row] == y], minlength=total.shape[1])
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"bucket": np.append(some, -1), "clean": np.append(total[0][some], docs[0]), "toxic": np.append(total[1][some], docs[1])})

    summed = sample.mapInArrow(counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    docs = summed.where("bucket = -1").first()
    clean, toxic = (docs["clean"], docs["toxic"]) if docs else (0, 0)
    size = 1 << params.hash_bits
    if not clean or not toxic:
        share = toxic / max(clean + toxic, 1)
        bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return ToxicityModel(params, np.full(size, -1, np.int32), np.zeros(1), np.zeros(1), bias)

    ratio = F.log((F.col("toxic") + 1) / (toxic + 2)) - F.log((F.col("clean") + 1) / (clean + 2))
    chosen = (
        summed.where((F.col("bucket") >= 0) & (F.col("clean") + F.col("toxic") >= params.min_documents))
        .select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(F.col("clean") + F.col("toxic"))).alias("gain"))
        .orderBy(F.desc("gain"), "bucket")
        .limit(params.features)
        .toArrow()
    )
    slot = np.full(size, -1, np.int32)
    slot[chosen["bucket"].to_numpy()] = np.arange(len(chosen), dtype=np.int32)
    ratios = chosen["ratio"].to_numpy()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists: list[np.ndarray] = []
            for _, texts in slices(b, "text"):
                row, feature = _present(texts, params, slot)
                lists += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "toxic", "features"])

    rows = sample.mapInArrow(present, "doc_id long, toxic int, features array<int>").toArrow().sort_by("doc_id")
    weight, bias = _logistic(rows, ratios, params)
    return ToxicityModel(params, slot, weight * ratios, ratios, bias)


def _logistic(rows: pa.Table, ratios: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Adam on the bounded sample's sparse rows, block by block of rows."""
    y, n = rows["toxic"].to_numpy().astype(float), rows.num_rows
    blocks = []
    for lo in range(0, n, 500):
        lists = rows["features"].slice(lo, 500).combine_chunks()
        feature = lists.flatten().to_numpy().astype(np.int32)
        at = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        value = ratios[feature]
        value /= np.sqrt(np.maximum(np.bincount(at, value * value, len(lists)), 1e-12))[at]
        blocks.append((y[lo : lo + 500], at, feature, value.astype(np.float32)))
    w, b = np.zeros(len(ratios)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, params.steps + 1):
        g, gb = params.ridge * w / n, 0.0
        for labels, at, feature, value in blocks:
            miss = (_sigmoid(np.bincount(at, value * w[feature], len(labels)) + b) - labels) / n
            g += np.bincount(feature, value * miss[at], len(w))
            gb += float(miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.3 * (m / a) / (np.sqrt(v / c) + 1e-9)
        b -= 0.3 * (mb / a) / (np.sqrt(vb / c) + 1e-9)
    return w, b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(documents: DataFrame, model: ToxicityModel, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``documents`` with a score and a prediction in place of any columns of those names."""
    kept = [c for c in documents.columns if c.lower() not in names]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = np.zeros(b.num_rows)
            for lo, texts in slices(b, "text"):
                row, feature = _present(texts, m.params, m.slot)
                n = len(texts)
                norm = np.sqrt(np.maximum(np.bincount(row, m.ratio[feature] ** 2, n), 1e-12))
                s[lo : lo + n] = _sigmoid(np.bincount(row, m.weight[feature], n) / norm + m.bias)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= m.params.threshold).astype(np.int32))], [*b.schema.names, *names])

    schema = documents.select(*kept).schema.add(names[0], "double").add(names[1], "integer")
    return documents.select(*kept).mapInArrow(run, schema)
