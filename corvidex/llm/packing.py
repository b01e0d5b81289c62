"""Packing: harmonic packing of tokenized documents into sequences of fixed capacity.

A document's ids (with the closing id) are cut into pieces: full sequences
first, then slots of a reciprocal of the capacity C. A piece of class k is at
most C/k long and over C/(k+1), and a bin of class k takes k pieces, no more and
no fewer. As in the harmonic algorithm, the last class (``classes``) holds all
pieces of up to C/classes, which fill one bin after another; a piece that
overruns its bin is cut there, so these bins are full.

Each worker fills its own bins as it reads, and no rows are brought together for
that. What it passes on are its unfilled bins, at most k - 1 pieces of a class
and one bin of the last, however much it reads. ``fan_in`` workers at a time
hand these to one task, which fills bins by the same rule and passes on as few,
until one task is left, which puts its pieces into shared sequences, largest
first. Any task of these rounds gets at most ``fan_in`` times what one passes on.

Cutting stops once a piece fills ``fill`` of its class's slot, so padding stays
near 1 - fill for the last cut and 0 for the others.

Defined cases: a null or empty text packs its closing id alone; rows with equal
or null ids are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corvidex.llm._session import cut


@dataclass(frozen=True)
class PackingParams:
    tokenizer: str  # path of a tokenizer file, readable on every executor
    end_id: int = 2
    capacity: int = 4096
    fill: float = 0.98
    classes: int = 16
    fan_in: int = 64
    memo: int = 800_000  # distinct chunks remembered by a worker at most


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker long, sequence_id long, offset long"

# A chunk of plain letters with closing marks: lower-cased letters and marks are two pre-tokens of this tokenizer.
_PLAIN = regex.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


class ChunkIds:
    """ids of texts, looked up by chunk between spaces and line ends, where this kind of tokenizer never joins.

    Most chunks are plain letters with closing marks; their lower-cased letters
    and their marks go to the tokenizer's model as they are, in its byte
    alphabet. Any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.limit = Tokenizer.from_file(path), {}, memo
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        probe = ("abcé", "ßçñ", ",.", "!?)", "x")
        self.by_space = self._whole("Xy Éa, b.\nz") == b"".join(map(self._whole, ("xy", "éa", ",", "b", ".", "z"))) and all(self._piece(p) == self._whole(p) for p in probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        letters = text.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], "<u4").tobytes()

    def _known(self, piece: str) -> bytes:
        if (ids := self.memo.get(piece)) is None:
            ids = self.memo[piece] = self._piece(piece)
        return ids

    def _fill(self, chunks: set[str]) -> None:
        other = []
        for c in chunks:
            if m := _PLAIN.fullmatch(c):
                self.memo[c] = self._known(m[1].lower()) + (self._known(m[2]) if m[2] else b"")
            else:
                other.append(c)
        for c, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.memo[c] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.by_space:
            return [self._whole(t) for t in texts]
        if len(self.memo) > self.limit:
            self.memo.clear()
        self.memo[""] = b""
        words = [t.replace("\n", " ").split(" ") for t in texts]
        if new := {w for ws in words for w in ws if w not in self.memo}:
            self._fill(new)
        look = self.memo.__getitem__
        return [b"".join(map(look, ws)) for ws in words]


@lru_cache(maxsize=1)
def _chunk_ids(path: str, memo: int) -> ChunkIds:
    return ChunkIds(path, memo)


def cuts(total: int, params: PackingParams) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``total`` ids."""
    capacity = params.capacity
    out = [(capacity, 1)] * (total // capacity)
    rest = total % capacity
    while rest:
        k = min(capacity // rest, params.classes)  # a bin of k such pieces fits
        if k == params.classes or rest >= params.fill * (capacity // k):
            out.append((rest, k))
            break
        slot = capacity // (k + 1)
        out.append((slot, k + 1))
        rest -= slot
    return out


def pack(documents: DataFrame, params: PackingParams) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    pieces = cut(documents.select("doc_id", "text").mapInArrow(_worker(params), PIECES))
    filled = pieces.where("sequence_id IS NOT NULL").select(columns)
    workers = (pieces.agg(F.max("worker")).first()[0] or 0) + 1
    for number in range(1, 64):
        left = pieces.where("sequence_id IS NULL").withColumn("group", F.floor(F.col("worker") / params.fan_in))
        workers = -(-workers // params.fan_in)
        pieces = cut(left.groupBy("group").applyInArrow(_deal(params, number, workers == 1), PIECES))
        filled = filled.unionByName(pieces.where("sequence_id IS NOT NULL").select(columns))
        if workers == 1:
            break
    return filled


class _Bins:
    """Bins by class; ``number`` counts the sequences that are full."""

    def __init__(self, params: PackingParams, first: int, step: int):
        self.params, self.held, self.rows, self.number, self.step = params, {}, [], first, step

    def close(self, k: int) -> None:
        self.rows += _sequence(self.held.pop(k), self.number)
        self.number += self.step

    def add(self, piece: tuple) -> None:
        """``piece``: (doc_id, start, length, ids_crc32, doc_tokens, class, worker). The last class's bin is closed when it has no room."""
        k = piece[5]
        held = self.held.setdefault(k, [])
        if k == self.params.classes and sum(p[2] for p in held) + piece[2] > self.params.capacity:
            self.close(k)
            held = self.held.setdefault(k, [])
        held.append(piece)
        full = sum(p[2] for p in held) == self.params.capacity if k == self.params.classes else len(held) == k
        if full:
            self.close(k)

    def room(self) -> int:
        """What the last class's bin still takes."""
        return self.params.capacity - sum(p[2] for p in self.held.get(self.params.classes, []))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def left(self) -> list[tuple]:
        return [p for held in self.held.values() for p in held]


def _worker(params: PackingParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, worker = _chunk_ids(params.tokenizer, params.memo), TaskContext.get().partitionId()
        bins, end = _Bins(params, worker << 32, 1), np.array([params.end_id], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), ids_of([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    ids, start = ids + end, 0
                    for length, k in cuts(len(ids) // 4, params):
                        # Of the last class, a piece that overruns the bin is cut at its end.
                        parts = [length]
                        if k == params.classes and length > (room := bins.room()):
                            parts = [room, length - room]
                        for n in parts:
                            bins.add((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, k, worker))
                            start += n
                yield _batch(bins.take())
        yield _batch([(*p, None, None) for p in bins.left()])

    return run


def _deal(params: PackingParams, number: int, last: bool):
    """applyInArrow: fill bins from the pieces of a group of workers; the last one fills sequences with all that is left."""
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class")

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        held = sorted(zip(*(table.column(n).to_pylist() for n in names), strict=True), key=lambda p: (-p[2], p[0] is None, p[0] or 0, *p[1:]))
        bins = _Bins(params, -1 - ((number << 50) | (group << 20)), -1)
        for p in held:
            bins.add((*p, group))
        rows, left = bins.take(), bins.left()
        if last:
            rows += [r for i, pieces in enumerate(_first_fit(left, params.capacity)) for r in _sequence(pieces, bins.number - i)]
        else:
            rows += [(*p, None, None) for p in left]
        return pa.Table.from_batches([_batch(rows)])

    return run


def _first_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    room, held = np.zeros(0, np.int64), []
    for p in sorted(pieces, key=lambda p: -p[2]):
        fits = np.flatnonzero(room >= p[2])
        at = int(fits[0]) if len(fits) else len(room)
        if not len(fits):
            room = np.append(room, capacity)
            held.append([])
        held[at].append(p)
        room[at] -= p[2]
    return held


def _sequence(pieces: list[tuple], number: int) -> list[tuple]:
    out, offset = [], 0
    for p in pieces:
        out.append((*p, number, offset))
        offset += p[2]
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = {"class": pa.int32()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names, strict=True)], names)


def padding(pieces: DataFrame, capacity: int) -> DataFrame:
    """One row: n_sequences, tokens, padded tokens (none for a sequence whose length is a power of two)."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.bit_count("tokens") == 1
    return each.agg(F.count("*").alias("n_sequences"), F.sum("tokens").alias("tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("tokens"))).alias("padding"))
