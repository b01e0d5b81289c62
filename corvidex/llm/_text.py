"""Array helpers for text in Arrow batches: word hashes and word shingles with numpy.

A word is a maximal run of ASCII letters, digits and non-ASCII characters after
lower-casing; everything else separates. Whole texts are read, in segments of
bounded size, so a very long text costs time in proportion but not memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SHINGLE_WORDS = 5

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = _U(base & (2**64 - 1))
        np.multiply.accumulate(out, out=out)
    return out


_POW = _powers(_BASE, SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 2**64), SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values, by sorting; far faster here than numpy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def slices(batch: pa.RecordBatch, column: str, limit: int = SEGMENT) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for consecutive rows of about ``limit`` characters; null is empty."""
    first, held, size = 0, [], 0
    for i, value in enumerate(batch.column(column)):
        text = value.as_py() or ""
        if held and size + len(text) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _segment_words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = _WORD[buf]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _POW[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * _INV[start]), start, end


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of the text it stands in), over all the texts."""
    hashes, rows = [], []
    joined, lengths = [], []
    size, first = 0, 0

    def flush(upto: int) -> None:
        nonlocal joined, lengths, size, first
        if joined:
            buf = np.frombuffer(b"\n".join(joined), np.uint8)
            for lo, hi in _cuts(buf):
                h, start, _ = _segment_words(buf[lo:hi])
                hashes.append(h)
                ends = np.cumsum(np.asarray(lengths) + 1)
                rows.append((first + np.searchsorted(ends, start + lo, side="right")).astype(np.int64))
        joined, lengths, size, first = [], [], 0, upto

    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "surrogatepass")
        if joined and size + len(raw) > SEGMENT:
            flush(i)
        joined.append(raw)
        lengths.append(len(raw))
        size += len(raw) + 1
    flush(len(texts))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def _cuts(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of at most SEGMENT bytes that end between words; a longer word is cut."""
    lo = 0
    while lo < len(buf):
        hi = min(lo + SEGMENT, len(buf))
        if hi < len(buf):
            gaps = np.flatnonzero(~_WORD[buf[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
        yield lo, hi
        lo = hi


def shingles(words: np.ndarray, rows: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``n`` words, its text's index); runs don't cross texts.

    A text of fewer than ``n`` words, but one at least, gives one shingle of all it has.
    """
    out = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if len(words) >= n:
        whole = rows[: len(rows) - n + 1] == rows[n - 1 :]
        value = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            value = value * _U(0x9DDFEA08EB382D69) + words[k : len(words) - n + 1 + k]
        out, at = mix(value[whole]), rows[: len(rows) - n + 1][whole]
    if len(words):
        texts, first, count = np.unique(rows, return_index=True, return_counts=True)
        short = count < n
        if short.any():
            more = [int(np.bitwise_xor.reduce(mix(words[f : f + c] + np.arange(1, c + 1, dtype=np.uint64)))) for f, c in zip(first[short], count[short], strict=True)]
            out, at = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([at, texts[short]])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()
