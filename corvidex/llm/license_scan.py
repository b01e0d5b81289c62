"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by size: class S holds those of S/2 to S five-word
shingles (S a power of two). For each class a text's shingles are cut into
stretches of S; a window is two stretches on end. A band is one minimum, and an
index leads from a band's minimum to the templates that have it. A copy that
stands whole in a window has a Jaccard similarity of at least a quarter with it
(an eighth at the smallest S); one that words were put into, spread over three
stretches, still has at least 0.087 with one of its windows. With ``bands`` bands
they are retrieved with a chance of 1 - (1 - similarity)^bands: over 0.99999
and over 0.9998. A retrieved window is verified with one stretch more on either
side, which must hold at least ``containment`` of the template's shingles.

Minima of a longer stretch are those of the two shorter ones it consists of, so
all classes together read a text's shingles once for each band.

Defined cases: null and empty texts match nothing, as do templates without
words; words ignore case and punctuation; texts and templates of under five
words are one shingle; each row of a repeated document reports its matches.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvidex.llm._text import shingles, slices, word_hashes
from corvidex.llm.license_texts import TEMPLATES

_U = np.uint64
_BUCKET_BITS = 12


@dataclass(frozen=True)
class LicenseParams:
    bands: int = 96
    containment: float = 0.8
    smallest: int = 4


@dataclass(frozen=True)
class _Class:
    names: list[str]
    shingles: list[np.ndarray]  # sorted
    minima: list[np.ndarray]  # by band: the templates' minima, sorted
    holders: list[np.ndarray]  # by band: the template of each
    buckets: np.ndarray  # (bands, leading bits): whether some minimum begins so

    def retrieve(self, band: int, least: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, template) for windows whose least value in the band is a template's."""
        some = np.flatnonzero(self.buckets[band][least >> _U(64 - _BUCKET_BITS)])
        lo, hi = (np.searchsorted(self.minima[band], least[some], side) for side in ("left", "right"))
        for k in np.flatnonzero(hi > lo):
            for t in self.holders[band][lo[k] : hi[k]].tolist():
                yield int(some[k]), t


def _seeds(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return rng.integers(1, 2**63, bands, dtype=np.uint64) | _U(1), rng.integers(0, 2**63, bands, dtype=np.uint64)


def _classes(templates: Mapping[str, str], params: LicenseParams) -> dict[int, _Class]:
    """By stretch: the index of the templates of that size."""
    a, b = _seeds(params.bands)
    by: dict[int, list[tuple[str, np.ndarray]]] = {}
    for name, text in templates.items():
        found = np.unique(shingles(*word_hashes([text]))[0])
        if len(found):
            size = params.smallest
            while size < len(found):
                size *= 2
            by.setdefault(size, []).append((name, found))
    out = {}
    for size, held in by.items():
        minima = np.array([[(s * a[h] + b[h]).min() for _, s in held] for h in range(params.bands)])
        order = np.argsort(minima, axis=1)
        buckets = np.zeros((params.bands, 1 << _BUCKET_BITS), bool)
        for h in range(params.bands):
            buckets[h, minima[h] >> _U(64 - _BUCKET_BITS)] = True
        out[size] = _Class([n for n, _ in held], [s for _, s in held], list(np.take_along_axis(minima, order, 1)), list(order), buckets)
    return out


def _stretches(rows: np.ndarray, smallest: int, largest: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By size, doubling: (size, its first shingles, their places among those of half the size, whether the next is of the same text)."""
    out, of, at = [], rows, np.arange(len(rows))
    size = 1
    step = smallest
    while size < largest:
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        place = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        begins = np.flatnonzero(place % step == 0)
        of, at, size, step = of[begins], at[begins], size * step, 2
        out.append((size, at, begins, np.append(of[1:] == of[:-1], False)))
    return out


def _matches(value: np.ndarray, rows: np.ndarray, classes: Mapping[int, _Class], params: LicenseParams) -> list[tuple[int, str, int, float]]:
    """(text index, template, windows, best containment)."""
    if not len(value) or not classes:
        return []
    a, b = _seeds(params.bands)
    levels = _stretches(rows, params.smallest, max(classes))
    hits: set[tuple[int, int, int]] = set()
    for h in range(params.bands):
        least = value * a[h] + b[h]
        for level, (size, _, begins, follows) in enumerate(levels):
            least = np.minimum.reduceat(least, begins)
            if size in classes:
                window = least.copy()
                window[:-1] = np.where(follows[:-1], np.minimum(least[:-1], least[1:]), least[:-1])
                hits.update((level, w, t) for w, t in classes[size].retrieve(h, window))
    best: dict[tuple[int, str], tuple[int, float]] = {}
    for level, w, t in sorted(hits):
        size, at, _, follows = levels[level]
        held, end = classes[size], np.append(at[1:], len(value))
        last = w + int(follows[w])
        lo = at[w - 1] if w and follows[w - 1] else at[w]
        hi = end[last + 1] if follows[last] else end[last]
        share = float(np.isin(held.shingles[t], value[lo:hi]).mean())
        if share >= params.containment:
            k = (int(rows[at[w]]), held.names[t])
            n, most = best.get(k, (0, 0.0))
            best[k] = (n + 1, max(most, share))
    return [(row, name, n, share) for (row, name), (n, share) in sorted(best.items())]


def scan_licenses(documents: DataFrame, templates: Mapping[str, str] = TEMPLATES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """(doc_id, license, n_windows, containment) of each template that a row's text holds."""
    classes = _classes(templates, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("doc_id"), []
            for lo, texts in slices(batch, "text", 1 << 18):
                value, rows = shingles(*word_hashes(texts))
                out += [(ids[lo + row].as_py(), name, n, share) for row, name, n, share in _matches(value, rows, classes, params)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [ids.type, pa.string(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "license", "n_windows", "containment"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, n_windows long, containment double")
