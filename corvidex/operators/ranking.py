"""The first chunks of very many queries: sums of a task's chunks over all queries in arrays, instead of one row for each chunk, term and query.

Spark deals, joins and orders the rows; what runs here is one task's share, in
blocks of whole chunks, so that memory doesn't grow with the share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

BLOCK = 2_000_000  # parts and sums of chunks and queries that are held at once
NEAR = 1e-11  # ranks are rounded to 12 places: what lies so near may tie


def sums(no: np.ndarray, part: np.ndarray, chunk: np.ndarray, begin: np.ndarray, queries: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk, query, sum as of ``search.exact_sum``) of terms' parts; term i is in the ``queries`` from ``begin[i]`` to ``begin[i + 1]``, ``n`` in all."""
    times = begin[no + 1] - begin[no]
    row = np.repeat(np.arange(len(no)), times)
    query = queries[np.arange(len(row)) + (begin[no] - np.cumsum(times) + times)[row]]
    code = chunk[row] * n + query
    cells = (int(chunk[-1]) + 1) * n
    high = np.floor(part * 2.0**24) / 2.0**24
    total = lambda at, size: np.bincount(at, high[row], size) + np.bincount(at, (part - high)[row], size)
    if cells <= 8 * len(code):
        held = np.zeros(cells, bool)
        held[code] = True
        found = np.flatnonzero(held)
        return found // n, found % n, total(code, cells)[found]
    found, at = np.unique(code, return_inverse=True)
    return found // n, found % n, total(at, len(found))


def among_first(query: np.ndarray, score: np.ndarray, k: int, floor: np.ndarray) -> np.ndarray:
    """Which rows may be among their query's first ``k``, ties included; raises ``floor``, each query's k-th score as far as known."""
    # Small numbers are sorted in a few passes; scores only need their k-th one.
    order = np.argsort(query.astype(np.uint16) if len(floor) <= 1 << 16 else query, kind="stable")
    first, ordered = np.searchsorted(query[order], np.arange(len(floor) + 1)), score[order]
    for q in np.flatnonzero(first[:-1] + k <= first[1:]):
        own = ordered[first[q] : first[q + 1]]
        floor[q] = max(floor[q], np.partition(own, len(own) - k)[len(own) - k])
    return score >= floor[query] - NEAR


def first_sums(key: Sequence[str], keep: Sequence[str], pairs: np.ndarray, qids: pa.Array, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over (key, keep, no, part, allowed) in the order of ``key``: (qid, keep, score) of all that may be among a query's first ``k``, where ``allowed`` is true.

    ``pairs`` (term's number, query's number) are sorted.
    """
    n = len(qids)
    begin, queries = np.searchsorted(pairs[:, 0], np.arange(pairs[-1, 0] + 2)), np.ascontiguousarray(pairs[:, 1])
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(n, -np.inf)
        held: list[tuple] = []  # chunks, and the chunk, query and score of each sum

        def prune() -> None:
            chunks = pa.concat_tables([x[0] for x in held])
            starts = np.cumsum([0, *[len(x[0]) for x in held[:-1]]])
            chunk, query, score = np.concatenate([x[1] + s for x, s in zip(held, starts)]), *[np.concatenate([x[i] for x in held]) for i in (2, 3)]
            stay = among_first(query, score, k, floor)
            used, chunk = np.unique(chunk[stay], return_inverse=True)
            held[:] = [(chunks.take(pa.array(used)), chunk, query[stay], score[stay])]

        def give() -> Iterator[pa.RecordBatch]:
            for chunks, chunk, query, score in held:
                columns = [qids.take(pa.array(query)), *chunks.take(pa.array(chunk)).columns, pa.array(score)]
                yield from pa.table(columns, ["qid", *keep, "score"]).combine_chunks().to_batches(10_000)
            held.clear()

        def whole(table: pa.Table, last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
            """Blocks of whole chunks, each with where they begin; a chunk's parts are at most all terms', so one chunk is small."""
            new = np.ones(len(table), bool)
            new[1:] = np.logical_or.reduce([(x := table[c].to_numpy())[1:] != x[:-1] for c in key])
            edges = np.append(np.flatnonzero(new), len(table))
            load = np.append(0, np.cumsum(np.diff(begin)[table["no"].to_numpy()]))[edges]
            i, end = 0, len(edges) - (1 if last else 2)  # the last chunk may go on in the next batch
            while i < end:
                j = min(end, max(i + 1, int(np.searchsorted(load, load[i] + BLOCK, "right")) - 1))
                yield table.slice(edges[i], edges[j] - edges[i]), new[edges[i] : edges[j]]
                i = j
            rest[:] = [table.slice(edges[end])]

        rest: list[pa.Table] = []
        size, batch = 0, next(batches, None)
        while batch is not None:
            following = next(batches, None)
            table = pa.concat_tables([*rest, pa.Table.from_batches([batch]).filter(batch.column("allowed"))])
            if not len(table):
                rest.clear()
            else:
                for rows, new in whole(table, following is None):
                    chunk, query, score = sums(rows["no"].to_numpy(), rows["part"].to_numpy(), np.cumsum(new) - 1, begin, queries, n)
                    stay = score >= floor[query] - NEAR
                    held.append((rows.select(keep).take(pa.array(np.flatnonzero(new))), chunk[stay], query[stay], score[stay]))
                    size += int(stay.sum())
                    if size > BLOCK:
                        prune()
                        if (size := len(held[0][3])) > BLOCK // 2:
                            yield from give()
                            size = 0
            batch = following
        if held:
            prune()
            yield from give()

    return run
