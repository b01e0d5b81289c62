"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND, then verified.

Statistics cover all items: Spark counts the documents of each term, and an
item's term weights are its BM25 impacts as shares of their sum, so a passage
that holds all its terms scores 1. Items of similar length (up to S words, S a
power of two) are indexed together; a text's passages for them are stretches of
2S words, every S words, so one holds any copy of an item whole.

Each passage queries the index. What can't reach the threshold is ruled out
first, for many passages at once: the rarest terms of an item that make up the
share ``rare`` of its weight are looked up, and a passage that misses more than
1 - threshold of the whole weight among them is done with that item. Passages
with an item left run *block-max WAND*: a cursor on each term's postings, the
pivot where the terms' largest weights first reach the threshold, the largest
weights of the blocks at the pivot as a second bound, and skipping to the end of
the blocks where that fails. Every item at the threshold or above is retrieved;
there is no top-k.

Retrieved items are verified: of the five-word shingles in an item's question
(all before its last line or sentence) and of those that touch its answer, the
document must hold at least the set share.

The corpus is read once for each ``max_postings`` postings of the benchmark,
which bounds what is broadcast; test sets of the usual size take one pass.

Defined cases: null and empty texts match nothing; items without words are no
items; items of under five words are one shingle; repeated documents each
match; repeated item ids are reported once, by their best item.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvidex.llm._session import cut
from corvidex.llm._text import SHINGLE_WORDS, distinct, mix, slices, word_hashes

_U = np.uint64


@dataclass(frozen=True)
class DecontaminationParams:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.6  # of an item's own score
    min_overlap: float = 0.6  # of question shingles and of answer shingles
    rare: float = 0.75  # share of an item's weight that its rarest terms are looked up for
    block: int = 16  # postings of a block
    smallest: int = 32  # words
    max_postings: int = 4_000_000  # of a pass over the corpus


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last line, else the last sentence, else empty."""
    text = text.strip()
    if "\n" in text:
        question, _, answer = text.rpartition("\n")
    else:
        ends = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
        question, answer = (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")
    return question, answer


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    if len(words) < n or not n:
        return np.zeros(0, np.uint64)
    value = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        value = value * _U(0x9DDFEA08EB382D69) + words[k : len(words) - n + 1 + k]
    return mix(value)


def _parts(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    question, answer = (word_hashes([x])[0] for x in split_item(text))
    words = np.concatenate([question, answer])
    n = min(SHINGLE_WORDS, len(words))
    runs = _runs(words, n)
    inside = max(len(question) - n + 1, 0)
    return n, runs[:inside], runs[inside:]


ITEM = "n_words long, n int, question array<long>, answer array<long>, terms array<long>, tfs array<long>"


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (item_id, the columns of ITEM) of items with words."""
    for b in batches:
        rows, kept = [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            words = word_hashes([text or ""])[0]
            if len(words):
                n, question, answer = _parts(text)
                terms, tfs = np.unique(words, return_counts=True)
                kept.append(i)
                rows.append((len(words), n, question.view(np.int64), answer.view(np.int64), terms.view(np.int64), tfs))
        kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(kept, pa.int64())), *columns], ["item_id", *[x.split()[0] for x in ITEM.split(", ")]])


def weighed_items(benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> tuple[DataFrame, int]:
    """(item_id, n_words, n, question, answer, weights as (term, df, weight)) of each item, and the number of postings."""
    kind = dict(benchmark.dtypes)["item_id"]
    items = benchmark.select("item_id", "text").mapInArrow(_read_items, f"item_id {kind}, {ITEM}")
    items = cut(items.withColumn("no", F.monotonically_increasing_id()))
    n_items, n_words, postings = items.agg(F.count("*"), F.sum("n_words"), F.sum(F.size("terms"))).first()
    each = items.select("no", "n_words", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("no", "n_words", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    df = cut(each.groupBy("term").agg(F.count("*").alias("df")))  # a term of all items can then be split over tasks in the join
    idf = F.log(1 + (F.lit(n_items) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = params.k1 * (1 - params.b + params.b * F.col("n_words") / F.lit((n_words or 0) / max(n_items, 1)))
    impact = idf * F.col("tf") * (params.k1 + 1) / (F.col("tf") + norm)
    found = each.join(df, "term").select("no", F.struct("term", "df", impact.alias("weight")).alias("x")).groupBy("no").agg(F.sort_array(F.collect_list("x")).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda s, y: s + y["weight"])
    found = found.select("no", F.transform("x", lambda y: F.struct(y["term"].alias("term"), y["df"].alias("df"), (y["weight"] / total).alias("weight"))).alias("weights"))
    return items.drop("terms", "tfs").join(found, "no"), postings or 0


@dataclass
class Index:
    """Postings of items of at most ``stretch`` words; lists of a term are cut into blocks."""

    stretch: int
    ids: list
    terms: np.ndarray  # sorted hashes
    start: np.ndarray  # first posting of each term, and the end
    item: np.ndarray
    weight: np.ndarray
    rare_start: np.ndarray  # likewise, of the items' rarest terms alone
    rare_item: np.ndarray
    rare_weight: np.ndarray
    needed: np.ndarray  # by item: what a passage has to hold of the rarest terms' weight
    parts: list[tuple[int, np.ndarray, np.ndarray]]  # by item: shingle length, question and answer shingles
    block: int
    cursors: dict = field(default_factory=dict)

    def postings(self, term: int) -> tuple[list, list, list, list, float]:
        """(items, weights, last item of each block, largest weight of each block, largest weight) of a term."""
        if (found := self.cursors.get(term)) is None:
            a, b = int(self.start[term]), int(self.start[term + 1])
            items, weights = self.item[a:b].tolist(), self.weight[a:b].tolist()
            at = range(0, len(items), self.block)
            tops = [max(weights[i : i + self.block]) for i in at]
            found = self.cursors[term] = items, weights, [items[min(i + self.block, len(items)) - 1] for i in at], tops, max(tops)
        return found


def build(rows: list[dict], params: DecontaminationParams) -> list[Index]:
    """An index for each class of lengths."""
    by: dict[int, list[dict]] = {}
    for r in rows:
        size = params.smallest
        while size < r["n_words"]:
            size *= 2
        by.setdefault(size, []).append(r)
    return [_index(size, sorted(held, key=lambda r: r["n_words"]), params) for size, held in sorted(by.items())]


def _csr(terms: np.ndarray, term: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((item, term))
    return np.searchsorted(term[order], np.arange(len(terms) + 1)), item[order].astype(np.int32), weight[order]


def _index(stretch: int, held: list[dict], params: DecontaminationParams) -> Index:
    hashes, items, weights, rare, needed = [], [], [], [], []
    for i, r in enumerate(held):
        x = sorted(r["weights"], key=lambda y: (y["df"], y["term"]))
        w = np.array([y["weight"] for y in x])
        # The terms before which less than the share ``rare`` is reached.
        first = np.cumsum(w) - w < params.rare
        hashes.append(np.array([y["term"] for y in x], np.int64).view(_U))
        items.append(np.full(len(x), i))
        weights.append(w)
        rare.append(first)
        needed.append(w[first].sum() - (1 - params.threshold))
    hashes, item, weight, first = np.concatenate(hashes), np.concatenate(items), np.concatenate(weights), np.concatenate(rare)
    terms = np.unique(hashes)
    term = np.searchsorted(terms, hashes)
    parts = [(r["n"], *(np.array(r[k], np.int64).view(_U) for k in ("question", "answer"))) for r in held]
    return Index(stretch, [r["item_id"] for r in held], terms, *_csr(terms, term, item, weight), *_csr(terms, term[first], item[first], weight[first]), np.array(needed), parts, params.block)


def block_max_wand(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items whose weights for ``terms`` sum to the threshold or more."""
    lists = {t: index.postings(t) for t in terms}
    cursors = [(lists[t][0][0], t, 0) for t in terms]  # (item, term, place in its postings)
    found = []

    def ahead(cursor: tuple[int, int, int], item: int) -> tuple[int, int, int] | None:
        """The cursor at the first posting of ``item`` or a later one."""
        items = lists[cursor[1]][0]
        at = bisect_left(items, item, cursor[2])
        return (items[at], cursor[1], at) if at < len(items) else None

    while cursors:
        cursors.sort()
        reach, pivot = 0.0, None
        for i, (_, t, _) in enumerate(cursors):
            reach += lists[t][4]
            if reach >= threshold:
                pivot = i
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        bound, end = 0.0, None
        for _, t, _ in cursors[: pivot + 1]:
            last, tops = lists[t][2:4]
            if (b := bisect_left(last, item)) < len(last):
                bound += tops[b]
                end = last[b] if end is None else min(end, last[b])
        if bound < threshold:  # no item up to the end of these blocks, or to the next cursor, can reach it
            to = end + 1 if end is not None else item + 1
            if pivot + 1 < len(cursors):
                to = min(to, cursors[pivot + 1][0])
        elif cursors[0][0] == item:
            score = sum(lists[t][1][at] for _, t, at in cursors[: pivot + 1])
            if score >= threshold:
                found.append((item, score))
            to = item + 1
        else:
            to = item
        cursors = [x for c in cursors[: pivot + 1] if (x := ahead(c, to))] + cursors[pivot + 1 :]
    return found


def _passages(words: np.ndarray, rows: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch number of each word, text index of each stretch); a passage is two stretches of a text on end."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    begins = place % stride == 0
    return np.cumsum(begins) - 1, rows[begins]


def retrieve(words: np.ndarray, rows: np.ndarray, index: Index, params: DecontaminationParams) -> list[tuple[int, int, float]]:
    """(text index, item number, best passage score) of all at the threshold or above."""
    if not len(words) or not len(index.terms):
        return []
    stretch, text_of = _passages(words, rows, index.stretch)
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    hit = index.terms[term] == words
    term, stretch = term[hit], stretch[hit]
    # Passage p is stretch p with p + 1, if that is of the same text.
    before = stretch > 0
    before[before] = text_of[stretch[before] - 1] == text_of[stretch[before]]
    size = len(index.terms)
    key = distinct(np.concatenate([stretch * size + term, (stretch[before] - 1) * size + term[before]]))
    passage, term = key // size, key % size
    # What passages hold of each item's rarest terms.
    count = index.rare_start[term + 1] - index.rare_start[term]
    at = np.repeat(index.rare_start[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
    if not len(at):
        return []
    pair = np.repeat(passage, count) * len(index.ids) + index.rare_item[at]
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    held = np.add.reduceat(index.rare_weight[at][order], first)
    pair = pair[first]
    threshold = params.threshold - 1e-9
    live = distinct(pair[held >= index.needed[pair % len(index.ids)] - 1e-9] // len(index.ids))
    best: dict[tuple[int, int], float] = {}
    for p, lo, hi in zip(live.tolist(), np.searchsorted(passage, live).tolist(), np.searchsorted(passage, live, side="right").tolist(), strict=True):
        for item, score in block_max_wand(index, term[lo:hi].tolist(), threshold):
            k = (int(text_of[p]), item)
            best[k] = max(best.get(k, 0.0), score)
    return [(r, i, s) for (r, i), s in best.items()]


_FOUND = ["score", "question_overlap", "answer_overlap"]


def _matches(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> DataFrame:
    """(doc_id, k1, k2, item_id, score, question_overlap, answer_overlap) of each item in each row of ``documents``; k1 and k2 are hashes of the text."""
    spark = documents.sparkSession
    kind = dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id long, k1 long, k2 long, item_id {kind}, score double, question_overlap double, answer_overlap double"
    items, postings = weighed_items(benchmark, params)
    item_type = spark.createDataFrame([], f"item_id {kind}").toArrow().schema.field(0).type
    items, passes = cut(items), -(-postings // params.max_postings)
    out = spark.createDataFrame([], schema)
    rows_of = documents.select("doc_id", "text", *_hashes("text"))
    for n in range(passes):
        rows = items.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == n).drop("no").toArrow().to_pylist()
        shared = spark.sparkContext.broadcast(build(rows, params))
        out = out.unionByName(rows_of.mapInArrow(_scan(shared, params, item_type), schema))
    return out


def _hashes(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def contaminated(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each item that a document holds; rows of one id (null is one) count as one document."""
    best = _matches(documents, benchmark, params).groupBy("doc_id", "item_id").agg(F.max(F.struct(*_FOUND)).alias("x"))
    return best.select("doc_id", "item_id", *[F.round(f"x.{c}", 6).alias(c) for c in _FOUND])


def _share(wanted: np.ndarray, held: np.ndarray) -> float:
    return float(np.isin(wanted, held).mean()) if len(wanted) else 1.0


def _scan(shared, params: DecontaminationParams, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, k1, k2, found = *(batch.column(c) for c in ("doc_id", "k1", "k2")), []
            for lo, texts in slices(batch, "text"):
                words, rows = word_hashes(texts)
                runs: dict[tuple[int, int], np.ndarray] = {}
                for index in shared.value:
                    for row, item, score in retrieve(words, rows, index, params):
                        n, question, answer = index.parts[item]
                        if (row, n) not in runs:
                            a, b = np.searchsorted(rows, [row, row + 1])
                            runs[row, n] = _runs(words[a:b], n)
                        q, a = _share(question, runs[row, n]), _share(answer, runs[row, n])
                        if q >= params.min_overlap and a >= params.min_overlap:
                            found.append((*(c[lo + row].as_py() for c in (ids, k1, k2)), index.ids[item], score, q, a))
            names = ["doc_id", "k1", "k2", "item_id", *_FOUND]
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            kinds = [ids.type, pa.int64(), pa.int64(), item_type, *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``documents`` without the rows whose text holds an item, whatever their id."""
    gone = _matches(documents, benchmark, params).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = _hashes("text")
    return documents.join(gone, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left_anti").select(documents.columns)
