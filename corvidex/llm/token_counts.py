"""Token counts: count pieces once per distinct pre-token, join to per-document frequencies, sum.

The tokenizer's byte-level pre-tokens are found by their public split pattern.
One pass counts how often each pre-token occurs; each distinct one is encoded
once. The ``head`` most frequent pre-tokens with their piece counts are
broadcast (a bounded table, in which long ones stand by their digest) and summed
where the text is read; a document's remaining pre-tokens, none of them frequent,
are joined to the piece table by shuffle and summed by document. No token ids
are kept.

Defined cases: a null or empty text has no tokens; a special token's own string
inside a text counts one token, as the library does by default; rows keep their
multiplicity, also with equal or null ids.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import md5

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from corvidex.llm._session import cut

# White space of the byte-level split pattern, and the pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@dataclass(frozen=True)
class TokenCountParams:
    tokenizer: str  # path of a byte-level tokenizer file, readable on every executor
    head: int = 200_000  # pre-tokens broadcast at most
    max_head_chars: int = 40  # longer pre-tokens are broadcast as their 128-bit digest, which bounds the table
    limit: int = 1024
    memo: int = 300_000  # distinct chunks remembered by a worker at most


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _splitter(path: str):
    special = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
    return regex.compile(PATTERN), regex.compile("|".join(map(regex.escape, special))) if special else None


_RUN = regex.compile(rf"[{SPACE}][{SPACE}]")


def chunks(text: str, special) -> tuple[list[str], list[str], int]:
    """(chunks after a space, chunks as they stand, special tokens): parts of ``text`` whose pre-tokens don't depend on the rest.

    A single space between two characters that aren't white space always begins
    a pre-token, so the text is cut there; where white space repeats, the
    stretch is kept whole.
    """
    parts, found = [text], 0
    if special is not None and special.search(text):
        parts, found = special.split(text), len(special.findall(text))
    spaced, plain = [], []
    for part in parts:
        if not part:
            continue
        if _RUN.search(part):
            plain.append(part)
        else:
            head, *rest = part.split(" ")
            if head:
                plain.append(head)
            spaced += rest
    return spaced, plain, found


def count_pretokens(documents: DataFrame, params: TokenCountParams) -> DataFrame:
    """(pretoken, n) over all documents; each task sends on what it has summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, special = _splitter(params.tokenizer)
        spaced: Counter = Counter()
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            for chunk, n in spaced.items():
                for x in split.findall(" " + chunk):
                    total[x] += n
            out = pa.RecordBatch.from_pydict({"pretoken": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            spaced.clear(), total.clear()
            return out

        for b in batches:
            for value in b.column("text"):
                if text := value.as_py():
                    after, plain, _ = chunks(text, special)
                    spaced.update(after)
                    for x in plain:
                        total.update(split.findall(x))
                if len(spaced) + len(total) > params.memo:
                    yield rows()
        yield rows()

    return documents.select("text").mapInArrow(run, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))


def piece_counts(pretokens: DataFrame, params: TokenCountParams) -> DataFrame:
    """``pretokens`` with ``pieces``, the number of tokens of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(params.tokenizer)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                pieces = [len(e) for e in t.encode_batch(part.column("pretoken").to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pieces, pa.int64())], [*part.schema.names, "pieces"])

    return pretokens.mapInArrow(run, "pretoken string, n long, pieces long")


def _head(pieces: DataFrame, params: TokenCountParams) -> tuple[dict[str, int], dict[str, int]]:
    """The most frequent pre-tokens with their pieces, long ones by digest apart: all above the frequency that leaves at most ``head``.

    The frequency comes from a histogram of a bounded number of steps, so that
    the driver receives no more than the head itself.
    """
    stepped = pieces.withColumn("step", F.floor(F.log2("n") * 32))
    total, least = 0, None
    for r in sorted(stepped.groupBy("step").agg(F.count("*").alias("words")).collect(), key=lambda r: -r["step"]):
        total += r["words"]
        if total > params.head:
            break
        least = r["step"]
    if least is None:
        return {}, {}
    long = F.length("pretoken") > params.max_head_chars
    head = stepped.where(F.col("step") >= least).select(F.when(long, F.md5(F.encode("pretoken", "utf-8"))).otherwise(F.col("pretoken")).alias("key"), long.alias("long"), "pieces").toArrow()
    rows = list(zip(head["key"].to_pylist(), head["long"].to_pylist(), head["pieces"].to_pylist(), strict=True))
    return {k: n for k, is_long, n in rows if not is_long}, {k: n for k, is_long, n in rows if is_long}


def count_tokens(documents: DataFrame, params: TokenCountParams) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``documents``."""
    spark = documents.sparkSession
    pieces = cut(piece_counts(count_pretokens(documents, params), params))
    head = _head(pieces, params)
    known = spark.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, special = _splitter(params.tokenizer)
        short, long = known.value

        def pieces_of(x: str) -> int | None:
            return short.get(x) if len(x) <= params.max_head_chars else long.get(md5(x.encode()).hexdigest())

        memo: dict[str, tuple[int, tuple[str, ...]]] = {}

        def look(chunk: str) -> tuple[int, tuple[str, ...]]:
            got = [(pieces_of(x), x) for x in split.findall(chunk)]
            return sum(n for n, _ in got if n is not None), tuple(x for n, x in got if n is None)

        for b in batches:
            done, tails, counts, ends = [], [], [], [0]
            for value in b.column("text"):
                text, total, tail = value.as_py() or "", 0, Counter()
                after, plain, found = chunks(text, special)
                for chunk, n in Counter(after).items():
                    if (x := memo.get(chunk)) is None:
                        if len(memo) > params.memo:
                            memo.clear()
                        x = memo[chunk] = look(" " + chunk)
                    total += n * x[0]
                    for y in x[1]:
                        tail[y] += n
                for chunk in plain:
                    n, more = look(chunk)
                    total += n
                    tail.update(more)
                done.append(total + found)
                tails.extend(tail)
                counts.extend(tail.values())
                ends.append(len(tails))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(tails, pa.string()), pa.array(counts, pa.int64())], ["pretoken", "n"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(done, pa.int64()), rest], ["doc_id", "n_bytes", "n_known", "tail"])

    texts = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    read = texts.mapInArrow(run, "doc_id long, n_bytes long, n_known long, tail array<struct<pretoken:string,n:long>>")
    entries = read.withColumn("row_id", F.monotonically_increasing_id()).select("row_id", "doc_id", "n_bytes", "n_known", F.explode_outer("tail").alias("x"))
    # A row without a rest has one entry with a null pre-token. Such entries get keys of their own, to be dealt evenly.
    key = F.coalesce("x.pretoken", F.concat(F.lit("\x00"), F.col("row_id").cast("string")))
    entries = entries.select("row_id", "doc_id", "n_bytes", "n_known", key.alias("pretoken"), F.col("x.n").alias("freq"))
    joined = entries.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
    n_tokens = F.max("n_known") + F.sum(F.coalesce(F.col("freq") * F.col("pieces"), F.lit(0)))
    summed = joined.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), n_tokens.alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > params.limit).alias("over_limit"))
