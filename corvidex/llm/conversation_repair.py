"""Conversation structure repair: cheapest edits from a suffix-shared automaton over role and fault signatures.

Each row of a conversation becomes one symbol: its role's initial, whether its
text is truncated, or that it has to go (blank or seen before). A conversation's
symbols are its signature. The distinct signatures of all conversations are
sorted from the end and dealt in ranges; read in this order, each shares a path
from the end with the one before, and only nodes behind that path are new, so
every suffix is one node, made once (but for the path at the border of a range).
A node holds the cost to go and the best edit for each state of the grammar, and
nodes with equal costs, less their least, step alike: a step is worked out once
for each kind of node and symbol. A signature's audit is read off its path.

States of the grammar ``(s?(ua)+)?``: nothing yet, after a leading s, after u,
after a. All edits at a state have different initials, so among the cheapest the
least initial gives the least audit.

The rows of each conversation, sorted, then meet its audit at their head and are
hashed as a stream. No conversation is held as a whole: only its signature and
audit, a byte for each row.

Defined cases: a null id, turn, role or text counts as one space (a null id is a
conversation of its own, null in the result; a null turn comes first and has no
part in gaps); rows of one turn go by role, then by a 128-bit hash of the text,
so repeated rows are neighbours; an empty role has no initial and is not legal;
gaps beyond 64 bits count as the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvidex.llm._session import Scratch, cut

_SPACES = " \t\n\x0b\x0c\r"
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class RepairParams:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


# The grammar: state to {initial: next state}; the initial that user or assistant give; states where a conversation may end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_WANTED = ("u", "u", "a", "u")
_ROLE = {"u": "user", "a": "assistant"}
_LAST = (0, 3)
_NEVER = 1 << 40
GONE = "x"  # the symbol of a row that has to go; others are s, u, a, o, in upper case if truncated


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults put in by a hash of (conv_id, turn), ``copy`` and whether the row is ``lost``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(kind == 4, "user").otherwise(shown("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), F.explode(copies).alias("copy"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("turn", "role", "k1", "k2", "copy")]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, k1, k2, copy, lost, initial, fault) of ``rows``: the first that holds of blank, duplicate, truncated, or ''."""
    core = F.rtrim(F.col("text"), F.lit(_SPACES))
    closed = F.substring(core, -1, 1).isin(".", "!", "?")
    narrow = _hashed(rows).select("conv_id", "turn", "role", "k1", "k2", "copy", "lost", (core == "").alias("blank"), closed.alias("closed"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "k1", "k2", "lost").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(~F.col("closed"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    return narrow.withColumn("again", again).select("conv_id", "turn", "role", "k1", "k2", "copy", "lost", initial.alias("initial"), fault.alias("fault"))


_SIGNATURE = "blank long, duplicate long, truncated long, illegal long, gaps long, signature string"
_NAMES = ["blank", "duplicate", "truncated", "illegal", "gaps", "signature"]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over rows sorted by conversation and order: each conversation's counts and signature."""
    key, held, ids = None, None, []
    done: list[tuple] = []

    def close() -> None:
        low, high, turns = held["turns"]
        done.append((held["id"], *(held[k] for k in ("blank", "duplicate", "truncated", "illegal")), min(high - low + 1 - turns, _LONG) if turns else 0, held["signature"].decode()))

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 7
        out = pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.string())], ["conv_id", *_NAMES])
        done.clear()
        return out

    kind = None
    for b in batches:
        kind = b.column("conv_id").type
        for conv, turn, initial, fault, lost in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "lost")), strict=True):
            if held is None or conv != key:
                if held is not None:
                    close()
                key = conv
                held = {"id": conv, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": (None, None, 0), "last": None, "signature": bytearray()}
            if lost:
                continue
            if fault:
                held[fault] += 1
            if held["last"] is not None and held["last"] + initial not in ("su", "ua", "au"):
                held["illegal"] += 1
            held["last"] = initial
            low, high, turns = held["turns"]
            if turn is not None and turn != high:
                held["turns"] = (turn if low is None else low, turn, turns + 1)
            symbol = initial if initial in ("s", "u", "a") else "o"
            held["signature"] += (GONE if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol).encode()
        if done:
            yield flush(kind)
    if held is not None:
        close()
        yield flush(kind)


class Automaton:
    """Steps from the node of a suffix to that of the suffix with one more symbol before it."""

    def __init__(self, params: RepairParams):
        self.params = params
        end = [0 if s in _LAST else _NEVER for s in range(4)]
        self.end = self._inserted(end, [""] * 4)
        self.steps: dict[tuple[tuple[int, ...], str], tuple[int, tuple[int, ...], str]] = {}

    def _inserted(self, cost: list[int], edit: list[str]) -> tuple[int, tuple[int, ...], str]:
        """(least cost, costs less it, edits): with inserts where they are cheaper, or as cheap and of the lesser initial."""
        change = True
        while change:
            change = False
            for s in range(4):
                c = self.params.insert + cost[_NEXT[s][_WANTED[s]]]
                if (c, "I") < (cost[s], edit[s] or ("" if cost[s] < _NEVER else "~")):
                    cost[s], edit[s], change = c, "I", True
        low = min(cost)
        return low, tuple(c - low for c in cost), "".join(e or "." for e in edit)

    def step(self, costs: tuple[int, ...], symbol: str) -> tuple[int, tuple[int, ...], str]:
        """(cost added, costs less the least, best edit of each state) of the node before ``symbol``."""
        if (found := self.steps.get((costs, symbol))) is None:
            p, initial = self.params, symbol.lower()
            more = p.truncated if symbol.isupper() else 0
            cost, edit = [], []
            for s in range(4):
                options = [(p.delete + costs[s], "D")]
                if symbol != GONE:
                    if initial in _NEXT[s]:
                        options.append((more + costs[_NEXT[s][initial]], "K"))
                    options.append((p.rerole + more + costs[_NEXT[s][_WANTED[s]]], "R"))
                c, e = min(options)
                cost.append(c)
                edit.append(e)
            found = self.steps[costs, symbol] = self._inserted(cost, edit)
        return found


def read_off(signature: str, edits: list[str]) -> str:
    """The audit of ``signature`` from the edits of its nodes: edits[k] is of the suffix of k symbols."""
    out, s, k = [], 0, len(signature)
    while (e := edits[k][s]) != ".":
        out.append(e)
        if e != "I":
            symbol = signature[len(signature) - k]
            k -= 1
        if e != "D":
            s = _NEXT[s][symbol.lower() if e == "K" else _WANTED[s]]
    return "".join(out)


def _audits(params: RepairParams):
    """mapInArrow over signatures sorted from the end: (k1, k2, cost, audit), by a stack of the nodes of the present path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Automaton(params)
        low, costs, edit = made.end
        path, totals, kinds, edits = "", [low], [costs], [edit]  # by number of symbols from the end
        for b in batches:
            out = []
            for backwards in b.column("backwards").to_pylist():
                n = _common(path, backwards)
                del totals[n + 1 :], kinds[n + 1 :], edits[n + 1 :]
                for symbol in backwards[n:]:
                    more, costs, edit = made.step(kinds[-1], symbol)
                    totals.append(totals[-1] + more)
                    kinds.append(costs)
                    edits.append(edit)
                path = backwards
                out.append((totals[-1] + kinds[-1][0], read_off(backwards[::-1], edits)))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["k1", "k2", "cost", "audit"])

    return run


def _common(a: str, b: str) -> int:
    """The length of the common beginning."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over each conversation's head and then its rows in order: the hash of what its audit makes of them."""
    key, head, audit, at, state, digest, first = None, None, "", 0, 0, None, True
    ready: list[tuple] = []

    def say(role: str, text: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        first = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            say(_ROLE[_WANTED[state]], "")
            state, at = _NEXT[state][_WANTED[state]], at + 1

    def close() -> None:
        inserts()
        ready.append((*head, digest.hexdigest()))

    names = ["blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit"]
    kind = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*ready, strict=True)) or [()] * 9
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        ready.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", *names, "repaired_sha256"])

    for b in batches:
        kind = b.column("conv_id").type
        about = [b.column(c) for c in names]
        for i, (conv, is_head, role, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "is_head", "role", "text")), strict=True)):
            if is_head:
                if head is not None:
                    close()
                head = (conv, *(c[i].as_py() for c in about))
                key, audit, at, state, digest, first = conv, head[-1], 0, 0, hashlib.sha256(), True
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                initial = role[:1] if edit == "K" else _WANTED[state]
                say(role if edit == "K" else _ROLE[initial], text)
                state = _NEXT[state][initial]
        if ready:
            yield flush()
    if head is not None:
        close()
        yield flush()


def repair(rows: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows`` (conv_id, turn, role, text, lost, copy); lost rows count only for the conversation's id."""
    kind = dict(rows.dtypes)["conv_id"]
    with Scratch(rows.sparkSession) as scratch:
        found = faults(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())
        found = found.select("conv_id", "turn", "initial", "fault", "lost").mapInArrow(_signatures, f"conv_id {kind}, {_SIGNATURE}")
        of = F.col("signature")
        found = scratch.keep(found.withColumns({"k1": F.xxhash64(of), "k2": F.xxhash64(F.lit(7), of)}))
        distinct = found.groupBy("k1", "k2").agg(F.first(F.reverse("signature")).alias("backwards"))
        audits = scratch.keep(distinct.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(_audits(params), "k1 long, k2 long, cost long, audit string"))
        heads = scratch.keep(found.drop("signature").join(audits, ["k1", "k2"]).drop("k1", "k2"))
        lines = _hashed(rows.where("NOT lost")).withColumn("is_head", F.lit(False))
        both = heads.withColumn("is_head", F.lit(True)).unionByName(lines.drop("lost"), allowMissingColumns=True)
        both = both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.desc("is_head"), *_order())
        columns = "gaps, blank, duplicate, truncated, illegal, cost"
        schema = f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string, repaired_sha256 string"
        return cut(both.mapInArrow(_repaired, schema).select("conv_id", *columns.split(", "), "audit", "repaired_sha256"))
