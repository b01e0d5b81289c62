"""Secret scans: all rules in one byte pass of a combined, minimised deterministic automaton.

Each rule's regex is read into position sets; subset construction over all
rules at once, with restarts at every byte, gives one automaton whose states
know which rules have just been met; it is minimised and laid out as one
transition array over byte values. A text's UTF-8 bytes pass through it once.
Where a rule is met, a second, reversed automaton of that rule alone finds the
leftmost start, and a third, forward one the longest end; the scan of other
rules goes on. Spans are given in code points, end exclusive.

Defined cases: a null or empty text has no spans; spans of one kind don't
overlap, spans of different kinds may; bytes beyond ASCII meet no rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op, _parser  # the standard library's reader of regex syntax

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # ASCII, without anchors, groups' contents matter only to min_length
    min_length: int = 0  # of the last group if there is one, else of the whole match
    ignore_case: bool = False


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # runs of the class: shorter ones fail as a whole
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)


class _Positions:
    """A pattern's positions, each a set of bytes, and which may be first, last, and follow which."""

    def __init__(self, rule: Rule):
        self.bytes: list[frozenset[int]] = []
        self.follow: list[set[int]] = []
        self.ignore_case = rule.ignore_case
        self.nullable, self.first, self.last = self._row(_parser.parse(rule.pattern))

    def _leaf(self, chosen: set[int]):
        if self.ignore_case:
            chosen = chosen | {ord(f(chr(c))) for c in chosen if c < 128 for f in (str.lower, str.upper)}
        self.bytes.append(frozenset(chosen))
        self.follow.append(set())
        return False, {len(self.bytes) - 1}, {len(self.bytes) - 1}

    def _row(self, items):
        nullable, first, last = True, set(), set()
        for item in items:
            n, f, end = self._item(*item)
            for p in last:
                self.follow[p] |= f
            first = first | f if nullable else first
            last = last | end if n else end
            nullable = nullable and n
        return nullable, first, last

    def _item(self, kind, value):
        if kind is op.LITERAL:
            return self._leaf({value})
        if kind is op.IN:
            return self._leaf({x for k, v in value for x in ([v] if k is op.LITERAL else range(v[0], v[1] + 1))})
        if kind is op.SUBPATTERN:
            return self._row(value[-1])
        if kind is op.BRANCH:
            parts = [self._row(x) for x in value[1]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind is op.MAX_REPEAT:
            low, high, inner = value
            if (low, high) == (0, 1):
                return True, *self._row(inner)[1:]
            if high is op.MAXREPEAT and low <= 1:
                n, first, last = self._row(inner)
                for p in last:
                    self.follow[p] |= first
                return n or low == 0, first, last
            more = [(kind, (1, high, inner))] if high is op.MAXREPEAT else [(kind, (0, 1, inner))] * (high - low)
            return self._row([(op.SUBPATTERN, (None, 0, 0, inner))] * (low - (high is op.MAXREPEAT)) + more)
        raise ValueError(f"a rule's pattern may not use {kind}")


@dataclass(frozen=True)
class Automaton:
    step: list[int]  # 256 entries a state, which is named by the place of its first entry; -1: none
    meets: dict[int, int]  # state to bits of the rules that it has met
    start: int
    least: int  # states from here on have met a rule


def _build(starts: set, follow: dict, chosen: dict, final: dict, restart: bool) -> Automaton:
    """Subset construction from ``starts`` (with ``restart``: entered at each byte), then minimisation."""
    every = {byte: {p for p in chosen if byte in chosen[p]} for byte in range(256)}
    # State 0 has read nothing. It alone enters by ``starts`` where there is no restart.
    order, names, rows = [(frozenset(), True)], {(frozenset(), True): 0}, []
    for here, fresh in order:
        nexts = set(starts) if fresh or restart else set()
        nexts = nexts.union(*(follow[p] for p in here))
        row = []
        for byte in range(256):
            to = (frozenset(nexts & every[byte]), restart and not nexts & every[byte])
            if not to[0] and not restart:
                row.append(-1)
                continue
            if to not in names:
                names[to] = len(order)
                order.append(to)
            row.append(names[to])
        rows.append(row)
    met = []
    for here, _ in order:
        bits = 0
        for p in here:
            bits |= final.get(p, 0)
        met.append(bits)
    block = met
    while True:  # split classes until their members agree on the class that each byte leads to
        seen = {}
        new = [seen.setdefault((block[i], *(block[x] if x >= 0 else -1 for x in row)), len(seen)) for i, row in enumerate(rows)]
        if len(seen) == len(set(block)):
            break
        block = new
    shown = {}
    for i, b in enumerate(block):
        shown.setdefault(b, i)
    ranked = sorted(shown.values(), key=lambda i: (met[i] > 0, i))
    place = {block[i]: 256 * n for n, i in enumerate(ranked)}
    step = [place[block[x]] if x >= 0 else -1 for i in ranked for x in rows[i]]
    least = 256 * sum(met[i] == 0 for i in ranked)
    return Automaton(step, {place[block[i]]: met[i] for i in ranked if met[i]}, place[block[0]], least)


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...]) -> tuple[Automaton, tuple[tuple[Automaton, Automaton], ...]]:
    """The combined automaton, and of each rule alone the reversed and the forward one."""
    follow, chosen, starts, final, alone = {}, {}, set(), {}, []
    for k, rule in enumerate(rules):
        p = _Positions(rule)
        if p.nullable:
            raise ValueError(f"{rule.kind} matches the empty text")
        for i, nexts in enumerate(p.follow):
            chosen[k, i], follow[k, i] = p.bytes[i], {(k, j) for j in nexts}
        starts |= {(k, i) for i in p.first}
        final |= {(k, i): 1 << k for i in p.last}
        before = {i: {j for j, nexts in enumerate(p.follow) if i in nexts} for i in range(len(p.bytes))}
        bytes_of = dict(enumerate(p.bytes))
        back = _build(p.last, before, bytes_of, dict.fromkeys(p.first, 1), False)
        ahead = _build(p.first, dict(enumerate(p.follow)), bytes_of, dict.fromkeys(p.last, 1), False)
        alone.append((back, ahead))
    return _build(starts, follow, chosen, final, True), tuple(alone)


def _farthest(a: Automaton, data: bytes, places: range) -> int:
    """The last of ``places`` up to which ``a`` accepts, else -1."""
    state, step, least, found = a.start, a.step, a.least, -1
    for i in places:
        state = step[state + data[i]]
        if state < 0:
            break
        if state >= least:
            found = i
    return found


def scan(data: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in bytes: leftmost, longest, non-overlapping for each rule, failing lengths dropped."""
    combined, alone = compile_rules(rules)
    step, meets, least, state = combined.step, combined.meets, combined.least, combined.start
    ends, out = [0] * len(rules), []
    for i, byte in enumerate(data):
        state = step[state + byte]
        if state >= least:
            bits = meets[state]
            for k, rule in enumerate(rules):
                if bits >> k & 1 and i >= ends[k]:
                    start = _farthest(alone[k][0], data, range(i, ends[k] - 1, -1))
                    if start >= 0:
                        ends[k] = _farthest(alone[k][1], data, range(start, len(data))) + 1
                        if _long_enough(rule, data[start : ends[k]]):
                            out.append((start, ends[k], k))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _long_enough(rule: Rule, match: bytes) -> bool:
    if not rule.min_length:
        return True
    m = re.fullmatch(rule.pattern.encode(), match, re.IGNORECASE if rule.ignore_case else 0)
    return len(m[m.lastindex or 0]) >= rule.min_length


def spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, end, rule number) in code points, by start, then rule."""
    data = text.encode("utf-8", "surrogatepass")
    found = scan(data, rules)
    if len(data) == len(text) or not found:
        return found
    out, byte, point = [], 0, 0
    for start, end, k in found:
        point += len(data[byte:start].decode("utf-8", "surrogatepass"))
        byte = start
        out.append((point, point + end - start, k))  # a match is ASCII
    return out


def scan_secrets(documents: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of each row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, e, k in spans(t.as_py() or "", rules)] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
