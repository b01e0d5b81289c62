"""Repair against a search over all edits, on the whole table and on odd rows."""

import hashlib
import re
import zlib
from functools import cache

from corvidex.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits; ``rows`` are (role, text, has to go, truncated)."""
    grammar = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"s?(ua)*u?")

    @cache
    def best(i, held, inserts):
        found = [(0, "", ())] if i == len(rows) and grammar.fullmatch(held) else []
        if inserts < 3:
            for role in ("user", "assistant"):
                if prefix.fullmatch(held + role[0]):
                    c, a, r = best(i, short(held + role[0]), inserts + 1)
                    found.append((c + 2, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, r = best(i + 1, held, 0)
            found.append((c + 3, "D" + a, r))
            for e, new, cost in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)) if not gone else ():
                if new and prefix.fullmatch(held + new[0]):
                    c, a, r = best(i + 1, short(held + new[0]), 0)
                    found.append((c + cost + cut, e + a, ((new, text), *r)))
        return min(found, default=(10**9, "", ()))

    def short(held):  # what comes next depends on the beginning and the last initial alone
        return {"s": "s", "u": "u"}.get(held[:1], held) if len(held) == 1 else ("ua" if held[-1] == "a" else "u")

    return best(0, "", 0)


def expected(table):
    """Rows of the contract for rows (conv_id, turn, role, text)."""
    out, by = set(), {}
    space = lambda x: " " if x is None else x
    for conv, turn, role, text in table:
        held = by.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        held += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, held in by.items():
        held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        rows, seen, counts = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in held:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, repaired = cheapest(tuple(rows))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, digest))
    return out


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    found = [tuple(r) for r in cr.repair(cr.damage(table)).collect()]
    assert len(found) == len(set(found)) and set(found) == expected([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    import random

    r = random.Random(4)
    rows = [(None, 1, "user", "Hi."), (None, None, "user", "One."), (-1, None, None, None), (-2, 5, "", "x."), (-2, 9, "user", "y"), (-3, 0, "user", "a " * 40_000 + "."), (-4, -(1 << 63), "user", "z."), (-4, (1 << 63) - 1, "assistant", "z.")]
    for conv in range(150):
        for turn in range(r.randrange(1, 9)):
            rows.append((conv, turn * r.choice([1, 1, 2]), r.choice(["system", "user", "assistant", "user", "assistant", "tool"]), r.choice(["Yes.", "No!", "and so", " \n", "", "Well. \n", None]) if r.random() < 0.8 else f"Text {r.random()}."))
    # One row for each turn: rows of one turn have no order of their own.
    rows = list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())
    df = spark.createDataFrame([(*x, "mine", "mine") for x in rows], SCHEMA + ", k1 string, lost string")
    found = {tuple(x) for x in cr.repair(cr.damage(df)).collect()}
    want = {(c, min(g, (1 << 63) - 1), *x) for c, g, *x in expected(rows)}
    assert found == want
    # All rows lost: only the id stays.
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = [tuple(x) for x in cr.repair(cr.damage(spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA))).collect()]
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cr.repair(cr.damage(spark.createDataFrame([], SCHEMA))).count() == 0


def test_repeated_rows_and_turns(spark):
    rows = [(1, 3, "user", "Hi."), (1, 3, "user", "Hi."), (1, 3, "assistant", "Yes."), (2, None, "user", "a."), (2, None, "user", "a.")]
    plain = spark.createDataFrame([(*x, False, 0) for x in rows], SCHEMA + ", lost boolean, copy int")
    got = {x.conv_id: x for x in cr.repair(plain).collect()}
    assert (got[1].duplicate, got[1].gaps, got[2].duplicate, got[2].audit) == (1, 0, 1, "KDI")
    again = {x.conv_id: tuple(x) for x in cr.repair(plain.repartition(3, "text")).collect()}
    assert again == {k: tuple(x) for k, x in got.items()}


def test_one_node_for_each_suffix(spark, monkeypatch):
    steps = []
    step = cr.Automaton.step
    monkeypatch.setattr(cr.Automaton, "step", lambda self, costs, symbol: steps.append(symbol) or step(self, costs, symbol))
    signatures = sorted({s[::-1] for s in ("suaua", "uaua", "aua", "xua", "Uua", "suaUa", "ua")})
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"k1": range(len(signatures)), "k2": range(len(signatures)), "backwards": signatures})
    (out,) = cr._audits(cr.RepairParams())([batch])
    suffixes = {s[:n] for s in signatures for n in range(1, len(s) + 1)}
    assert len(steps) == len(suffixes)
    for backwards, cost, audit in zip(signatures, out.column("cost").to_pylist(), out.column("audit").to_pylist(), strict=True):
        rows = tuple(({"s": "s", "u": "user", "a": "assistant", "x": "user"}[c.lower()], "t", c == "x", int(c.isupper())) for c in backwards[::-1])
        assert cheapest(rows)[:2] == (cost, audit)
