"""A parser that walks a text line by line, which the plan of blocks is compared with."""

from __future__ import annotations

import re
from dataclasses import dataclass

from corvidex.functions.blocks import inline, subtype

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|)$")
_DIVIDER = re.compile(r" {0,3}\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r" {0,3}</?[A-Za-z!?][^>]*>?")
_QUOTE = re.compile(r" {0,3}> ?")


@dataclass(frozen=True)
class Block:
    type: str
    content: str
    level: int = 0
    markup: str = ""
    subtype: str = ""


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line.removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [inline(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line)]


def _opens(lines: list[str], i: int) -> bool:
    """Whether line ``i`` begins a block that ends a paragraph before it."""
    x = lines[i]
    item = _ITEM.match(x)
    starts_list = item and item[3] and (not item[2][0].isdigit() or item[2][:-1] == "1") and len(item[1]) < 4
    return bool(_HEADING.match(x) or _FENCE.match(x) or _RULE.match(x) or starts_list or _QUOTE.match(x))


def _is_table(lines: list[str], i: int) -> bool:
    return i + 1 < len(lines) and "|" in lines[i] and "-" in lines[i + 1] and bool(_DIVIDER.match(lines[i + 1])) and len(_cells(lines[i])) == len(_cells(lines[i + 1]))


def _list(lines: list[str], i: int) -> tuple[Block | None, int]:
    """One list from line ``i`` on: its own items' texts; lists inside items are left out."""
    first = _ITEM.match(lines[i])
    kind, room = (first[2] if not first[2][0].isdigit() else first[2][-1]), len(first[1]) + len(first[2]) + 1
    items: list[list[str]] = []
    nested, blank = False, False
    while i < len(lines):
        x = lines[i]
        item = _ITEM.match(x) if not _RULE.match(x) else None
        if not x.strip():
            blank = True
        elif item and len(item[1]) < room:
            if (item[2] if not item[2][0].isdigit() else item[2][-1]) != kind:
                break
            items.append([item[3] or ""])
            room = len(item[1]) + len(item[2]) + 1
            nested = blank = False
        elif item and len(item[1]) >= room:
            nested, blank = True, False
        elif len(x) - len(x.lstrip()) >= room:
            if not nested:
                items[-1].append(x.strip())
            blank = False
        elif blank or _opens(lines, i):
            break
        elif not nested:
            items[-1].append(x.strip())
        i += 1
    texts = [inline("\n".join(part for part in item if part)) for item in items]
    shown = [f"- {t}" for t in texts if t]
    return (Block("list", "\n".join(shown)) if shown else None), i


def blocks(text: str) -> list[Block]:
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        x = lines[i]
        if not x.strip() or x.startswith(("    ", "\t")):
            i += 1
        elif m := _HEADING.match(x):
            out.append(Block("heading", inline(m[2] or ""), len(m[1])))
            i += 1
        elif m := _FENCE.match(x):
            end = i + 1
            while end < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[end]):
                end += 1
            if content := "\n".join(lines[i + 1 : end]).strip():
                out.append(Block("fence", content, 0, m[2].strip()))
            i = end + 1
        elif _RULE.match(x):
            i += 1
        elif _QUOTE.match(x):
            end, goes_on = i, False
            while end < len(lines) and lines[end].strip() and (_QUOTE.match(lines[end]) or not _opens(lines, end) and goes_on):
                inside = _QUOTE.sub("", lines[end], count=1)
                goes_on = bool(inside.strip()) and not (_HEADING.match(inside) or _RULE.match(inside))
                end += 1
            out += blocks("\n".join(_QUOTE.sub("", y, count=1) for y in lines[i:end]))
            i = end
        elif _is_table(lines, i):
            rows = [_cells(x)]
            i += 2
            while i < len(lines) and lines[i].strip() and not _opens(lines, i):
                rows.append((_cells(lines[i]) + [""] * len(rows[0]))[: len(rows[0])])
                i += 1
            out.append(Block("table", "\n".join(" | ".join(r) for r in rows)))
        elif (m := _ITEM.match(x)) and len(m[1]) < 4:
            found, i = _list(lines, i)
            out += [found] if found else []
        elif _HTML.match(x) and not x.lstrip().startswith("<http"):
            while i < len(lines) and lines[i].strip():
                i += 1
        else:
            end, level = i + 1, 0
            while end < len(lines) and lines[end].strip() and not _is_table(lines, end):
                if re.match(r" {0,3}(=+|-+)[ \t]*$", lines[end]):
                    level = 1 if "=" in lines[end] else 2
                    break
                if _opens(lines, end):
                    break
                end += 1
            source = "\n".join(y.strip() for y in lines[i:end])
            content = inline(source)
            if level:
                out.append(Block("heading", content, level))
            elif content:
                out.append(Block("paragraph", content, subtype=subtype(source)))
            i = end + (level > 0)
    return out
