"""Inline Markdown as plain text, and what kind of paragraph it is: the part of parsing that built-in functions don't express."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_PLAIN = T.StructType([T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("subtype", T.StringType())])
_BOLD = re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*|__(?=\S)(.+?)(?<=\S)__", re.S)


def inline(source: str) -> str:
    """Plain text of inline Markdown: code and link texts stay, emphasis marks and images go, line ends become spaces."""
    kept: list[str] = []

    def keep(text: str) -> str:
        kept.append(text)
        return f"\x00{len(kept) - 1}\x00"

    s = re.sub(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", lambda m: keep(m[2].replace("\n", " ").strip() or m[2]), source, flags=re.S)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), s)
    s = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", s)
    s = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", s)
    s = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", s)
    s = _BOLD.sub(lambda m: m[1] or m[2], s)
    s = re.sub(r"\*(?=\S)([^*]+?)(?<=\S)\*", r"\1", s)
    s = re.sub(r"(?<!\w)_(?=\S)([^_]+?)(?<=\S)_(?!\w)", r"\1", s)
    s = re.sub(r"[ \t]*\\?\n[ \t]*", " ", s)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], s).strip()


def subtype(source: str) -> str:
    bold = list(_BOLD.finditer(source))
    if not bold:
        return ""
    if not _BOLD.sub("", source).strip():
        return "bold_label"
    label = inline(bold[0][1] or bold[0][2])
    after = source[bold[0].end() :].lstrip()
    return "fact" if label and len(label) <= 120 and after.startswith(":") else ""


@F.pandas_udf(_PLAIN)
def marked(parts: pd.Series) -> pd.DataFrame:
    """Plain text of each of a block's parts, and the subtype of a paragraph of one part; nothing of a null."""
    told = [[inline(p) for p in ps] if ps is not None else None for ps in parts]
    kinds = [subtype(ps[0]) if ps is not None and len(ps) == 1 else "" for ps in parts]
    return pd.DataFrame({"parts": told, "subtype": kinds})


# A filter on the texts would else be pushed below the function and call it once more.
marked = marked.asNondeterministic()

_SPACE = "".join(f"\\x{{{n:X}}}" for n in range(0x10000) if chr(n).isspace())  # all that Python strips


def has_marks(part: Column) -> Column:
    """Whether ``inline`` may do more to a part than join its lines."""
    return part.rlike(r"[`\\\x00]|\]\(|<(?:https?|mailto):|\*[^*]*\*|_[^_]*_")


def unmarked(part: Column) -> Column:
    """``inline`` of a part without marks."""
    return F.regexp_replace(F.regexp_replace(part, r"[ \t]*\n[ \t]*", " "), rf"^[{_SPACE}]+|[{_SPACE}]+\z", "")
