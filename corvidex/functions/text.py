"""Text functions as Column expressions; only NFKC needs Python (an Arrow UDF)."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from corvidex.functions import fixed


@cache
def _stable_letters() -> str:
    """Ranges, for a character class, of letters that NFKC leaves as they are in whatever text: up to U+052F, and the four longest beyond.

    Left out are letters that NFKC changes, combining marks, and letters that join with one before them.
    """
    joined = {chr(int(parts[1], 16)) for c in map(chr, range(0x110000)) if len(parts := unicodedata.decomposition(c).split()) == 2 and parts[0][0] != "<"}
    joined |= set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # vowels and ends of Hangul syllables
    runs: list[list[int]] = []
    for n in [*range(0xD800), *range(0xE000, 0x10000)]:
        c = chr(n)
        if not unicodedata.combining(c) and c not in joined and unicodedata.is_normalized("NFKC", c):
            if runs and runs[-1][1] == n - 1 and n != 0x530:
                runs[-1][1] = n
            else:
                runs.append([n, n])
    kept = [r for r in runs if r[1] < 0x530] + sorted([r for r in runs if r[0] >= 0x530], key=lambda r: r[0] - r[1])[:4]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in kept)


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC; only texts with a letter that it may change are sent to Python, so that a batch of long texts doesn't lie there whole."""
    needs = text.rlike(rf"[[^\x00-\x7F]&&[^{_stable_letters()}]]")
    return F.coalesce(_nfkc(F.when(needs, text)), text)


def fold(text: Column) -> Column:
    """Lower case, then ё as е."""
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def normalize(text: Column) -> Column:
    return fold(nfkc(text))


def clean_controls(text: Column) -> Column:
    """Without byte-order marks in front, with LF line ends, without control characters but LF and tab."""
    text = F.regexp_replace(text, "^\\uFEFF+", "")
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B-\\x1F]", "")


def preprocess(text: Column) -> Column:
    return normalize(clean_controls(text))


def query_tokens(text: Column) -> Column:
    """Words of a query: punctuation separates, tokens of digits alone go."""
    words = F.split(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", -1)
    return F.filter(words, lambda t: (t != "") & ~t.rlike(r"(?U)^\d+$"))


def _plain_letters() -> tuple[str, str]:
    """Lower-case letters that the index folds, and what each becomes.

    A letter of a Latin base and one mark becomes its base (of two marks it
    stays), and a variant of a letter below U+0400 the letter it folds to.
    """
    found = {}
    for c in map(chr, [*range(0x80, 0x400), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
            found[c] = parts[0].lower()
        elif c < "\u0400" and c == c.lower() and len(c.casefold()) == 1 and c.casefold() != c:
            found[c] = c.casefold()
    return "".join(found), "".join(found.values())


_MARKED, _PLAIN = _plain_letters()


def without_accents(text: Column) -> Column:
    """``text``, in lower case already, with Latin letters bare and combining marks gone; texts in ASCII pass as they are."""
    bare = F.translate(text, _MARKED + fixed.COMBINING_MARKS, _PLAIN)
    return F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text)


def index_tokens(text: Column) -> Column:
    """Terms of the full-text index: runs of letters and numbers, lower case, Latin letters without accents."""
    return F.regexp_extract_all(without_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def expand(tokens: Column, aliases: Mapping[str, Sequence[str]] = fixed.ALIASES) -> Column:
    """Each token with its aliases behind it, first occurrences only."""
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), alias_of(t, aliases)))))


def alias_of(token: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    if not aliases:
        return F.array().cast("array<string>")
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.get(F.array(F.try_element_at(table, token)), F.lit(0)), F.array().cast("array<string>"))


def tag_tokens(text: Column) -> Column:
    """Tokens between spaces, in lower case, without punctuation at the ends; ``text`` is NFKC already."""
    edge = "".join(f"\\{c}" for c in fixed.EDGE_CHARS)
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("ё"), F.lit("е")))
    bare = F.transform(F.split(low, r"(?U)\s+", -1), lambda t: F.regexp_replace(t, f"^[{edge}]+|[{edge}]+$", ""))
    return F.filter(bare, lambda t: t != "")


def is_tag(token: Column) -> Column:
    """Long enough, and no digit, unit, stop word or inner punctuation."""
    inner = "".join(f"\\{c}" for c in fixed.INNER_CHARS)
    unit = reduce(or_, [token.rlike(p) for p in fixed.UNIT_PATTERNS], token.isin(fixed.UNITS))
    return (F.length(token) >= 3) & ~token.rlike(r"(?U)\d") & ~unit & ~token.isin(fixed.STOPWORDS) & ~token.rlike(f"[{inner}]")


def tags(sources: Sequence[Column], aliases: Mapping[str, Sequence[str]] = fixed.ALIASES) -> Column:
    """Sorted distinct tags of the sources: tokens kept whole, parts of compounds, aliases."""
    held = F.filter(F.flatten(F.array(*[tag_tokens(s) for s in sources])), is_tag)

    def parts(t: Column) -> Column:
        by_dash = F.filter(F.split(t, "-", -1), lambda p: p != "")
        by_slash = F.filter(F.split(t, "/", -1), lambda p: p != "")
        split = F.when(t.contains("-"), F.array_append(by_dash, F.array_join(by_dash, ""))).when(t.contains("/"), by_slash).otherwise(F.array(t))
        return F.filter(split, is_tag)

    words = F.flatten(F.transform(held, parts))
    more = F.filter(F.flatten(F.transform(words, lambda t: alias_of(t, aliases))), is_tag)
    return F.array_join(F.sort_array(F.array_distinct(F.concat(words, more))), " ")


def first_lines(text: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def first_chars(text: Column, n: int) -> Column:
    """At most ``n`` characters, back to the last line end within them if one stands behind the first character."""
    cut = F.left(text, F.lit(n))
    back = F.length(cut) - F.instr(F.reverse(cut), "\n")  # place of the last line end, from 0
    at_line = (F.instr(cut, "\n") > 0) & (back > 0)
    return F.when(F.length(text) <= n, text).when(at_line, F.left(cut, back)).otherwise(cut)


def cut_middle(text: Column, room: Column) -> Column:
    """``text`` if it fits, else its start and end around a mark, or only its start where the mark has no room."""
    mark = fixed.CUT_MARK
    half = F.floor((room - len(mark)) / 2).cast("int")
    halves = F.concat(F.left(text, half), F.lit(mark), F.when(half > 0, F.right(text, half)).otherwise(""))
    return F.when(F.length(text) <= room, text).when(room <= len(mark), F.left(text, room.cast("int"))).otherwise(halves)


def source_header(index: Column, source_path: Column, date: Column, category: Column, section: Column) -> Column:
    section = F.coalesce(F.nullif(section, F.lit("")), F.lit("(no section)"))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), F.concat_ws(" | ", source_path, date, category, section))


def tool_header(document_id: Column, chunk_no: Column, date: Column, category: Column, section: Column) -> Column:
    name = F.concat(document_id.cast("string"), F.lit("#chunk_"), chunk_no.cast("string"))
    return F.concat_ws(" | ", name, date, category, F.coalesce(section, F.lit("")))


def chunk_id(document_id: Column, section_path: Column, kind: Column, text: Column) -> Column:
    whole = F.concat_ws("|", document_id.cast("string"), F.coalesce(section_path, F.lit("")), kind, text)
    return F.left(F.sha2(whole, 256), F.lit(32))


def document_id(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(32))


def top_section(section_path: Column) -> Column:
    return F.trim(F.element_at(F.split(section_path, " > ", -1), 1))


def safe_filename(name: Column) -> Column:
    """The last part of a path without NUL and outer spaces; ``upload.md`` if nothing is left."""
    bare = F.regexp_extract(F.trim(F.replace(name, F.lit("\x00"), F.lit(""))), r"([^/]*)$", 1)
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("upload.md"))


def index_line(document_id: Column, date: Column, category: Column, sections: Column) -> Column:
    names = F.when(F.size(sections) > 0, F.array_join(sections, ", ")).otherwise("—")
    return F.concat_ws(" | ", document_id.cast("string"), date, category, names)


def listing(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("None")
