"""Control fields of a document: category line, date and body, as Column expressions over its lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from corvidex.functions import fixed

HEAD_LINES = 30

# The forms of a category line and of a date marker.
_HEADING = r"^#{1,6}\s*категория\s*:+\s*(.+)"
_MARKUP = r"\*{0,2}\s*категория\s*\*{0,2}\s*:+\s*(?:\*{0,2}\s*)?(.+)"
_DATE = r"(?iu)[\*]{1,2}\s*Дата([^\*]*?)[\*]{1,2}\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}(?:\s+\d{2}:\d{2})?)"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_category(line: Column, categories: Sequence[str] = fixed.CATEGORIES) -> Column:
    """The allowed category that a line names by its first word, else null."""
    allowed = F.create_map(*[F.lit(x) for c in categories for x in (c.split()[0].lower(), c)])
    value = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(line, form, 1)), F.lit("")) for form in (_HEADING, _MARKUP)])
    named = let(value, lambda v: F.try_element_at(allowed, F.lower(F.substring_index(F.regexp_replace(v, r"(?U)\s+", " "), " ", 1))))
    return F.when(line.contains("категория"), named)


def category(text: Column, categories: Sequence[str] = fixed.CATEGORIES) -> Column:
    """The category of the first of the head lines that names an allowed one."""
    found = F.transform(F.slice(lines_of(text), 1, HEAD_LINES), lambda x: line_category(x, categories))
    return F.get(F.filter(found, lambda c: c.isNotNull()), F.lit(0))


def iso_date(value: Column) -> Column:
    """``YYYYMMDD``, ``D.M.Y`` and ``D/M/Y`` as ``YYYY-MM-DD``; what is none of these stays, up to the first space."""

    def from_parts(by: Column) -> Column:
        year, pad = F.get(by, F.lit(2)), lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
        return F.concat_ws("-", F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), pad(F.get(by, F.lit(1))), pad(F.get(by, F.lit(0))))

    def read(part: Column) -> Column:
        digits = F.concat_ws("-", F.substring(part, 1, 4), F.substring(part, 5, 2), F.substring(part, 7, 2))
        parts = F.split(part, F.when(part.contains("."), F.lit("[.]")).otherwise(F.lit("/")), -1)
        other = let(parts, lambda by: F.when(part.rlike("[./]") & (F.size(by) == 3), from_parts(by)).otherwise(part))
        return F.when(part.rlike(r"^\d{8}$"), digits).otherwise(other)

    return let(F.element_at(F.split(F.trim(value), r"\s+", -1), 1), read)


def content_date(text: Column, excluded: Sequence[str] = fixed.DATE_EXCLUDED, fallback: Sequence[str] = fixed.DATE_FALLBACK) -> Column:
    """The date of the first plain marker in the head lines; else of the first fallback marker, in the order of ``fallback``."""
    head = F.filter(F.slice(lines_of(text), 1, HEAD_LINES), lambda x: x.rlike(_DATE))

    def marks(line: Column) -> Column:
        suffixes = F.transform(F.regexp_extract_all(line, F.lit(_DATE), F.lit(1)), lambda s: F.lower(F.trim(s)))
        return F.arrays_zip(suffixes.alias("suffix"), F.regexp_extract_all(line, F.lit(_DATE), F.lit(2)).alias("date"))

    def holds(suffix: Column, words: Sequence[str]) -> Column:
        return reduce(or_, [suffix.contains(w) for w in words], F.lit(False))

    def pick(found: Column) -> Column:
        plain = F.filter(found, lambda x: ~holds(x["suffix"], fallback))
        return F.coalesce(F.get(plain, F.lit(0))["date"], *[F.get(F.filter(found, _has(w)), F.lit(0))["date"] for w in fallback])

    allowed = F.filter(F.flatten(F.transform(head, marks)), lambda x: ~holds(x["suffix"], excluded))
    return iso_date(let(allowed, pick))


def _has(word: str):
    return lambda x: x["suffix"].contains(word)


def front_matter_end(lines: Column) -> Column:
    """Place (from 1) of the line that closes a ``---`` block at the top, else 0."""

    def end(bare: Column) -> Column:
        at = F.array_position(F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(0))), "---")
        return F.when(at > 0, at + 1).otherwise(F.lit(0)).cast("int")

    opens = F.trim(F.get(lines, F.lit(0))) == "---"
    return F.when(opens, let(F.transform(lines, F.trim), end)).otherwise(F.lit(0))


def front_matter_date(text: Column) -> Column:
    """The first non-empty scalar of ``date``, ``document_date``, ``visit_date`` in the top block."""

    def value(block: Column, key: str) -> Column:
        own = F.filter(block, lambda x: x.rlike(rf"^{key}\s*:\s"))
        raw = F.trim(F.regexp_replace(F.element_at(F.when(F.size(own) > 0, own), -1), rf"^{key}\s*:\s*|\s+#.*$", ""))
        return F.nullif(F.regexp_replace(raw, "^[\"'](.*)[\"']$", "$1"), F.lit(""))

    def read(lines: Column) -> Column:
        block = let(front_matter_end(lines), lambda end: F.when(end > 2, F.slice(lines, F.lit(2), F.greatest(end - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")))
        return let(block, lambda b: F.coalesce(*[value(b, k) for k in ("date", "document_date", "visit_date")]))

    return F.when(F.ltrim(text).startswith("---"), iso_date(let(lines_of(text), read)))


def filename_date(path: Column, patterns: Sequence[str] = fixed.FILENAME_DATES) -> Column:
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return iso_date(F.coalesce(*[F.nullif(F.regexp_extract(stem, p, 1), F.lit("")) for p in patterns]))


def document_date(text: Column, path: Column) -> Column:
    return F.coalesce(content_date(text), front_matter_date(text), filename_date(path))


def body(text: Column, categories: Sequence[str] = fixed.CATEGORIES) -> Column:
    """The text without its front matter and without the first category line of the head."""

    def without_category(rest: Column) -> Column:
        named = F.transform(F.slice(rest, 1, HEAD_LINES), lambda x: line_category(x, categories).isNotNull())
        return let(F.array_position(named, True), lambda at: F.array_join(F.filter(rest, lambda x, i: (at == 0) | (i != at - 1)), "\n"))

    def rest(lines: Column) -> Column:
        return let(front_matter_end(lines), lambda end: F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0))))

    return let(let(lines_of(text), rest), without_category)
