"""Rules on tables that are written together: unique keys, references and conditions, and the rows that break them.

Conditions of a table are judged in one pass over it; a unique key is one
aggregation, counted before it is dealt; a reference is one anti-join of distinct
values. Nothing is collected: violations are rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Unique:
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Refers:
    table: str
    column: str
    to: str
    to_column: str


@dataclass(frozen=True)
class Holds:
    table: str
    name: str
    condition: str  # SQL; a null counts as not holding
    key: str


Rule = Unique | Refers | Holds


def not_null(table: str, key: str, *columns: str) -> list[Holds]:
    return [Holds(table, f"{c} is not null", f"{c} IS NOT NULL", key) for c in columns]


# Rules of stored documents and chunks, and of sessions and messages.
LIBRARY: Sequence[Rule] = (
    Unique("documents", ("document_id",)),
    Unique("chunks", ("chunk_id",)),
    Unique("chunks", ("document_id", "chunk_no")),
    Refers("chunks", "document_id", "documents", "document_id"),
    *not_null("documents", "document_id", "document_id", "source_path", "source_sha256", "category", "indexed_at", "document_date", "raw_text"),
    *not_null("chunks", "chunk_id", "chunk_id", "document_id", "chunk_no", "kind", "text"),
)
DIALOGUE: Sequence[Rule] = (
    Unique("sessions", ("session_id",)),
    Unique("messages", ("session_id", "seq")),
    Refers("messages", "session_id", "sessions", "session_id"),
    *not_null("messages", "session_id", "session_id", "seq", "role", "content"),
)


class Violation(ValueError):
    """Rows that are to be written break a rule."""


def _key(*columns: str):
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in columns]).alias("key")


def violations(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """(table, rule, key, n): for a unique key, its rows where there are several; for a reference, the rows of a value that isn't there (null refers to nothing); else 1 for each row."""
    found = []
    for name, df in tables.items():
        if own := [r for r in rules if isinstance(r, Holds) and r.table == name]:
            broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(r.condition), F.lit(False)), F.struct(F.lit(r.name).alias("rule"), _key(r.key).alias("key"))) for r in own]), lambda x: x.isNotNull())
            found.append(df.select(F.lit(name).alias("table"), F.explode(broken).alias("x"), F.lit(1).cast("long").alias("n")).select("table", "x.rule", "x.key", "n"))
    for r in rules:
        if isinstance(r, Unique):
            n = tables[r.table].groupBy(*r.columns).agg(F.count("*").alias("n")).where("n > 1")
            found.append(n.select(F.lit(r.table).alias("table"), F.lit(f"unique {', '.join(r.columns)}").alias("rule"), _key(*r.columns), "n"))
        elif isinstance(r, Refers):
            n = tables[r.table].where(F.col(r.column).isNotNull()).groupBy(r.column).agg(F.count("*").alias("n"))
            lost = n.join(tables[r.to].select(F.col(r.to_column).alias("__to")).distinct(), F.col(r.column) == F.col("__to"), "left_anti")
            found.append(lost.select(F.lit(r.table).alias("table"), F.lit(f"{r.column} refers to {r.to}").alias("rule"), _key(r.column), "n"))
    return reduce(DataFrame.unionByName, found)


def require(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> None:
    """An error that names a few of the rows, if any break a rule."""
    if few := violations(tables, rules).limit(5).collect():
        raise Violation("; ".join(f"{r.table}: {r.rule}: {r.key} ({r.n})" for r in few))
