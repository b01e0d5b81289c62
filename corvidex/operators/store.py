"""Changes of stored tables as DataFrames: upsert, replace, delete, merge. The caller writes the result as a new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def last_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__n", n).where("`__n` = 1").drop("__n")


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``new`` rows in place of those with equal keys; of new rows with equal keys, the one with the greatest ``order`` counts, if it is named."""
    new = new if order is None else last_of_each(new, keys, order)
    return existing.join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(existing.columns))


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` are replaced; chunk_no counts from 0 in the order of ``chunk_no``."""
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_no")) - 1
    return existing.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new.withColumn("chunk_no", number).select(existing.columns))


def delete(tables: dict[str, DataFrame], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the ids."""
    return {name: df.join(ids.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def merge_sessions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by session_id that keeps the first created_at."""
    kept = existing.select("session_id", F.col("created_at").alias("first_created"))
    merged = new.join(kept, "session_id", "left").withColumn("created_at", F.coalesce("first_created", "created_at")).drop("first_created")
    return upsert(existing, merged, ["session_id"])


def replace_messages(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All messages of the sessions in ``new`` are replaced; seq counts from 1."""
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return existing.join(new.select("session_id").distinct(), "session_id", "left_anti").unionByName(new.withColumn("seq", seq.cast(existing.schema["seq"].dataType)).select(existing.columns))


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, n) of ids that occur more than once, which a store of unique ids rejects."""
    return chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


def upsert_profile(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A store of one profile for each owner: the new one replaces it; lists are kept as JSON arrays."""
    lists = {f"{c}_json": F.coalesce(F.to_json(c), F.lit("[]")) for c in ("chronic_conditions", "current_medications", "allergies")}
    stored = new.select("owner", "name", "age", "sex", "date_of_birth", *[v.alias(k) for k, v in lists.items()])
    return upsert(existing, stored, ["owner"])


def read_profile(stored: DataFrame) -> DataFrame:
    lists = [F.from_json(f"{c}_json", "array<string>").alias(c) for c in ("chronic_conditions", "current_medications", "allergies")]
    return stored.select("owner", "name", "age", "sex", "date_of_birth", *lists)
