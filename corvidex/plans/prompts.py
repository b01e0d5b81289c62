"""Prompt texts as Columns: templates with named fields, filled from rows."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from corvidex.functions import text as tx

# What stands for an empty list of excerpts or documents, and the head of the document index.
NO_TOP = "No relevant excerpts found."
NO_MORE = "No additional evidence."
NO_DOCUMENTS = "(no documents in knowledge base)"
INDEX_HEAD = "document_id | date | category | sections"


def render(template: str, fields: Mapping[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by its column; what the columns hold is never read as a template."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(fields[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def excerpts(items: Column, otherwise: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, "\n\n")).otherwise(otherwise)


def user_message(template: str, request: Column, top: Column, more: Column) -> Column:
    return render(template, {"user_request": request, "top_chunks": excerpts(top, NO_TOP), "kb_excerpts": excerpts(more, NO_MORE)})


def document_index(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(INDEX_HEAD + "\n"), F.array_join(lines, "\n"))).otherwise(NO_DOCUMENTS)


def system_message(template: str, now_date: str, index: Column) -> Column:
    """From a profile's columns: age, sex and three lists."""
    lists = {c: tx.listing(F.col(c)) for c in ("chronic_conditions", "current_medications", "allergies")}
    return render(template, {"age": F.col("age"), "sex": F.col("sex"), **lists, "now_date": F.lit(now_date), "document_index": index})


def patient_block() -> Column:
    """A profile's lines; empty lists have none."""
    named = {"Chronic conditions": "chronic_conditions", "Current medications": "current_medications", "Allergies": "allergies"}
    lines = [F.when(F.size(c) > 0, F.concat(F.lit(f"{label}: "), F.array_join(c, ", "))) for label, c in named.items()]
    return F.concat_ws("\n", F.concat(F.lit("Age: "), F.col("age").cast("string"), F.lit(" years")), F.concat(F.lit("Sex: "), "sex"), *lines)


def consult_message(template: str, request: Column, top: Column, more: Column) -> Column:
    """As ``user_message`` with the patient's lines and without stand-ins for empty lists."""
    joined = {"top_chunks": F.array_join(top, "\n\n"), "kb_excerpts": F.array_join(more, "\n\n")}
    return render(template, {"patient_info": patient_block(), "user_request": request, **joined})


def bundle_lists(bundled: DataFrame) -> DataFrame:
    """(qid, top, more) of a bundle's bodies in order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "slot", "body")))
    held = bundled.groupBy("qid").agg(ordered.alias("x"))
    of = lambda slot: F.transform(F.filter("x", lambda y: y["slot"] == slot), lambda y: y["body"])
    return held.select("qid", of("top").alias("top"), of("excerpt").alias("more"))
