"""Context bundles: union with priority, line and size limits, running budgets, headers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from corvidex.functions import text as tx


@dataclass(frozen=True)
class BundleParams:
    max_chunks: int = 20
    max_chars: int = 12000
    top_chunks: int = 5
    top_lines: int = 30
    max_lines: int = 50
    category_lines: Mapping[str, int] = field(default_factory=dict)
    max_chunk_chars: int = 0  # 0: no limit


def merge(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Union in which an earlier row of a key wins; both have qid and pos. ``pos`` counts anew from 1."""
    both = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)), allowMissingColumns=True)
    one = both.withColumn("rn", F.row_number().over(Window.partitionBy("qid", *key).orderBy("src", "pos"))).where("rn = 1")
    return one.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("src", "pos"))).drop("src", "rn")


def build(merged: DataFrame, params: BundleParams = BundleParams()) -> DataFrame:
    """(qid, pos, slot, body) of each kept chunk: slot ``top`` or ``excerpt``, body with its source header."""
    kept = merged.where(F.col("pos") <= params.max_chunks)
    lines = F.lit(params.max_lines)
    if params.category_lines:
        table = F.create_map(*[F.lit(x) for k, v in params.category_lines.items() for x in (k, v)])
        lines = F.coalesce(F.try_element_at(table, F.col("category")), lines)
    text = tx.first_lines(F.col("text"), lines)
    kept = kept.withColumn("text", tx.first_chars(text, params.max_chunk_chars) if params.max_chunk_chars > 0 else text)
    running = F.sum(F.length("text")).over(Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = kept.withColumn("used", running).where(F.col("used") <= params.max_chars)
    top = F.col("pos") <= params.top_chunks
    header = tx.source_header(F.col("pos"), F.col("source_path"), F.col("document_date"), F.col("category"), F.col("section_path"))
    shown = F.when(top, tx.first_lines(F.col("text"), params.top_lines)).otherwise(F.col("text"))
    return kept.select("qid", "pos", F.when(top, "top").otherwise("excerpt").alias("slot"), F.concat(header, F.lit("\n\n"), shown).alias("body"))


def tool_excerpts(hits: DataFrame, budget: int) -> DataFrame:
    """(qid, pos, excerpt): whole excerpts while the budget lasts; the first that overflows is cut in its middle and ends the list."""
    header = tx.tool_header(F.col("document_id"), F.col("chunk_no"), F.col("document_date"), F.col("category"), F.col("section_path"))
    each = hits.select("qid", "pos", F.concat(header, F.lit("\n\n"), F.col("text")).alias("excerpt"))
    before = F.sum(F.length("excerpt")).over(Window.partitionBy("qid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("room", F.lit(budget) - F.coalesce(before, F.lit(0))).where("room > 0")
    return each.select("qid", "pos", tx.cut_middle(F.col("excerpt"), F.col("room")).alias("excerpt"))


# Titles of the sections of a tool's answer, and its text without a match.
TOP_TITLE = "## Top Matches\n\n"
MORE_TITLE = "\n\n## Additional Matches\n\n"
NO_MATCH = 'No matches found for query: "{query}"'


def tool_result(excerpts: DataFrame) -> DataFrame:
    """(qid, result): the best match, then the others, as one text for each query; queries without a match have no row."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "excerpt"))), lambda x: x["excerpt"])
    each = excerpts.groupBy("qid").agg(ordered.alias("e"))
    more = F.when(F.size("e") > 1, F.concat(F.lit(MORE_TITLE), F.array_join(F.slice("e", F.lit(2), F.size("e")), "\n\n"))).otherwise("")
    return each.select("qid", F.concat(F.lit(TOP_TITLE), F.get("e", F.lit(0)), more).alias("result"))


def no_match(query: str) -> str:
    return NO_MATCH.replace("{query}", query)


