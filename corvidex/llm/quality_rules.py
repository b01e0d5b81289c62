"""Quality rules: base statistics of each text and cross-document line frequency, native operations only.

Lines are normalised (lower case, runs of spaces as one) and hashed. For each
host the distinct documents of each line are counted; lines in more than the
share ``max_share`` of the host's documents, and in more than ``min_documents``
of them, are removed, whatever the host's size, and a document whose remaining words are fewer than ``min_words`` or than
``min_left`` of its words is depleted and rejected. The texts are read once:
statistics and line hashes are written to the checkpoint folder, and counting
starts from there. A hot line of a hot host is summed before the shuffle.

Defined cases: null and empty texts have zero counts and fail the base rules; a
null host is a host of its own; each row counts as a document, also if its id
or text repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corvidex.llm._session import cut

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    window: int = 3
    min_documents: int = 4  # a line of so few documents never goes
    max_share: float = 0.01
    min_left: float = 0.5


def _n(x: Column) -> Column:
    return F.size(x).cast("long")


def _not_blank(x: Column) -> Column:
    return F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != ""


def base_statistics(documents: DataFrame, text: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and ``lines`` (hash and words of each)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda x: x != "")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), _not_blank)
    held = documents.withColumns({"__words": words, "__lines": lines})
    w = F.col("__words")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - params.window), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(params.window)]).alias("g"), i.alias("i")))
    held = held.withColumn("__grams", F.when(F.size(w) >= params.window, F.sort_array(grams)).otherwise(F.array()))
    g = F.col("__grams")
    # In order of hash, a window found twice or more has an equal neighbour.
    again = F.filter(g, lambda x, k: F.coalesce(x["g"] == F.get(g, k - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(g, k + 1)["g"], F.lit(False)))
    held = held.withColumn("__again", F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(*[x["i"] + k for k in range(params.window)])))))
    one_line = lambda x: F.struct(
        F.xxhash64(F.lower(F.trim(F.regexp_replace(x, SPACE, " ")))).alias("h"), F.size(F.filter(F.split(x, SPACE, -1), lambda y: y != "")).alias("w")
    )
    return held.select(
        *documents.columns,
        _n(w).alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (_n(F.col("__lines")) - _n(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _n(F.col("__again")).alias("n_repeat_words"),
        F.transform("__lines", one_line).alias("lines"),
    )


def apply_rules(documents: DataFrame, host: str, params: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, the statistics, n_removed_words, base_failed, kept) of each row of ``documents``."""
    rows = documents.select("doc_id", F.col("text"), F.col(host).alias("host"), F.monotonically_increasing_id().alias("row"))
    stats = cut(base_statistics(rows, params=params).drop("text"))
    lines = stats.select("row", "host", F.explode("lines").alias("x")).groupBy("row", "host", F.col("x.h").alias("h")).agg(F.sum("x.w").alias("w"))
    limits = stats.groupBy(F.col("host").alias("limit_of")).agg((F.count("*") * params.max_share).alias("most"))
    common = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > params.min_documents).withColumnRenamed("host", "of")
    common = common.join(limits, F.col("of").eqNullSafe(F.col("limit_of"))).where("n > most").select("of", F.col("h").alias("line"))
    # Written, so that a line of very many documents can be split over tasks in the join.
    common = cut(common)
    removed = lines.join(common, F.col("host").eqNullSafe(F.col("of")) & (F.col("h") == F.col("line"))).groupBy("row").agg(F.sum("w").alias("n_removed_words"))
    out = stats.drop("lines").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < params.min_words) | (left < params.min_left * F.col("n_words"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words"]
    return out.select(*columns, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
