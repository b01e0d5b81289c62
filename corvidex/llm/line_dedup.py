"""Line dedup: winnowing over line hashes, native DataFrame operations only.

Texts are split at ``\\n``; lines with a word are hashed. A window is the shortest
stretch of lines with at least ``min_words`` words, counted from a line on
(ahead) or back from it (behind). *Winnowing*: the smallest line hash of each
window is selected as a fingerprint, a row of its own with its position; two
equal runs of that many words select the same fingerprints, whatever stands
around them. *Joining*: positions of fingerprints that stand at one position
only are left out by a join with the others, and with them most windows. *Whole
matches*: a fingerprint's position alone doesn't say which other one it matches,
so the windows it was selected from are told apart by a hash of all their lines,
and equal windows are joined with the first of them (by document id, then line).
Windows begin and end at every line, to the left and right of a fingerprint, so
those that match make up each repeated run to its ends; they are not extended
line by line. Later windows mark their lines, and marked lines are deleted. A
copy inside one document loses only lines behind its first copy.

That is the same as deleting every line of every run of ``min_words`` words or
more that also occurs earlier: each line of such a run stands in a window of
either kind inside the run.

Defined cases: null and empty texts come back unchanged with zero counts; blank
lines count no words, are never marked and stay; rows with a repeated or null
id are told apart by a hash of the text, equal ones count as one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvidex.llm._session import cut


@dataclass(frozen=True)
class LineDedupParams:
    min_words: int = 50


WORD = r"[^\x20\x09-\x0D]++"
DOC = ["doc_id", "row_key"]


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, row_key, line, h, g, words) of each line with a word; equal rows of a document once, dealt by document."""
    each = documents.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    content = F.col("content")
    each = each.where(content.rlike(WORD)).select(*DOC, "line", F.xxhash64(content).alias("h"), F.xxhash64(F.lit(7), content).alias("g"), F.regexp_count(content, F.lit(WORD)).alias("words"))
    return each.repartition(*DOC).dropDuplicates([*DOC, "line"])


def _frames(min_words: int) -> dict[str, Window]:
    """Windows over ``before``, the words before a line, and ``after``, those up to its end."""
    doc = Window.partitionBy(*DOC)
    return {"ahead": doc.orderBy("before").rangeBetween(0, min_words - 1), "behind": doc.orderBy("after").rangeBetween(1 - min_words, 0)}


def winnow(documents: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """The lines with, for both windows of each, the selected minimum: ``ahead`` and ``behind`` as (h, at), null where the text is too short."""
    before = F.sum("words").over(Window.partitionBy(*DOC).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    lines = _lines(documents).withColumn("before", before).withColumn("after", F.col("before") + F.col("words"))
    least = {k: F.when(F.sum("words").over(f) >= params.min_words, F.min(F.struct("h", (-F.col("line")).alias("at"))).over(f)) for k, f in _frames(params.min_words).items()}
    # One taken backwards that is also the shortest from its first line on is there already.
    spare = F.sum("words").over(_frames(params.min_words)["behind"]) - F.col("words") >= params.min_words
    return lines.select(*DOC, "line", "h", "g", "words", "before", least["ahead"].alias("ahead"), F.when(spare, least["behind"]).alias("behind"))


def _matched(lines: DataFrame) -> DataFrame:
    """(doc_id, row_key, line, side) of the windows whose fingerprint stands at several positions."""
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("x")) for k in ("ahead", "behind")])
    chosen = lines.select(*DOC, "line", F.explode(sides).alias("w")).select(*DOC, "line", "w.side", F.col("w.x.h").alias("fingerprint"), F.col("w.x.at").alias("at")).where("fingerprint IS NOT NULL")
    place = F.xxhash64(*DOC, "at")
    shared = chosen.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fingerprint")
    return chosen.join(cut(shared), "fingerprint", "left_semi").select(*DOC, "line", "side")


def _extended(lines: DataFrame, params: LineDedupParams) -> DataFrame:
    """(doc_id, row_key, first, last, k1, k2, lines) of each matched window: all its lines, and two hashes of what they hold."""
    known = ["h", "g", "words", "before"]
    plain = lines.select(*DOC, "line", *known, F.lit(False).alias("ahead"), F.lit(False).alias("behind"))
    marks = _matched(lines).select(*DOC, "line", *[F.lit(None).cast(plain.schema[c].dataType).alias(c) for c in known], (F.col("side") == "ahead").alias("ahead"), (F.col("side") == "behind").alias("behind"))
    both = plain.unionByName(marks).repartition(*DOC).groupBy(*DOC, "line").agg(*[F.max(c).alias(c) for c in (*known, "ahead", "behind")])
    both = both.withColumn("some", F.max(F.col("ahead") | F.col("behind")).over(Window.partitionBy(*DOC))).where("some").withColumn("after", F.col("before") + F.col("words"))
    held = {k: F.when(F.col(k), F.collect_list(F.struct("line", "h", "g", "words")).over(f)) for k, f in _frames(params.min_words).items()}
    each = both.select(*DOC, F.array(*held.values()).alias("held")).select(*DOC, F.explode("held").alias("held")).where("held IS NOT NULL")
    inside = F.col("held")
    return each.select(
        *DOC, inside[0]["line"].alias("first"), F.element_at(inside, -1)["line"].alias("last"),
        F.xxhash64(F.transform(inside, lambda x: x["h"])).alias("k1"), F.xxhash64(F.lit(3), F.transform(inside, lambda x: x["g"])).alias("k2"),
        F.transform(inside, lambda x: F.struct(x["line"].alias("line"), x["words"].alias("words"))).alias("lines"),
    )


def repeated_lines(documents: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """(doc_id, row_key, line, words) of each line to delete; lines count from 0."""
    stretches = cut(_extended(cut(winnow(documents, params)), params))
    order = F.struct("doc_id", "row_key", "first", "last")
    # Summed before the shuffle and written, so that a stretch that many documents hold can be split over tasks in the join.
    kept = cut(stretches.groupBy("k1", "k2").agg(F.min(order).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = stretches.join(kept, ["k1", "k2"]).where(order != F.col("kept"))
    same = (F.col("kept.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("kept.row_key") == F.col("row_key"))
    mine = F.filter("lines", lambda x: ~same | (x["line"] > F.col("kept.last")))
    return later.select(*DOC, F.explode(mine).alias("x")).select(*DOC, "x.line", "x.words").distinct()


def dedup_lines(documents: DataFrame, params: LineDedupParams = LineDedupParams(), counts: bool = True) -> DataFrame:
    """``documents`` with later repeated runs of lines deleted from ``text``.

    With ``counts``, n_lines, n_removed_lines and n_removed_words are added in place of any columns of those names.
    """
    added = ("n_lines", "n_removed_lines", "n_removed_words")
    names = [c for c in documents.columns if not counts or c.lower() not in added]
    marks = cut(
        repeated_lines(documents, params)
        .groupBy(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"))
        .agg(F.collect_set("line").alias("__cut"), F.sum("words").alias("__words"))
    )
    # Texts travel as their lines, so that those are at hand, by number, behind the join.
    split = documents.select(*[F.split("text", "\n", -1).alias("__parts") if c == "text" else F.col(c) for c in names], F.xxhash64("text").alias("__of"))
    joined = split.join(marks, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__of") == F.col("__key")), "left")
    numbers = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__cut")
    left = F.when(F.col("__cut").isNull(), F.col("__parts")).otherwise(F.transform(numbers, lambda i: F.get("__parts", i)))
    out = [F.array_join(left, "\n").alias("text") if c == "text" else F.col(c) for c in names]
    if counts:
        some = F.col("__parts").isNotNull() & (F.col("__parts") != F.array(F.lit("")))
        sizes = (F.when(some, F.size("__parts")), F.size("__cut"), F.col("__words"))
        out += [F.coalesce(F.when(F.col("__parts").isNotNull(), x), F.lit(0)).cast("long").alias(c) for c, x in zip(added, sizes, strict=True)]
    return joined.select(*out)
