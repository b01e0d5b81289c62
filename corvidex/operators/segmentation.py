"""Markdown blocks as a plan: lines are rows, their classes are columns, and blocks begin where running windows say so.

Fences are found first, by a fold over the few lines that can open or close one,
and stay one row each. All other lines are told apart by patterns. What a line
depends on (the open list, html zone, quote, table or paragraph) is the last
event before it, so every rule is a running maximum or last value over one
window by document. Only inline text goes through a function, once per block.

Defined cases: a null or empty body has no blocks; ``document_id`` must be
unique. Text of nested lists, code and html inside a list item is left out, as
are indented code and html. Bounds of this plan: fences are told before html,
so one inside an html zone counts; an item's text begins one
column behind its marker, however many spaces follow; of several underlines in a row
the first alone makes a heading; references of links stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvidex.functions import blocks as md

_QUOTE = r"^(?: {0,3}> ?)+"
_MARK = r"^ {0,3}(`{3,}(?=[^`]*$)|~{3,})"
_RULE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
_ITEM = r"^( *)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|)$"
_DIVIDER = r"^ {0,3}\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
_BAR = r"(?<!\\)\|"


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def _inside(line: Column) -> Column:
    return F.regexp_replace(line, _QUOTE, "")


def _fences(lines: Column) -> Column:
    """Array of (first, last, closed) of the fences among ``lines``; a fence in a quote ends with it."""

    def event(line: Column, n: Column) -> Column:
        inside = _inside(line)
        left = F.coalesce(_depth(line) < _depth(F.get(lines, n - 1)), F.lit(False))
        return F.struct(n.alias("n"), _depth(line).alias("depth"), F.regexp_extract(inside, _MARK, 1).alias("mark"), inside.rlike(r"^ {0,3}[`~]{3,}\s*$").alias("bare"), left.alias("left"))

    def span(state: Column, last: Column, closed: bool) -> Column:
        return F.struct(state["at"].alias("first"), last.alias("last"), F.lit(closed).alias("closed"))

    def step(s: Column, e: Column) -> Column:
        is_open = s["at"] >= 0
        ended = is_open & (e["depth"] < s["depth"])
        closes = is_open & ~ended & (e["depth"] == s["depth"]) & e["bare"] & (F.left(e["mark"], F.lit(1)) == F.left(s["mark"], F.lit(1))) & (F.length(e["mark"]) >= F.length(s["mark"]))
        opens = (~is_open | ended) & (e["mark"] != "")
        done = F.when(ended, F.array_append(s["done"], span(s, e["n"] - 1, False))).when(closes, F.array_append(s["done"], span(s, e["n"], True))).otherwise(s["done"])
        at = F.when(opens, e["n"]).when(ended | closes, -1).otherwise(s["at"])
        return F.struct(done.alias("done"), at.alias("at"), F.when(opens, e["depth"]).otherwise(s["depth"]).alias("depth"), F.when(opens, e["mark"]).otherwise(s["mark"]).alias("mark"))

    events = F.filter(F.transform(lines, event), lambda e: (e["mark"] != "") | e["left"])
    first = F.struct(F.array().cast("array<struct<first:int,last:int,closed:boolean>>").alias("done"), F.lit(-1).alias("at"), F.lit(0).alias("depth"), F.lit("").alias("mark"))
    return F.aggregate(events, first, step, lambda s: F.when(s["at"] >= 0, F.array_append(s["done"], span(s, F.size(lines) - 1, False))).otherwise(s["done"]))


def read_lines(documents: DataFrame, *more: str) -> DataFrame:
    """(document_id, ``more``, n, raw, fence, closed): each line, or each fence whole under the number of its first line."""
    lines, fences = F.col("__lines"), F.col("__fences")
    d = documents.where("body <> ''").select("document_id", *more, F.split(F.translate("body", "\x01", ""), "\n", -1).alias("__lines"))
    none = F.array().cast("array<struct<first:int,last:int,closed:boolean>>")
    d = d.withColumn("__fences", F.when(F.exists(lines, lambda x: x.contains("```") | x.contains("~~~")), _fences(lines)).otherwise(none))

    def rows(k: Column) -> Column:
        """Lines between fence k - 1 and fence k, then fence k."""
        f = F.get(fences, k)
        lo = F.coalesce(F.get(fences, k - 1)["last"] + 1, F.lit(0))
        hi = F.coalesce(f["first"], F.size(lines))
        between = F.transform(F.slice(lines, lo + 1, hi - lo), lambda x, i: F.struct((lo + i).alias("n"), x.alias("raw"), F.lit(False).alias("fence"), F.lit(False).alias("closed")))
        whole = F.struct(f["first"].alias("n"), F.array_join(F.slice(lines, f["first"] + 1, f["last"] - f["first"] + 1), "\n").alias("raw"), F.lit(True).alias("fence"), f["closed"].alias("closed"))
        return F.when(f.isNull(), between).otherwise(F.array_append(between, whole))

    return d.select("document_id", *more, F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size(fences)), rows))))


def _cells(row: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(row, r"^\s+|\s+$", ""), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.split(bare, _BAR, -1), lambda c: F.replace(c, F.lit("\\|"), F.lit("|")))


def _classes(lines: DataFrame) -> DataFrame:
    """Columns of what a line is by itself."""
    s = F.col("s")
    out = lines.withColumns({"depth": _depth(F.col("raw")), "s": _inside(F.when(F.col("fence"), F.substring_index("raw", "\n", 1)).otherwise(F.col("raw")))})
    out = out.withColumn("raw", F.when(F.col("fence"), F.col("raw")))
    item, text = s.rlike(_ITEM), F.regexp_extract(s, _ITEM, 3)
    marker = F.regexp_extract(s, _ITEM, 2)
    out = out.withColumns(
        {
            "blank": ~F.col("fence") & s.rlike(r"^\s*$"),
            "indent": F.when(s.rlike(r"^ {0,3}\t"), 4).otherwise(F.length(F.regexp_extract(s, "^( *)", 1))),
            "heading": s.rlike(r"^ {0,3}#{1,6}(?:[ \t]|$)"),
            "rule": s.rlike(_RULE),
            "item": item & ~s.rlike(_RULE),
            "offset": F.length(F.regexp_extract(s, "^( *)", 1)) + F.length(marker) + 1,
            "kind": F.right(marker, F.lit(1)),
            "strong": (text != "") & ~marker.rlike(r"^(?!1[.)])\d"),
            "html": s.rlike(r"^ {0,3}</?[A-Za-z!?]") & ~s.rlike("^ *<http"),
            "under": s.rlike(r"^ {0,3}(?:=+|-+)[ \t]*$"),
            "n_cells": F.size(_cells(s)),
            "divider": s.rlike(_DIVIDER),
        }
    )
    w = Window.partitionBy("document_id").orderBy("n")
    next_divides = F.lead(F.col("divider") & ~F.col("fence")).over(w) & (F.lead("n_cells").over(w) == F.col("n_cells")) & (F.lead("depth").over(w) == F.col("depth"))
    head = s.contains("|") & ~F.col("fence") & ~F.col("item") & ~F.col("heading") & F.coalesce(next_divides, F.lit(False))
    out = out.withColumn("head", head).withColumn("below_head", F.coalesce(F.lag("head").over(w), F.lit(False)))
    return out.withColumns({"rule": F.col("rule") & ~F.col("below_head"), "item": F.col("item") & ~F.col("below_head")})


def segment(lines: DataFrame) -> DataFrame:
    """``lines`` with block (number of the block within its document, ascending), what, own (begins a list item) and level; lines of no block are left out."""
    w = Window.partitionBy("document_id").orderBy("n")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    c = F.col
    no = F.lit(False)

    def latest(when: Column, over=upto) -> Column:
        return F.coalesce(F.max(F.when(when, c("n"))).over(over), F.lit(-1))

    x = _classes(lines)
    # A line without a quote mark continues a quoted paragraph before it.
    x = x.withColumn("text", ~(c("blank") | c("heading") | c("rule") | c("fence") | (c("item") & c("strong"))))
    carried = F.when(c("text") | c("item"), c("depth")).otherwise(0)
    lazy = c("text") & (c("depth") == 0)
    x = x.withColumn("carried", F.last(F.when(~lazy, carried), ignorenulls=True).over(upto))
    x = x.withColumn("quote", F.when(lazy, F.coalesce("carried", F.lit(0))).otherwise(c("depth")))
    x = x.withColumn("apart", F.coalesce(F.lag("quote").over(w) != c("quote"), no))
    x = x.withColumn("fresh", c("apart") | F.coalesce(F.lag(c("blank") | c("heading") | c("rule") | c("fence")).over(w), F.lit(True)))
    # Html goes on to the next blank line.
    starts = c("html") & c("fresh")
    x = x.withColumn("in_html", ~c("blank") & ~c("fence") & (latest(starts) >= 0) & (latest(starts) >= latest(c("blank") | c("fence") | c("apart"))))
    # Lists: the last of their events tells whether one is open. What ends a list whose first mark is indented is known once that mark is.
    begins = c("item") & ~c("in_html") & (c("indent") < 4) & (c("strong") | c("fresh"))
    closes = c("fresh") | c("heading") | c("rule") | c("fence") | c("in_html")
    x = x.withColumn("room", F.lit(2))
    for _ in range(2):
        ends = ~c("item") & (c("apart") | (~c("blank") & (c("indent") < c("room")) & closes))
        x = x.withColumn("listed", F.coalesce(F.last(F.when(ends, 0).when(begins, 1), ignorenulls=True).over(upto) == 1, no))
        x = x.withColumn("first", c("listed") & begins & (c("apart") | ~F.coalesce(F.lag("listed").over(w), no)))
        marks = c("first") | (c("listed") & c("item") & (c("indent") < c("room")))
        x = x.withColumn("marks", marks).withColumn("room", F.coalesce(F.last(F.when(c("marks"), c("offset")), ignorenulls=True).over(before), F.lit(2)))
    x = x.withColumn("own", c("listed") & c("item") & (c("first") | (c("indent") < c("room"))))
    x = x.withColumn("kind_before", F.last(F.when(c("own"), c("kind")), ignorenulls=True).over(before))
    x = x.withColumn("nested", c("listed") & (latest(c("item") & ~c("own")) > latest(c("own"))))
    new_list = c("own") & (F.coalesce(c("first"), no) | (c("kind") != c("kind_before")))
    # Other text: runs between the lines above; code and tables are told by a run's first lines.
    x = x.withColumn("plain", ~(c("blank") | c("heading") | c("rule") | c("fence") | c("listed") | c("in_html")))
    x = x.withColumn("begin", c("plain") & (c("apart") | ~F.coalesce(F.lag("plain").over(w), no)))
    x = x.withColumn("run", latest(c("begin")))
    x = x.withColumn("code", c("plain") & (latest(c("plain") & (c("indent") < 4)) < c("run")))
    x = x.withColumn("head", c("head") & c("plain") & ~c("code"))
    x = x.withColumn("tabled", c("plain") & (latest(c("head")) >= c("run")))
    x = x.withColumn("top", c("tabled") & ~F.coalesce(F.lag("tabled").over(w) & ~c("begin"), no))
    x = x.withColumn("para", c("plain") & ~c("code") & ~c("tabled"))
    over_it = F.coalesce(F.lag(c("para") & ~c("under")).over(w), no) & ~c("apart")
    x = x.withColumn("closing", c("under") & over_it & ~c("tabled") & ~c("in_html") & ~c("listed"))
    fresh_para = c("para") & ~c("closing") & ~F.coalesce(F.lag(c("para") & ~c("closing")).over(w) & ~c("apart"), no)
    headed = c("heading") & ~c("in_html") & ~c("listed")
    fenced = c("fence") & ~c("listed")
    x = x.withColumns({"begins": fresh_para | new_list | c("top") | headed | fenced})
    what = F.when(fenced, "fence").when(headed, "heading").when(c("listed") & ~c("nested") & ~c("blank") & ~c("fence") & ~c("in_html"), "list").when(c("closing"), "underline").when(c("tabled"), "table").when(c("para"), "paragraph")
    level = F.when(headed, F.length(F.regexp_extract("s", "^ *(#+)", 1))).when(c("closing"), F.when(c("s").contains("="), 1).otherwise(2)).otherwise(0)
    x = x.withColumns({"block": F.sum(c("begins").cast("int")).over(upto), "what": what, "level": level})
    return x.where("what IS NOT NULL")


def _source(rows: DataFrame) -> Column:
    """What a line adds to its block."""
    s = F.col("s")
    heading = F.regexp_replace(F.regexp_replace(s, r"^ {0,3}#{1,6}[ \t]*", ""), r"(?:(?:^|[ \t]+)#+)?[ \t]*$", "")
    trimmed = F.regexp_replace(s, r"^\s+|\s+$", "")
    item = F.concat(F.lit("\x01"), F.regexp_replace(F.regexp_extract(s, _ITEM, 3), r"^\s+|\s+$", ""))
    return F.when(rows["what"] == "heading", heading).when(rows["what"] == "fence", F.col("raw")).when(F.col("own"), item).otherwise(trimmed)


def _fence(raw: Column, depth: Column, closed: Column) -> tuple[Column, Column]:
    """(content, info) of a fence."""
    bare = F.when(depth > 0, F.regexp_replace(raw, "(?m)" + _QUOTE, "")).otherwise(raw)
    info = F.trim(F.regexp_replace(F.substring_index(bare, "\n", 1), r"^ {0,3}(?:`{3,}|~{3,})", ""))
    body = F.when(F.instr(bare, "\n") > 0, F.substr(bare, F.instr(bare, "\n") + 1)).otherwise("")
    body = F.when(closed, F.regexp_replace(body, r"(?:^|\n)[^\n]*\z", "")).otherwise(body)
    return F.regexp_replace(body, r"^\s+|\s+$", ""), info


def read_blocks(documents: DataFrame, *more: str) -> DataFrame:
    """(document_id, ``more``, pos, type, level, content, markup, subtype) of the blocks of ``body``."""
    c = F.col
    rows = segment(read_lines(documents, *more))
    keep = F.when(c("what") != "underline", F.struct("n", _source(rows).alias("source")))
    kind = F.first(F.when(c("what") != "underline", c("what")), ignorenulls=True)
    one = F.when(c("what") == "fence", c("depth"))
    b = rows.groupBy("document_id", *more, "block").agg(kind.alias("what"), F.max("level").alias("level"), F.max(one).alias("depth"), F.max("closed").alias("closed"), F.max(c("what") == "underline").alias("under"), F.array_sort(F.collect_list(keep)).alias("rows"))
    sources = F.transform("rows", lambda r: r["source"])
    text = F.array_join(sources, "\n")
    content, info = _fence(text, c("depth"), c("closed"))
    header = F.size(_cells(F.get(sources, F.lit(0))))
    padded = F.transform(F.filter(sources, lambda _, i: i != 1), lambda r: F.slice(F.concat(_cells(r), F.array_repeat(F.lit(""), header)), F.lit(1), header))
    parts = F.when(c("what") == "table", F.flatten(padded)).when(c("what") == "list", F.split(F.substr(text, F.lit(2)), "\n\x01", -1)).when(c("what") == "fence", F.array()).otherwise(F.array(text))
    b = b.select("document_id", *more, "block", "what", "level", "under", content.alias("code"), info.alias("info"), header.alias("width"), parts.alias("parts"))
    # Blocks without inline marks, most of all texts, aren't sent to Python.
    b = b.withColumn("plain", md.marked(F.when(F.exists("parts", md.has_marks), c("parts"))))
    b = b.withColumn("told", F.coalesce("plain.parts", F.transform("parts", md.unmarked)))
    told = c("told")
    table = F.array_join(F.transform(F.sequence(F.lit(0), (F.size(told) / F.greatest(c("width"), F.lit(1))).cast("int") - 1), lambda k: F.array_join(F.slice(told, k * c("width") + 1, c("width")), " | ")), "\n")
    listed = F.array_join(F.transform(F.filter(told, lambda t: t != ""), lambda t: F.concat(F.lit("- "), t)), "\n")
    kind = F.when(c("under") & (c("what") == "paragraph"), "heading").otherwise(c("what"))
    shown = F.when(c("what") == "fence", c("code")).when(c("what") == "table", table).when(c("what") == "list", listed).otherwise(F.get(told, F.lit(0)))
    b = b.select("document_id", *more, "block", kind.alias("type"), "level", shown.alias("content"), "info", "plain.subtype")
    b = b.where("content <> '' OR type = 'heading'")
    markup = F.when(c("type") == "heading", F.repeat(F.lit("#"), c("level"))).when(c("type") == "fence", c("info")).otherwise("")
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("block")) - 1
    return b.select("document_id", *more, pos.alias("pos"), "type", "level", "content", markup.alias("markup"), F.when(c("type") == "paragraph", c("subtype")).otherwise("").alias("subtype"))
