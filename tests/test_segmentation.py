"""Blocks of a plan against a parser that walks the lines, on fixed and random texts."""

import random

import pytest

from corvidex.operators import ingest, segmentation
from tests.markdown_lines import blocks

FIXED = {
    "# A\n\ntext *em* **b** `c`\nnext [l](u) ![i](v)\n\n## B ##\n": [("heading", 1, "A", ""), ("paragraph", 0, "text em b c next l", ""), ("heading", 2, "B", "")],
    "**Label:**\n\n- one\n- two\n  - deep\n- three\n\n1. x\n2. y": [("paragraph", 0, "Label:", "bold_label"), ("list", 0, "- one\n- two\n- three", ""), ("list", 0, "- x\n- y", "")],
    "**Name**: value\n\n**a** b: c": [("paragraph", 0, "Name: value", "fact"), ("paragraph", 0, "a b: c", "")],
    "| a | b |\n|---|---|\n| 1 | |\n| 3 | 4 |\n\nend": [("table", 0, "a | b\n1 | \n3 | 4", ""), ("paragraph", 0, "end", "")],
    "```py\nx = 1\n\ny\n```\n---\n> quote\n> # H\n\n    code\n\n<div>\nhtml\n</div>": [("fence", 0, "x = 1\n\ny", ""), ("paragraph", 0, "quote", ""), ("heading", 1, "H", "")],
    "Title\n=====\nSub\n---\n#\n#nohead": [("heading", 1, "Title", ""), ("heading", 2, "Sub", ""), ("heading", 1, "", ""), ("paragraph", 0, "#nohead", "")],
    # Fences: a shorter or other mark doesn't close, nor one with text; a fence in a quote ends with it.
    "````\n```\n~~~~\n```` x\n````\nend": [("fence", 0, "```\n~~~~\n```` x", ""), ("paragraph", 0, "end", "")],
    "> ```\n> a\nout": [("fence", 0, "a", ""), ("paragraph", 0, "out", "")],
    "~~~\nopen\n# a": [("fence", 0, "open\n# a", "")],
    "- a\n  ```\n  code\n  ```\n- b": [("list", 0, "- a\n- b", "")],
    # Quotes: lazy lines, lists and inner quotes.
    "> one\ntwo\n\nthree": [("paragraph", 0, "one two", ""), ("paragraph", 0, "three", "")],
    "> - a\n> - b\n>\n> > deep\n\n- c": [("list", 0, "- a\n- b", ""), ("paragraph", 0, "deep", ""), ("list", 0, "- c", "")],
    # Lists: lazy lines, blank lines between items, another mark begins another list, a number over 1 doesn't end a paragraph.
    "- a\nlazy\n\n- b\n* c\n\nd": [("list", 0, "- a lazy\n- b", ""), ("list", 0, "- c", ""), ("paragraph", 0, "d", "")],
    "text\n2. no\n1. yes": [("paragraph", 0, "text 2. no", ""), ("list", 0, "- yes", "")],
    "- \n- ": [],
    # Tables: fewer and more cells than the header, an escaped bar, a paragraph before.
    "p\n| a\\|x | b |\n|:-|-:|\n| 1 |\n| 1 | 2 | 3 |": [("paragraph", 0, "p", ""), ("table", 0, "a|x | b\n1 | \n1 | 2", "")],
    "": [],
    "\n \n": [],
}


def of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "document_id int, body string")
    rows = segmentation.read_blocks(df).orderBy("document_id", "pos").collect()
    out = {i: [] for i in range(len(texts))}
    for r in rows:
        assert r.pos == len(out[r.document_id])
        out[r.document_id].append((r.type, r.level, r.content, r.subtype, r.markup))
    return list(out.values())


def test_fixed_texts(spark):
    got = of(spark, list(FIXED))
    for text, blocks_, expected in zip(FIXED, got, FIXED.values(), strict=True):
        assert [b[:4] for b in blocks_] == expected, text


def test_marks_nulls_and_more_columns(spark):
    df = spark.createDataFrame([(1, "## a\n```py x\n1\n```", "s"), (2, None, "t"), (3, "", "u")], "document_id int, body string, level string")
    got = segmentation.read_blocks(df.withColumnRenamed("level", "source"), "source").orderBy("pos").collect()
    assert [(r.source, r.type, r.markup, r.content) for r in got] == [("s", "heading", "##", "a"), ("s", "fence", "py x", "1")]


LINES = ["", "", "a", "b c", "# h", "## **h**", "- x", "- y", "  more", "  - deep", "* z", "1. one", "2. two", "> q", "> # k", "> - i", "---", "| a | b |", "|---|---|", "| 1 | 2 |", "```", "code `x`", "**l:**", "**f**: v", "    four\n"]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_the_walk(spark, seed):
    r = random.Random(seed)
    texts = ["\n".join(r.choice(LINES) for _ in range(r.randint(1, 12))) for _ in range(400)]
    got, wrong = of(spark, texts), []
    for text, found in zip(texts, got, strict=True):
        expected = [(b.type, b.level, b.content, b.subtype) for b in blocks(text)]
        if [f[:4] for f in found] != expected:
            wrong.append((text, [f[:4] for f in found], expected))
    assert not wrong, (len(wrong), wrong[:3])


def test_long_text_is_linear(spark):
    text = "# h\n" + "- item\n" * 100_000 + "\n" + "```\nx\n```\n" * 2_000
    df = spark.createDataFrame([(1, text)], "document_id int, body string")
    assert sorted(map(tuple, segmentation.read_blocks(df).groupBy("type").count().collect())) == [("fence", 2_000), ("heading", 1), ("list", 1)]


def test_one_exchange_before_the_function_and_one_behind(spark):
    df = spark.createDataFrame([(1, "a")], "document_id int, body string")
    plan = ingest.section_paths(segmentation.read_blocks(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1
