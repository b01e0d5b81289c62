import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvidex.functions import blocks, control, text as tx
from corvidex.functions.blocks import inline
from corvidex.operators import segmentation


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()["x"]


def test_preprocess(spark):
    raw = "﻿﻿Ёлка\r\nA\rB\x00\x07\tﬁ x"
    assert one(spark, tx.preprocess(F.col("t")), t=raw) == "елка\na\nb\tfi x"
    assert unicodedata.is_normalized("NFKC", one(spark, tx.nfkc(F.col("t")), t="①é"))


@pytest.mark.parametrize(
    "query, tokens",
    [("боль в животе!", ["боль", "в", "животе"]), ("2024 год 12", ["год"]), ("b12 a_b x-y", ["b12", "a_b", "x", "y"]), ("", []), (" ?! ", []), ("№5 ттг", ["ттг"])],
)
def test_query_tokens(spark, query, tokens):
    assert one(spark, tx.query_tokens(F.col("t")), t=query) == tokens


def test_expansion_keeps_first_occurrences(spark):
    assert one(spark, tx.expand(tx.query_tokens(F.col("t"))), t="ттг и tsh ттг") == ["ттг", "tsh", "и"]


def test_tags(spark):
    sources = [F.col("a"), F.col("b"), F.col("c")]
    got = one(spark, tx.tags(sources), a="Анализы", b="table", c="ТТГ/ПТГ > эхо-кг, для 12мг мкмоль/л (печень)")
    assert got == "pth table tsh анализы печень птг ттг эхо эхокардиография эхокг"


@pytest.mark.parametrize("n, expected", [(100, "ab\ncd\nef"), (6, "ab\ncd"), (5, "ab"), (2, "ab"), (1, "a")])
def test_first_chars(spark, n, expected):
    assert one(spark, tx.first_chars(F.col("t"), n), t="ab\ncd\nef") == expected


@pytest.mark.parametrize("room", [0, 1, 14, 15, 16, 17, 18, 30, 39, 40, 41])
def test_cut_middle(spark, room):
    text, mark = "0123456789" * 4, "\n…[truncated]…\n"
    half = (room - len(mark)) // 2
    expected = text if len(text) <= room else text[:room] if room <= len(mark) else text[:half] + mark + text[len(text) - half :]
    assert one(spark, tx.cut_middle(F.col("t"), F.col("n")), t=text, n=room) == expected


@pytest.mark.parametrize("name, expected", [(" a/b/c.md ", "c.md"), ("", "upload.md"), ("x\x00.md", "x.md"), ("dir/", "upload.md")])
def test_safe_filename(spark, name, expected):
    assert one(spark, tx.safe_filename(F.col("t")), t=name) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("20240305", "2024-03-05"), ("5.3.2024", "2024-03-05"), ("05/03/24 10:30", "2024-03-05"), ("2024-03-05", "2024-03-05"), ("2024-99-99 x", "2024-99-99"), ("1.2", "1.2")],
)
def test_iso_date(spark, value, expected):
    assert one(spark, control.iso_date(F.col("t")), t=value) == expected


@pytest.mark.parametrize(
    "lines, expected",
    [
        ("# категория: анализы", "Анализы"), ("**категория:** консультация врача", "Консультация"), ("категория : выписка", "Выписка"),
        ("категория: прочее\nкатегория: диагноз", "Диагноз"), ("нет", None), ("\n" * 30 + "категория: диагноз", None),
    ],
)
def test_category(spark, lines, expected):
    assert one(spark, control.category(F.col("t")), t=lines) == expected


@pytest.mark.parametrize(
    "text, path, expected",
    [
        ("**дата:** 01.02.2024", "x.md", "2024-02-01"),
        ("**дата рождения:** 01.02.1990\n**дата анализа:** 2024-05-06", "x.md", "2024-05-06"),
        ("**дата заказа:** 01.01.2024\n**дата валидации:** 02.01.2024", "x.md", "2024-01-02"),
        ("**дата заказа:** 01.01.2024\n**дата:** 03.01.2024", "x.md", "2024-01-03"),
        ("---\ntitle: x\ndate: 2023-02-24\n---\nbody", "20200101.md", "2023-02-24"),
        ("---\nvisit_date: '05.06.2023'\n---", "x.md", "2023-06-05"),
        ("---\ndate: 2023-02-24\nno end", "2022-03-04_report.md", "2022-03-04"),
        ("nothing", "lab-20260604.md", "2026-06-04"),
        ("**дата рождения:** 01.02.1990", "x.md", None),
    ],
)
def test_document_date(spark, text, path, expected):
    assert one(spark, control.document_date(F.col("t"), F.col("p")), t=text, p=path) == expected


def test_body(spark):
    assert one(spark, control.body(F.col("t")), t="---\ndate: x\n---\n# a\n**категория:** анализы\nтекст\nкатегория: диагноз") == "# a\nтекст\nкатегория: диагноз"


def test_inline():
    assert inline(r"\*x\* ``a`b``") == "*x* a`b"


def test_only_texts_that_nfkc_may_change_go_to_python(spark):
    r = random.Random(3)
    pool = ["a", " ", "é", "e\u0301", "я", "и\u0306", "\u0301", "①", "ﬁ", "\u00a0", "…", "ё", "漢", "가", "\u1100", "\u1161", "\u11a8", "\u0915\u093c", "\u09c7\u09be", "が", "か\u3099", "Å", "\u0338", "=", "😀", "\U0001d400", "ſ", "\u0323", "\n"]
    texts = ["".join(r.choices(pool, k=r.randint(0, 6))) for _ in range(3000)] + [chr(n) for n in [*range(1, 0xD800), *range(0xE000, 0x11000)]] + [None, "a" * 50_000]
    # Each of the letters that aren't sent stays one behind any other.
    calm = [c for c in map(chr, range(0x20, 0xD800)) if re.fullmatch("[" + re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), tx._stable_letters()) + "]", c)]
    texts += ["".join(r.choices(calm[:1500], k=30)) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.nfkc(F.col("t")).alias("x"))
    assert [x.x for x in df.collect()] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert "_nfkc(CASE WHEN RLIKE" in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(calm) > 30_000


def test_only_marked_blocks_go_to_python(spark):
    r = random.Random(4)
    pool = ["a", "b c", " ", "\n", "\t", "*", "**", "_", "__", "`", "\\", "!", "[", "](", ")", "]", "<", "<http://x>", "mailto:", ">", "\u00a0", "\u2028", "\x1f", ":", "  \n "]
    texts = ["".join(r.choices(pool, k=r.randint(0, 8))) for _ in range(5000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(blocks.has_marks(F.col("t")).alias("m"), blocks.unmarked(F.col("t")).alias("x")).collect()
    assert 500 < sum(x.m for x in rows) < 4500
    assert all(x.m or x.x == blocks.inline(t) and not blocks.subtype(t) for t, x in zip(texts, rows))
    plan = segmentation.read_blocks(spark.createDataFrame([("d", "a\n\nb")], "document_id string, body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "marked(CASE WHEN exists" in plan
