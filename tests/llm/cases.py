"""Documents that every operator has to take: nulls, empty and very long texts, ties, repeated rows, extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, row string, h string, node string"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    passage = words(2, 60)
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n \n"), (7, "two words"), (8, "two words"),
        (9, words(3, 30) + "\n" + passage + "\n" + words(4, 20)), (10, words(5, 25) + "\n" + passage + "\n" + words(6, 90)),
        (11, words(7, 40_000)), (12, "x" * 300_000), (13, "Grüße, ÉCOLE ñandú — 漢字 😀 " + words(8, 70)),
        (1, base), (None, words(9, 80)), (None, None), (14, "a b c\na b c\na b c\n" + words(10, 60)),
    ]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0, "mine", "mine", "mine", "mine", "mine") for i, t in rows], SCHEMA)


def same(found, expected):
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(found, key=key) == sorted(expected, key=key)
