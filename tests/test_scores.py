"""Scores don't hang on the order of summing, and chunks of a common term aren't brought together."""

import operator
import random
from functools import reduce

from pyspark.sql import functions as F

from corvidex.operators import expressions, search as s


def test_equal_chunks_have_equal_ranks(spark):
    r = random.Random(1)
    while True:  # parts whose plain sums fall on two sides of a rounding edge
        parts = [r.uniform(1, 15) for _ in range(30)]
        if round(reduce(operator.add, parts), 12) != round(reduce(operator.add, reversed(parts)), 12):
            break
    rows = [(f"t{i}", False, 1, 0, x) for i, x in enumerate(parts)] + [(f"t{i}", False, 2, 0, x) for i, x in reversed(list(enumerate(parts)))]
    each = spark.createDataFrame(rows, "q string, is_prefix boolean, document_id long, chunk_no int, part double").coalesce(1)
    terms = spark.createDataFrame([(0, f"t{i}", False) for i in range(30)], "qid long, term string, is_prefix boolean")
    assert len({x.rank for x in s.scores(each, terms).collect()}) == 1


def _chunks(spark):
    rows = [(i, 0, "section", f"some of the text {i}", "a", "b", "en") for i in range(400)]
    return spark.createDataFrame(rows, "document_id long, chunk_no int, kind string, text string, section_path string, heading string, tags_text string")


def test_chunks_of_one_term_or_phrase_are_dealt_over_many_tasks(spark):
    held = s.index(_chunks(spark))
    for words in (["some"], ["of", "the"]):
        terms = spark.createDataFrame([(0, " ".join(words), False, words)], "qid long, term string, is_prefix boolean, words array<string>")
        ranks = s.scores(s.parts(held, terms), terms).withColumn("task", F.spark_partition_id())
        found = [x["count"] for x in ranks.groupBy("task").count().collect()]
        assert sum(found) == 400 and max(found) <= 40


def test_programs_of_few_and_of_many_leaves_agree(spark):
    held = s.index(_chunks(spark))
    long = " OR ".join(["(some AND 7) NOT text"] * 3 + ["7"] * 3)
    queries = spark.createDataFrame([(0, "some AND 7"), (1, long), (2, '"of the" NOT 7'), (3, "")], "qid long, query string")
    found = {}
    for x in expressions.search_expressions(held, queries).collect():
        found.setdefault(x.qid, set()).add(x.document_id)
    assert found == {0: {7}, 1: {7}, 2: set(range(400)) - {7}}
