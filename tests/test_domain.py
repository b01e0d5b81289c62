from pyspark.sql import functions as F

from corvidex.operators import search as s, store
from corvidex.plans import prompts
from corvidex.plans.queries import QUERIES, SQL
from corvidex.plans import domain_queries  # noqa: F401  registers its queries


def test_each_query_has_a_name_and_most_have_sql():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) - len(SQL) <= 2


def test_render_never_reads_values_as_templates(spark):
    row = spark.createDataFrame([("{b}", None)], "a string, b string")
    assert row.select(prompts.render("x{a}{b}{a}", {"a": F.col("a"), "b": F.col("b")}).alias("r")).first().r == "x{b}{b}"


def test_last_of_equal_new_rows_wins(spark):
    old = spark.createDataFrame([(1, "a", 0)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 0), (2, "e", 5)], "id int, v string, n int")
    assert sorted(map(tuple, store.upsert(old, new, ["id"], "n").collect())) == [(1, "b", 2), (2, "e", 5)]


def test_a_token_of_several_terms_is_a_phrase(spark):
    terms = s.compile_query(spark, {0: "a_b c"}).collect()
    assert {(r.term, tuple(r.words)) for r in terms} == {("a b", ("a", "b")), ("c", ("c",))}
