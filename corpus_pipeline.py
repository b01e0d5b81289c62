"""Cleaning a training corpus in five stages, each by one operator of ``corvidex.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the
columns of ``documents``; the last returns packed pieces. ``run`` writes each
stage's documents to the shared checkpoint folder before the next one reads
them. Null and empty texts are kept by every filtering stage (of equal texts,
the near-duplicate stage keeps one), and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvidex.llm import decontamination, jaccard_join, packing, toxicity
from corvidex.llm._session import cut, table
from corvidex.llm.line_dedup import dedup_lines
from corvidex.llm.queries import tokenizer_path

ORACLE_SQL = None  # a fitted classifier, a forest and tokenized packing are beyond SQL; tests compare with brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.score(docs, model, ("__score", "__toxic")).where("`__toxic` = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.PackingParams(tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
