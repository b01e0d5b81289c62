"""The ``opN_<name>`` queries over the driver's tables, with production parameters, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvidex.llm import conversation_repair, decontamination, embedding_dedup, hard_negatives, jaccard_join, license_scan, packing, quality_rules, secret_scan, token_counts, toxicity, url_filters
from corvidex.llm._session import table
from corvidex.llm.line_dedup import dedup_lines


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines", "n_removed_words")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackingParams(tokenizer_path("word_bpe_49k.json")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), "source").drop("n_removed_words")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.TokenCountParams(tokenizer_path("byte_bpe_50k.json")))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    order = [r.kind for r in secret_scan.BASE_RULES]
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(order))
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in order]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_filters, op2_toxicity, op3_line_dedup, op4_decontamination, op5_packing, op6_jaccard_join, op7_quality_rules, op8_token_counts, op9_secret_scan, op10_license_scan,
        op11_conversation_repair, op12_embedding_near_dedup, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of line dedup (each line of a stretch of 50 words or more that stands earlier too), quality rules, conversation repair (costs from the last row
    back), near vectors and hard negatives (all pairs); the other methods are tested against brute force."""
    return {
        "op3_line_dedup": _LINE_DEDUP_SQL, "op7_quality_rules": _QUALITY_SQL, "op11_conversation_repair": _repair_sql(),
        "op12_embedding_near_dedup": _NEAR_VECTORS_SQL, "op13_hard_negatives": _HARD_NEGATIVES_SQL,
    }


_WORDS_SQL = r"list_filter(regexp_split_to_array({x}, '[\x20\x09-\x0D]+'), lambda y: y <> '')"

_LINE_DEDUP_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
w AS (SELECT *, len({_WORDS_SQL.format(x='content')}) AS words FROM l),
b AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY line) - words AS before FROM w WHERE words > 0),
e AS (SELECT *, before + words AS after FROM b),
s AS (SELECT doc_id, list(content) OVER r AS held, list(line) OVER r AS places, list(words) OVER r AS sizes FROM e WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
 UNION SELECT doc_id, list(content) OVER r, list(line) OVER r, list(words) OVER r FROM e WINDOW r AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
f AS (SELECT doc_id, places[1] AS line, places[-1] AS last, places, array_to_string(held, chr(10)) AS held FROM s WHERE list_sum(sizes) >= 50),
k AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY doc_id, line) AS rn, first_value(doc_id) OVER (PARTITION BY held ORDER BY doc_id, line) AS fd, first_value(last) OVER (PARTITION BY held ORDER BY doc_id, line) AS fl FROM f),
m AS (SELECT DISTINCT doc_id, p AS line FROM (SELECT doc_id, fd, fl, unnest(places) AS p FROM k WHERE rn > 1) WHERE doc_id <> fd OR p > fl),
c AS (SELECT w.*, m.line IS NOT NULL AS gone FROM w LEFT JOIN m USING (doc_id, line)),
t AS (SELECT doc_id, coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (NOT gone), '') AS text, count(*) AS n, count(*) FILTER (gone) AS n_removed_lines, coalesce(sum(words) FILTER (gone), 0) AS n_removed_words FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, d.text) AS text, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE t.n END AS n_lines, coalesce(n_removed_lines, 0) AS n_removed_lines, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words FROM documents d LEFT JOIN t USING (doc_id)"""

_QUALITY_SQL = rf"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, {_WORDS_SQL.format(x='text')} AS w FROM d),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
v AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, host, x, len({_WORDS_SQL.format(x='x')}) AS n FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS x FROM d)),
own AS (SELECT * FROM l WHERE n > 0),
u AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM own GROUP BY doc_id),
h AS (SELECT doc_id, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h, sum(n) AS n FROM own GROUP BY ALL),
lim AS (SELECT host, count(*) * CAST(0.01 AS DOUBLE) AS most FROM d GROUP BY host),
com AS (SELECT host, h FROM (SELECT host, h, count(*) AS docs FROM h GROUP BY ALL) JOIN lim USING (host) WHERE docs > 4 AND docs > most),
rem AS (SELECT doc_id, sum(n) AS removed FROM h JOIN com USING (host, h) GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed FROM w LEFT JOIN u USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN rem USING (doc_id)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed >= 50 AND n_words - removed >= 0.5 * n_words AS kept FROM j"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _repair_sql() -> str:
    """From each conversation's last row back, the cheapest (cost, audit, repaired rows) from each state of the grammar."""
    least = lambda *options: f"list_sort([{', '.join(options)}])[1]"
    edit = lambda cost, letter, to, line="": f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'r': {f'list_prepend({line}, {to}.r)' if line else to + '.r'}}}"
    legal = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    before = []
    for s in range(4):
        to = 3 if s == 2 else 2
        role = "assistant" if s == 2 else "user"
        options = [edit("3", "D", f"s{s}"), edit("2 + late + never", "R", f"s{to}", f"'{role}:' || text")]
        options += [edit(f"late + never + CASE WHEN initial = '{x}' THEN 0 ELSE 1000000000 END", "K", f"s{n}", "role || ':' || text") for x, n in legal[s].items()]
        before.append(f"{least(*options)} AS b{s}")
    insert = lambda to, role: edit("2", "I", to, f"'{role}:'")
    middle = f"b0, b1, {least('b2', insert('b3', 'assistant'))} AS s2, {least('b3', insert('b2', 'user'))} AS s3"
    end = lambda c, a, *r: f"{{'c': {c}, 'a': '{a}', 'r': {list(r)}::VARCHAR[]}}"
    return rf"""WITH RECURSIVE m AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a >> 8, (CAST({_crc_table()} AS BIGINT[]))[CAST((xor(a, b) & 255) + 1 AS BIGINT)])), 4294967295) % 20 AS kind FROM m),
d AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
x AS (SELECT *, lag(initial) OVER (PARTITION BY g ORDER BY i) || initial AS two, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 ELSE 0 END AS never, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM f),
n AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY g),
z AS (SELECT g, n AS i, {end(0, "")} AS s0, {end(4, "II", "user:", "assistant:")} AS s1, {end(2, "I", "assistant:")} AS s2, {end(0, "")} AS s3 FROM n UNION ALL
 SELECT g, i - 1, {least("b0", insert("s2", "user"))}, {least("b1", insert("s2", "user"))}, s2, s3 FROM (SELECT g, i, {middle} FROM (SELECT z.g, z.i, {", ".join(before)} FROM z JOIN x ON x.g = z.g AND x.i = z.i)))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(s0.c, 0) AS BIGINT) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM m) LEFT JOIN n USING (g) LEFT JOIN (SELECT g, s0 FROM z WHERE i = 0) USING (g)"""


_FINITE_SQL = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_NEAR_VECTORS_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE {_FINITE_SQL} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM n UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id),
g AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), l AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN g USING (vec_id) LEFT JOIN l USING (vec_id)"""

_HARD_NEGATIVES_SQL = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE label IS NOT NULL AND {_FINITE_SQL}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
q AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
 FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM q WHERE rank <= 5"""
