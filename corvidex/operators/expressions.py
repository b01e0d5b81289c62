"""Boolean search expressions: AND, OR, NOT, phrases, prefixes, columns and parentheses, ranked by BM25.

An expression is read once, by a small function over the rows of queries, into
its leaves (words, whether the last one is a prefix, allowed columns) and a
postfix program over their numbers. Leaves of all queries meet the postings
together: equal leaves once, words by an equality join, prefixes by the distinct
terms they begin. Each chunk then has the numbers of the leaves it holds, and the
program runs over them as set algebra, in built-in functions: a step's value is
the set of leaves that count, empty where the step doesn't hold. A leaf counts for
the score where all steps above it hold, and never on the right of NOT.

The grammar is that of the full-text index the stored chunks have:

* ``word``, ``wor*``, ``"a phrase"``, ``"a phra" *``, ``one + two`` (a phrase of both);
* ``column : x`` and ``{a b} : x`` or ``- column : x`` before a phrase or a parenthesis, inner columns within outer ones;
* ``NOT`` binds before ``AND``, that before ``OR``; phrases side by side are joined before all of them.

A word or phrase without a letter or number matches nothing, and is passed over
where it stands side by side with others. What can't be read has an error, and
no hits. Not read: NEAR and ``^``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvidex.functions import text as tx
from corvidex.operators.search import BROADCAST_TERMS, FEW, FEW_STARTS, KEY, WEIGHTS, Index, SearchParams, bm25, by_chunk, prefix_terms, restrict, with_words

AND, OR, NOT, BESIDE = -1, -2, -3, -4
TOLD = 8  # leaves of an expression up to which its program runs beforehand, for every set of them

_TOKEN = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<word>[\w\x1a]+)|(?P<sign>[(){}:*+-]))')
_READ = "struct<error: string, leaves: array<struct<text: string, prefix: boolean, columns: array<string>>>, program: array<int>>"


@dataclass
class _Reader:
    """Leaves and program of one expression."""

    text: str
    columns: Sequence[str]
    tokens: list[tuple[str, str]] = field(default_factory=list)
    leaves: list[tuple[str, bool, list[str]]] = field(default_factory=list)
    program: list[int] = field(default_factory=list)
    at: int = 0

    def read(self) -> None:
        end = 0
        rest = self.text.rstrip()
        while end < len(rest):
            if not (m := _TOKEN.match(rest, end)):
                raise ValueError(f"unexpected {rest[end:].lstrip()[:1]!r}")
            kind = m.lastgroup
            self.tokens.append((m[kind] if m[kind] in ("AND", "OR", "NOT") and kind == "word" else kind if kind != "sign" else m[kind], m[kind]))
            end = m.end()
        if self.tokens:
            self._binary(list(self.columns), 0)
            if self.at < len(self.tokens):
                raise ValueError(f"unexpected {self.tokens[self.at][1]!r}")

    def _next(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def _take(self, kind: str) -> str:
        if self._next() != kind:
            raise ValueError(f"expected {kind!r}, not {self._next() or 'the end'!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    _LEVELS = (("OR", OR), ("AND", AND), ("NOT", NOT))

    def _binary(self, allowed: list[str], level: int) -> None:
        if level == len(self._LEVELS):
            self._beside(allowed)
            return
        word, step = self._LEVELS[level]
        self._binary(allowed, level + 1)
        while self._next() == word:
            self.at += 1
            self._binary(allowed, level + 1)
            self.program.append(step)

    def _beside(self, allowed: list[str]) -> None:
        """Phrases side by side; a parenthesis has to be joined by a word."""
        if self._group(allowed):
            return
        self._phrase(allowed)
        while self._next() in ("quoted", "word", "{", "-"):
            if self._is_group():
                break
            self._phrase(allowed)
            self.program.append(BESIDE)

    def _is_group(self) -> bool:
        held = self.at
        try:
            self._filter([])
            return self._next() == "("
        except ValueError:
            return False
        finally:
            self.at = held

    def _group(self, allowed: list[str]) -> bool:
        if not self._is_group():
            return False
        allowed = self._filter(allowed)
        self._take("(")
        self._binary(allowed, 0)
        self._take(")")
        return True

    def _filter(self, allowed: list[str]) -> list[str]:
        """The allowed columns behind any column filters at this place."""
        while True:
            sign = self._next() == "-"
            if self._next(sign) == "{":
                self.at += sign + 1
                named = []
                while self._next() != "}":
                    named.append(self._take("quoted" if self._next() == "quoted" else "word"))
                self.at += 1
            elif self._next(sign) in ("word", "quoted") and self._next(sign + 1) == ":":
                named = [self.tokens[self.at + sign][1]]
                self.at += sign + 1
            elif sign:
                raise ValueError("expected a column behind '-'")
            else:
                return allowed
            self._take(":")
            named = [n.strip('"').lower() for n in named]
            if unknown := [n for n in named if n not in self.columns]:
                raise ValueError(f"no column {unknown[0]}")
            allowed = [c for c in allowed if (c in named) != sign]

    def _phrase(self, allowed: list[str]) -> None:
        allowed, parts, prefix = self._filter(allowed), [], False
        while True:
            kind = self._next()
            word = self._take("quoted" if kind == "quoted" else "word")
            parts.append(word[1:-1].replace('""', '"') if kind == "quoted" else word)
            if prefix := self._next() == "*":
                self.at += 1
            if self._next() != "+":
                break
            if prefix:
                raise ValueError("'*' inside a phrase")
            self.at += 1
        self.program.append(len(self.leaves))
        self.leaves.append((" ".join(parts), prefix, list(allowed)))


def read_expression(text: str | None, columns: Sequence[str] = tuple(WEIGHTS)) -> tuple[str | None, list, list]:
    """(error, leaves, program) of an expression; an empty one has no leaves."""
    reader = _Reader(text or "", columns)
    try:
        reader.read()
    except ValueError as e:
        return str(e), [], []
    return None, reader.leaves, reader.program


def parse(queries: DataFrame) -> DataFrame:
    """(qid, error, leaves, program) of ``queries`` (qid, query); qid is unique."""
    read = F.udf(read_expression, _READ, useArrow=True)
    return queries.select("qid", F.explode(F.array(read("query"))).alias("x")).select("qid", "x.*")


def _leaves(parsed: DataFrame) -> DataFrame:
    """(qid, leaf, q, words, is_prefix, columns): q names equal leaves of all queries."""
    each = parsed.select("qid", F.posexplode("leaves").alias("leaf", "x"))
    each = each.select("qid", "leaf", tx.index_tokens(F.col("x.text")).alias("words"), F.col("x.prefix").alias("is_prefix"), F.col("x.columns").alias("columns"))
    return each.withColumn("q", F.concat_ws("\n", F.concat_ws(" ", "words"), F.col("is_prefix").cast("string"), F.concat_ws(" ", "columns")))


def _match(held: Index, leaves: DataFrame, params: SearchParams, sent: bool) -> DataFrame:
    """(q, is_prefix, document_id, chunk_no, n_terms, f) of each distinct leaf, whose q tells prefixes too; f is the weighted number of its places. Leaves are ``sent`` to every task if they are few."""
    units = leaves.where(F.size("words") > 0).select("q", "words", "is_prefix", "columns").distinct()
    word = units.select("q", "is_prefix", "columns", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))
    word = word.withColumn("begins", F.col("is_prefix") & (F.col("at") == F.col("size") - 1)).drop("is_prefix")
    # Few queries filter the postings where they are scanned.
    few = word.select("word", "begins").distinct().limit(FEW + 1).collect()
    many, starts = len(few) > FEW, [x.word for x in few if x.begins]
    posts = held.postings if many or len(starts) > FEW_STARTS else restrict(held.postings, [tuple(x) for x in few])
    # Places of a word are dealt once, and meet the leaves that have it where they arrive.
    single = word.select("word", "begins").distinct()
    if (many or len(starts) > FEW_STARTS) and (held.terms is not None or not sent):
        # A written index is read by whole terms; heads of words that are dealt would bring too many places together.
        begun = prefix_terms(posts if held.terms is None else held.terms, single.where("begins").select(F.col("word").alias("start"))).select(F.col("start").alias("word"), F.lit(True).alias("begins"), "term")
        known = single.where("NOT begins").withColumn("term", F.col("word")).unionByName(begun)
        places = posts.join(known, "term")
    else:
        places = with_words(posts, single, bool(starts), sent)
    places = places.select("word", "begins", *KEY, "n_terms", "col", "pos")
    places = by_chunk(places, posts).join(F.broadcast(word), ["word", "begins"]) if sent else by_chunk(places.join(word, ["word", "begins"]), posts)
    places = places.where(F.array_contains("columns", F.col("col"))).withColumn("start", F.col("pos") - F.col("at"))
    # A phrase stands where all its words do, one after another in one column; a word is a phrase of one.
    found = places.groupBy("q", *KEY, "n_terms", "col", "size", "start").agg(F.count("*").alias("n")).where("n = size")
    table = F.create_map(*[x for c in WEIGHTS for x in (F.lit(c), F.lit(float(params.weight(c))))])
    return found.groupBy("q", *KEY, "n_terms").agg(F.sum(F.element_at(table, F.col("col"))).alias("f")).withColumn("is_prefix", F.lit(False))


def counting(program: Column, absent: Column, held: Column) -> Column:
    """The leaves of ``held`` that count for the score; empty where the expression doesn't hold.

    ``absent`` are the numbers of leaves without words.
    """
    none = F.array().cast("array<int>")
    stack = F.array().cast("array<array<int>>")

    def step(s: Column, x: Column) -> Column:
        n = F.size(s)
        a, b = F.get(s, n - 2), F.get(s, n - 1)
        below = F.slice(s, 1, F.greatest(n - 2, F.lit(0)))
        left, right = F.coalesce(a, none), F.coalesce(b, none)
        both = F.when((F.size(left) > 0) & (F.size(right) > 0), F.concat(left, right)).otherwise(none)
        value = (
            F.when(x == AND, both)
            .when(x == OR, F.concat(left, right))
            .when(x == NOT, F.when(F.size(right) == 0, left).otherwise(none))
            .otherwise(F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both))
        )
        leaf = F.when(F.array_contains(absent, x), F.lit(None).cast("array<int>")).when(F.array_contains(held, x), F.array(x)).otherwise(none)
        return F.when(x >= 0, F.array_append(s, leaf)).otherwise(F.array_append(below, value))

    return F.coalesce(F.get(F.aggregate(program, stack, step), F.lit(0)), none)


def evaluate(held: Index, parsed: DataFrame, params: SearchParams = SearchParams(), places: int = 12) -> DataFrame:
    """(qid, document_id, chunk_no, rank) of the chunks for which each parsed expression holds; rank as of ``search.scores``, rounded once, to ``places``."""
    leaves = _leaves(parsed)
    few = leaves.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    if few:
        # Places carry a number, not the text of their leaf.
        numbers = leaves.select("q").distinct().select("q", F.row_number().over(Window.orderBy("q")).alias("no"))
        leaves = leaves.join(F.broadcast(numbers), "q").drop("q").withColumnRenamed("no", "q")
    sent = F.broadcast if few else lambda x: x
    wanted = leaves.select("qid", "leaf", "q")
    each = bm25(_match(held, leaves, params, few), held.corpus, params, few).select("q", *KEY, "part")
    absent = leaves.groupBy("qid").agg(F.collect_list(F.when(F.size("words") == 0, F.col("leaf"))).alias("absent"))
    programs = parsed.select("qid", "program", F.size("leaves").alias("n")).join(absent, "qid")
    most = parsed.agg(F.max(F.size("leaves"))).first()[0] or 0
    # The program of an expression of few leaves runs once for each set of them, not for each chunk, whose parts stay in columns.
    told = programs.where(F.col("n").between(1, TOLD)).withColumn("mask", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.col("n")) - 1)))
    holds = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.call_function("getbit", F.col("mask"), i) == 1)
    told = told.select("qid", "mask", counting(F.col("program"), F.col("absent"), holds).alias("counts")).where(F.size("counts") > 0)
    at = range(min(most, TOLD))
    told = told.select("qid", "mask", *[F.array_contains("counts", i).alias(f"counts{i}") for i in at])
    short = wanted.join(programs.where(F.col("n") <= TOLD).select("qid"), "qid", "left_semi") if most > TOLD else wanted
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("leaf"))).alias("mask")
    # A chunk has a leaf once, so a sum is its part.
    met = each.join(sent(short), "q").groupBy("qid", *KEY).agg(mask, *[F.sum(F.when(F.col("leaf") == i, F.col("part"))).alias(f"part{i}") for i in at])
    total = reduce(add, [F.when(F.col(f"counts{i}"), F.col(f"part{i}")).otherwise(0.0) for i in at], F.lit(0.0))
    run = met.join(sent(told), ["qid", "mask"]).select("qid", *KEY, total.alias("total"))
    if most > TOLD:
        long = programs.where(F.col("n") > TOLD).drop("n")
        met = each.join(sent(wanted.join(long.select("qid"), "qid", "left_semi")), "q").groupBy("qid", *KEY).agg(F.map_from_entries(F.collect_list(F.struct("leaf", "part"))).alias("parts"))
        counts = met.join(sent(long), "qid").withColumn("counts", counting(F.col("program"), F.col("absent"), F.map_keys("parts"))).where(F.size("counts") > 0)
        total = F.aggregate("counts", F.lit(0.0), lambda s, x: s + F.element_at("parts", x))
        run = run.unionByName(counts.select("qid", *KEY, total.alias("total")))
    return run.select("qid", *KEY, F.round(-F.col("total"), places).alias("rank"))


def search_expressions(held: Index, queries: DataFrame, params: SearchParams = SearchParams(), places: int = 12) -> DataFrame:
    """``evaluate`` for ``queries`` (qid, query)."""
    return evaluate(held, parse(queries), params, places)


def errors(queries: DataFrame) -> DataFrame:
    """(qid, error) of the expressions that can't be read."""
    return parse(queries).where("error IS NOT NULL").select("qid", "error")
