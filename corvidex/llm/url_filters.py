"""URL filters: given host and path rules, then association rules mined by FP-growth.

A url's tokens are its host's labels and the alphanumeric runs of its path and
of what follows. Spark's FP-growth finds token combinations in labelled pages;
those that imply the label ``block`` with enough support and confidence become
rules. Rules are indexed by their rarest token: a page meets a rule's index
entry by that token alone, and the rule's other tokens are then looked up in the
page's own. Pages that a given rule fits take that rule's verdict (the longest
rule wins); the others are blocked if a mined rule fits, else allowed.

A page's label is that of the document it shows, whose number is the last part
of the url's path; page ids number pages, not documents.

Defined cases: a null url, or one without ``://``, has an empty host and path
and no tokens, and is allowed unless a given rule fits; pages without a label,
or whose path ends in no number, are not mined; of a document's repeated labels
the worst counts; without labelled
pages nothing is mined; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from corvidex.llm._session import cut

# The given rules.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

_LABEL = "label=block"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


@dataclass(frozen=True)
class UrlFilterParams:
    min_pages: int = 20  # least support, as labelled pages with all tokens and the label
    min_support: float = 0.0005  # least support, as a share of labelled pages
    min_confidence: float = 0.5


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def document(of_path: Column) -> Column:
    """The number that ends the path, before any suffix, else null."""
    return F.regexp_extract(of_path, r"/([0-9]+)(\.[A-Za-z]+)?/*$", 1).try_cast("long")


def tokens(url: Column) -> Column:
    def parts(x: Column, by: str, kind: str) -> Column:
        return F.transform(F.filter(F.split(x, by, -1), lambda t: t != ""), lambda t: F.concat(F.lit(f"{kind}="), t))

    rest = F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))
    word = r"[^\p{L}\p{N}_-]+"
    return F.array_distinct(F.concat(parts(host(url), r"\.", "host"), parts(F.lower(path(url)), word, "path"), parts(F.lower(rest), word, "rest")))


def given_rule(rules: Mapping[str, str], of_host: Column, of_path: Column) -> Column:
    """The longest rule whose host (or a parent domain) and path start fit, else null; rules are a short list in the code."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        domain, slash, start = rule.partition("/")
        fits = ((of_host == domain) | of_host.endswith(f".{domain}")) & of_path.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def mine(pages: DataFrame, labels: DataFrame, params: UrlFilterParams) -> DataFrame:
    """(antecedent, confidence, support) of rules that imply ``block``; ``pages`` has path and tokens."""
    bad = F.max((F.coalesce("toxic", F.lit(0)) > 0) | (F.coalesce("quality", F.lit(1)) == 0))
    marked = labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy("doc_id").agg(bad.alias("bad"))
    labelled = pages.join(marked, document(F.col("path")) == F.col("doc_id")).select(F.when(F.col("bad"), F.array_append("tokens", F.lit(_LABEL))).otherwise(F.col("tokens")).alias("items"))
    labelled = cut(labelled)
    n = labelled.count()
    support = min(1.0, max(params.min_support, params.min_pages / max(n, 1)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=params.min_confidence).fit(labelled)
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(_LABEL))).select("antecedent", "confidence", "support")


def judge(pages: DataFrame, labels: DataFrame, rules: Mapping[str, str] = RULES, params: UrlFilterParams = UrlFilterParams()) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_confidence) of each row of ``pages``."""
    url = F.col("url")
    read = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    read = cut(read.withColumn("rule", given_rule(rules, F.col("host"), F.col("path"))))
    mined = cut(mine(read, labels, params))
    each = read.select("row", F.explode("tokens").alias("token"), "tokens")
    wanted = mined.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    # How often each token of a rule occurs in all pages decides by which one the rule is indexed.
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    index = wanted.join(counts, "token").groupBy("antecedent", "confidence").agg(F.min(F.struct("n", "token")).alias("x")).select("antecedent", "confidence", F.col("x.token").alias("token"))
    index = cut(index)  # so that a token of very many pages can be split over tasks in the join
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    hits = each.join(index, "token").where(fits).groupBy("row").agg(F.max("confidence").alias("mined_confidence"))
    given = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule")) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(given, F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow"))
    return read.join(hits, "row", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("mined_confidence", 6).alias("mined_confidence"))
