"""URL filtering by association rules that Spark's FP-growth mines from labelled URLs.

A URL becomes a basket of tokens (host suffixes, host labels, path segments, extension, query
keys; digits in a token count as one class). Labelled baskets also hold their label; FP-growth
finds the frequent ones, and rules ``tokens -> label`` of any length stay if their confidence
reaches ``min_confidence``, their support ``min_support``, and no rule of one token less for the
same label is as confident. Each distinct token set is matched once, through an inverted index:
it meets the rules filed under one of its tokens (each rule is filed under the one that names the
fewest rules), and a rule fits when the set has all its tokens. The most confident fitting rule
decides (then support, then the longer, then its text); a URL that fits none is allowed.

Size of the index: a basket of b tokens has 2^b token sets, and each frequent one takes a share
``min_support`` of the baskets, so the rules number at most that over ``min_support``, whatever
the number of URLs. They, and the deciding rules by token set, are broadcast only when their count
is within ``broadcast_rules``; beyond it Spark joins them by shuffle.

Hand-made host and path rules come first: the longest that fits the host (or a parent domain) and
starts the path. Defined results: a null URL, or one without ``://``, has empty host and path, so
no hand-made rule fits; a null one has no tokens and is allowed. Repeated rows are each judged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import stored

ALLOW, BLOCK = "allow", "block"
_LABEL = "label="


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host: after the first ``://`` up to ``/ ? #``, ASCII-lower-cased; path: then up to ``? #``."""
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def url_tokens(url: str = "url") -> F.Column:
    """The distinct tokens of a URL, each prefixed by its kind."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\?([^#]*)", 1)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.when(F.size(labels) > 0, F.sequence(F.lit(1), F.size(labels))).otherwise(
        F.array().cast("array<int>")), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(labels, lambda x: F.concat(F.lit("name:"), x))
    digits = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), digits(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    ends = F.when(ending != "", F.array(F.concat(F.lit("ext:"), F.lower(ending)))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                       lambda x: F.concat(F.lit("key:"), digits(F.substring_index(x, "=", 1))))
    return F.array_distinct(F.concat(suffixes, parts, segments, ends, keys))


def mine_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6,
               url: str = "url", label: str = "label") -> DataFrame:
    """Pruned rules (``rule_id``, ``tokens``, ``verdict``, ``confidence``, ``support``) from rows
    of a URL and its label (``allow`` or ``block``; rows with null label are left out)."""
    none = "rule_id string, tokens array<string>, verdict string, confidence double, support double"
    baskets = (labelled.where(F.col(label).isNotNull() & F.col(url).isNotNull())
               .select(F.array_append(url_tokens(url), F.concat(F.lit(_LABEL), F.col(label))).alias("items")))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], none)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules
             .where(F.startswith(F.col("consequent")[0], F.lit(_LABEL))
                    & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(_LABEL))))
             .select(F.sort_array("antecedent").alias("tokens"),
                     F.expr(f"substr(consequent[0], {len(_LABEL) + 1})").alias("verdict"), "confidence", "support")
             .withColumn("rule_id", F.concat_ws(" ", "verdict", F.array_join("tokens", " "))))
    rules = stored(rules, "url-rules")  # read more than once: mined once
    # a rule goes if a rule of fewer of its tokens says the same as confidently: looked up by sub-set
    subsets = (rules.select("rule_id", "verdict", "confidence", "tokens",
                            F.explode("tokens").alias("left_out"))
               .withColumn("tokens", F.array_except("tokens", F.array("left_out"))))
    shorter = rules.select("tokens", "verdict", F.col("confidence").alias("shorter_confidence"))
    beaten = (subsets.join(shorter, ["tokens", "verdict"])
              .where(F.col("shorter_confidence") >= F.col("confidence")).select("rule_id").distinct())
    return rules.join(beaten, "rule_id", "left_anti").select("rule_id", "tokens", "verdict", "confidence", "support")


def judge_urls(pages: DataFrame, rules: DataFrame, host_rules: tuple[HostRule, ...] = (),
               key: str = "page_id", url: str = "url", broadcast_rules: int = 100_000) -> DataFrame:
    """Per row of ``pages``: ``key``, host, path, ``rule`` (the hand-made one, or null),
    ``mined_rule`` (the deciding mined one, or null) and ``verdict``."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    hand = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(host_rules, key=lambda r: (len(r.text), r.text)):  # the longest is tested first
        fits = ((F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))) \
            & F.startswith(F.col("path"), F.lit(r.path))
        hand = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(hand)
    rows = rows.withColumn("hand", hand)

    # the inverted index: token -> the rules filed under it
    named = rules.select(F.explode("tokens").alias("token"), "rule_id")
    filed = (named.join(named.groupBy("token").count(), "token")
             .groupBy("rule_id").agg(F.min(F.struct("count", "token"))["token"].alias("token")))
    index = rules.join(filed, "rule_id").withColumnRenamed("tokens", "needed")
    if rules.count() <= broadcast_rules:
        index = F.broadcast(index)
    sets = rows.select(F.array_sort(url_tokens("url")).alias("tokens")).distinct()
    met = (sets.select("tokens", _set_key("tokens").alias("set"), F.explode("tokens").alias("token")).join(index, "token")
           .where(F.size(F.array_except("needed", "tokens")) == 0))
    best = stored(met.groupBy("set").agg(F.max(F.struct(
        "confidence", "support", F.size("needed").alias("needs"), "rule_id", "verdict")).alias("best"))
        .select("set", "best.rule_id", "best.verdict"), "url-sets")
    if best.count() <= broadcast_rules:
        best = F.broadcast(best)
    return (rows.withColumn("set", _set_key(F.array_sort(url_tokens("url")))).join(best, "set", "left")
            .select(F.col("key").alias(key), "host", "path", F.col("hand.text").alias("rule"),
                    F.col("rule_id").alias("mined_rule"),
                    F.coalesce(F.col("hand.verdict"), F.col("verdict"), F.lit(ALLOW)).alias("verdict")))


def _set_key(tokens: F.Column | str) -> F.Column:
    """A sorted token set in 128 bits."""
    return F.md5(F.to_json(tokens))
