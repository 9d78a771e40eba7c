"""URL filter: list rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host with a path prefix; it fits that host and all its subdomains if the path begins with the
prefix, and the longest rule that fits wins. URLs that a rule decides are labelled by it; at most
``TRAINING_ROWS`` distinct ones, weighted by how often they occur (half for each label, those with the smallest
hash, so a fixed set for fixed data), train the trees, whose verdict covers every URL that no rule fits. With labelled URLs of one class only, that class is the verdict; with
none, ``allow``.

Features: length, path depth, digit and letter ratios, character entropy, parameter count, label count and
longest label of the host, hyphens, scheme, and how often the suffix of the host, alone and with the first part
of the path, was blocked among the training rows, shrunk towards the overall rate.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule and the trees' verdict; a
port or user name is part of the host; repeated URLs get equal verdicts; nulls in other columns do not matter and
only page_id and url are read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import ascii_lower, durable, let

#: (action, rule); a rule is a host and a path prefix that begins with its first slash
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
TRAINING_ROWS = 20_000
TREES, DEPTH = 12, 4
FEATURES = (
    "length", "depth", "digit_ratio", "letter_ratio", "entropy", "parameters", "host_labels", "longest_label",
    "hyphens", "secure", "last_segment", "suffix_rate", "section_rate",
)
#: pseudo-count with which a suffix's rate is drawn to the overall rate
SUFFIX_WEIGHT = 20.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part behind the first ``://`` up to ``/ ? #``, A-Z lower-cased, and from there up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, action); null if none does."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def bits(cs: Column) -> Column:
        share = lambda c: F.size(F.filter(cs, lambda d: d == c)) / F.size(cs)
        return F.aggregate(F.array_distinct(cs), F.lit(0.0), lambda a, c: let(share(c), lambda p: a - p * F.log2(p)))

    return let(letters, bits)


def lexical(urls: DataFrame, *more: Column) -> DataFrame:
    """``urls`` (page_id, url) with host, path, ``suffix``, ``section``, all features but suffix_rate and ``more``."""
    host, path = host_and_path(F.col("url"))
    named = urls.select(*more, "page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    size = F.greatest(F.length("url"), F.lit(1))
    count = lambda pattern: F.regexp_count("url", F.lit(pattern))
    labels = F.split("host", r"\.")
    suffix = F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1)
    kept = [c for c in named.columns if c != "url"]
    return named.select(
        *kept,
        suffix.alias("suffix"), F.concat(suffix, F.regexp_extract("path", "^(/[^/]*/?)", 1)).alias("section"),
        F.length("url").cast("double").alias("length"),
        F.regexp_count("path", F.lit("/[^/]")).cast("double").alias("depth"),
        (count("[0-9]") / size).alias("digit_ratio"), (count("[A-Za-z]") / size).alias("letter_ratio"),
        entropy(F.col("url")).alias("entropy"),
        count("[?&][^=&#]+=").cast("double").alias("parameters"),
        F.size(labels).cast("double").alias("host_labels"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"),
        count("-").cast("double").alias("hyphens"),
        F.startswith("url", F.lit("https:")).cast("double").alias("secure"),
        F.length(F.regexp_extract("path", "([^/]*)/?$", 1)).cast("double").alias("last_segment"),
    )


def _rates(training: DataFrame, of: str, overall: float) -> DataFrame:
    shrunk = (F.sum(F.col("label") * F.col("weight")) + SUFFIX_WEIGHT * overall) / (F.sum("weight") + SUFFIX_WEIGHT)
    return durable(training.groupBy(of).agg(shrunk.alias(f"{of}_rate")))  # at most as many rows as were drawn


class UrlModel:
    """Trees and suffix rates learned from labelled URLs (columns page_id, url, label: 1 to block, 0 to allow)."""

    def __init__(self, labelled: DataFrame, rows: int = TRAINING_ROWS):
        known = labelled.where(F.col("label").isNotNull())
        # distinct URLs with their number as weight, half of the bound for each label: no URL or label fills the sample
        distinct = known.groupBy("url", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.min("page_id").alias("page_id"))
        drawn = [distinct.where(F.col("label") == v).orderBy(F.xxhash64("url"), "url").limit(rows // 2) for v in (0, 1)]
        both = drawn[0].union(drawn[1])
        training = durable(lexical(both, F.col("label").cast("double").alias("label"), F.col("weight")).coalesce(4))
        seen = training.agg((F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).alias("rate")).first()
        self.rate, self.model = seen["rate"] or 0.0, None
        if 0.0 < self.rate < 1.0:
            self.rates = [_rates(training, of, self.rate) for of in ("suffix", "section")]
            assembled = self._assembled(training).select("features", "label", "weight")
            self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, checkpointInterval=-1, weightCol="weight").fit(assembled)

    def _assembled(self, features: DataFrame) -> DataFrame:
        rated = features
        for rates in self.rates:
            rated = rated.join(F.broadcast(rates), rates.columns[0], "left").fillna(self.rate, rates.columns[1:])
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rated)

    def blocked(self, features: DataFrame) -> DataFrame:
        """``features`` (as ``lexical`` gives them) with ``blocked``."""
        if self.model is None:
            return features.withColumn("blocked", F.lit(self.rate >= 0.5))
        return self.model.transform(self._assembled(features)).withColumn("blocked", F.col("prediction") == 1.0)


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every URL; without ``labelled``, URLs that rules decide teach."""
    urls = pages.select("page_id", "url")
    if labelled is None:
        host, path = host_and_path(F.col("url"))
        decided = urls.withColumn("found", longest_rule(host, path, rules)).where(F.col("found").isNotNull())
        labelled = decided.select("page_id", "url", (F.col("found.action") == "block").cast("int").alias("label"))
    scored = UrlModel(labelled).blocked(lexical(urls))
    found = longest_rule(F.col("host"), F.col("path"), rules)
    scored = scored.withColumn("found", found)
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", method).alias("verdict")
    )
