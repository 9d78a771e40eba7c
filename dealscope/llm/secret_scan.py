"""Secret scan: a pattern proposes candidates, a random forest removes the false positives.

A candidate is a run of 16 or more of ``[A-Za-z0-9+/_-]``. Its features are its length, how often the character
class changes, digit and upper-case shares, character entropy, dictionary coverage (the share of its letter
trigrams that are among the ``DICTIONARY`` most frequent of the corpus' own words), the path it was found
in, and the words and signs on both sides of it. The forest is trained on distinct labelled findings, weighted by how
often they occur, at most ``TRAINING_ROWS`` of them, half for each label, those with the smallest hash.

Where no labels are given, findings are labelled by rules of high precision: a known key format or a value
assigned to a name that tells of a secret is one; a capitalised or lower-case word, or a run of digits, with no such
name before it is none. The others are not used to train, and the forest decides on all.

Defined cases: a null or empty text has no candidate, a null path tells nothing; repeated rows give their
findings each; equal candidates get the verdict of their own surroundings; very long runs are one candidate.
Without labelled findings of both kinds nothing is removed. Only doc_id, text and the path column are read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import durable, located
from dealscope.llm.url_filter import entropy

_CHARS = "[A-Za-z0-9+/_-]"
CANDIDATE = rf"(?<!{_CHARS}){_CHARS}{{16,}}+"
TRAINING_ROWS = 20_000
TREES, DEPTH = 20, 6
#: most frequent letter trigrams that count as dictionary
DICTIONARY = 1_000
NEAR = 24
#: fixed values: names that tell of a secret, known formats, paths of examples
NAMES = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
ASSIGNED = rf"{NAMES}[\"']?\s*[=:]\s*[\"']?\z"
FORMATS = r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,})$"
EXAMPLE_PATH = r"(?i)test|example|fixture|sample|doc"
FEATURES = (
    "length", "transitions", "digit_share", "upper_share", "entropy", "coverage", "path_depth", "path_example",
    "named", "assigned", "quoted", "named_after",
)


def common_trigrams(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent letter trigrams of all words of the corpus; at most 26 ** 3 are counted."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,15}"), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    cut = F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))
    trigrams = counted.select(F.explode(cut).alias("g"), "n").groupBy("g").agg(F.sum("n").alias("n"))
    return sorted(r["g"] for r in trigrams.orderBy(F.desc("n"), "g").limit(size).collect())


def candidates(docs: DataFrame, trigrams: list[str], path: str = "source") -> DataFrame:
    """doc_id, start, end, value, ``before`` and the features of every candidate."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    rows = texts.select("doc_id", "path", "text", F.explode(located(F.col("text"), CANDIDATE, lambda m: F.lit(True))).alias("c"))
    rows = rows.select(
        "doc_id", "path", F.col("c.start").alias("start"), (F.col("c.start") + F.length("c.match")).alias("end"),
        F.col("c.match").alias("value"), F.substring("c.before", -NEAR, NEAR).alias("before"),
        F.substring("c.after", 1, NEAR).alias("after"),
    )
    size = F.length("value")
    count = lambda pattern: F.regexp_count("value", F.lit(pattern))
    changes = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_-])(?=[^+/_-])"
    letters = F.lower("value")
    pieces = F.transform(F.sequence(F.lit(1), size - 2), lambda i: F.substring(letters, i, F.lit(3)))
    known = F.size(F.filter(pieces, lambda g: g.isin(trigrams))) if trigrams else F.lit(0)
    flag = lambda column, pattern: column.rlike(pattern).cast("double")
    return rows.select(
        "doc_id", "start", "end", "value", "before", "after",
        size.cast("double").alias("length"),
        (count(changes) / size).alias("transitions"),
        (count("[0-9]") / size).alias("digit_share"), (count("[A-Z]") / size).alias("upper_share"),
        entropy(F.col("value")).alias("entropy"),
        (known / size).alias("coverage"),
        F.regexp_count("path", F.lit("/")).cast("double").alias("path_depth"),
        flag(F.col("path"), EXAMPLE_PATH).alias("path_example"),
        flag(F.col("before"), NAMES).alias("named"), flag(F.col("before"), r"[=:]\s*[\"']?\z").alias("assigned"),
        flag(F.col("before"), r"[\"']\z").alias("quoted"), flag(F.col("after"), NAMES).alias("named_after"),
    )


def rule_label() -> Column:
    """1, 0 or null: what the rules of high precision say of a candidate."""
    sure = F.col("value").rlike(FORMATS) | F.col("before").rlike(ASSIGNED)
    word = F.col("value").rlike("^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$") & ~F.col("before").rlike(NAMES)
    return F.when(sure, 1).when(word, 0)


def train(labelled: DataFrame, rows: int = TRAINING_ROWS):
    """The forest on candidates with a ``label``, or None if only one label occurs."""
    known = labelled.where(F.col("label").isNotNull())
    # distinct findings with their number as weight, so that a repeated one does not fill the sample
    distinct = known.groupBy("label", "value", "before", "after", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    # half of the bound for each label, so that the rarer one is not lost
    order = [F.xxhash64("value", "before", "after"), "value", "before", "after", *FEATURES]
    drawn = [distinct.where(F.col("label") == v).orderBy(*order).limit(rows // 2) for v in (0, 1)]
    training = durable(drawn[0].union(drawn[1]).select("label", "weight", *FEATURES).coalesce(1))
    if training.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(training)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, weightCol="weight")
    return forest.fit(vectors.select("features", "weight", F.col("label").cast("double").alias("label")))


def scored(found: DataFrame, model) -> DataFrame:
    """``found`` with ``score``, the forest's probability of a secret; 1 without a forest."""
    if model is None:
        return found.withColumn("score", F.lit(1.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    return model.transform(vectors).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> DataFrame:
    """doc_id, start, end, value, score and ``secret`` of every candidate.

    ``labelled`` holds doc_id, start and label (1 or 0) of findings that were looked at.
    """
    found = candidates(docs, common_trigrams(docs), path)
    found = durable(found)
    if labelled is None:
        known = found.withColumn("label", rule_label())
    else:
        known = found.join(labelled.select("doc_id", "start", "label"), ["doc_id", "start"])
    return scored(found, train(known)).select(
        "doc_id", "start", "end", "value", F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("secret")
    )
