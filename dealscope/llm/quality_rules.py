"""Quality rules by host: document rules, failure rates per host, verdicts back to documents.

Each document is judged by rules on its own text. The failures are summed per host, and a host's rate is
shrunk towards the corpus by a beta prior whose parameters come from the rates of all hosts (method of
moments), so that a host with few documents is not condemned by one of them. A document is kept if it passes
the base rules and its host's shrunk rate is not above ``host_limit``.

Defined cases: a null or empty text has no words and fails; a null host is a host of its own; repeated rows
are judged and counted one by one; a text that equals its host's others counts each time. An empty table
gives an empty result. Columns other than doc_id, text and the host column are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import checked_broadcast, durable, identified, let, word_windows, words

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEATED_PERCENT = 20
#: rules that count against the host but do not reject a document alone
MAX_SYMBOLS_PERCENT = 10
MAX_DUP_LINES_PERCENT = 30
#: a host whose shrunk failure rate is above this loses all its documents
HOST_LIMIT = 0.75


def repeated_words(hashes: Column) -> Column:
    """Words inside windows of five that occur twice or more in the text, first occurrences included."""
    size = F.lit(REPEAT_WINDOW)

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        starts = let(
            ordered,
            lambda o: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            o,
                            lambda s, i: F.struct(
                                s["i"].alias("i"),
                                (
                                    F.coalesce(F.get(o, i - 1)["w"] == s["w"], F.lit(False))
                                    | F.coalesce(F.get(o, i + 1)["w"] == s["w"], F.lit(False))
                                ).alias("twice"),
                            ),
                        ),
                        lambda s: s["twice"],
                    ),
                    lambda s: s["i"],
                )
            ),
        )
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct(
            (a["n"] + p + size - F.greatest(p, a["end"])).alias("n"), (p + size).alias("end")
        )
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    return let(
        word_windows(hashes, REPEAT_WINDOW),
        lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), F.lit(0)).otherwise(covered(w)),
    )


def text_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its key, host, the counts its rules need and whether it fails the base rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = identified(docs, "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).select(
        "doc_id", "row_hash", "host", words(F.col("text")).alias("ws"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
    )
    return counted.select(
        "doc_id", "row_hash", "host", F.size("ws").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "ws")).cast("bigint").alias("word_chars"),
        "n_symbols", "n_dup_lines", "n_lines",
        repeated_words(F.transform("ws", lambda w: F.xxhash64(w))).cast("bigint").alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")),
    )


def host_rates(measures: DataFrame) -> DataFrame:
    """host, n_docs, n_failed, shrunk: the failure rate under a beta prior fitted to all hosts' rates.

    With rate mean m and variance v over hosts the prior has strength m(1-m)/v - 1, at least 1; where the
    variance is 0 (one host, or all alike) the strength is that of one average host.
    """
    failed = (
        F.col("base_failed")
        | (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"))
    )
    hosts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("bigint")).alias("n_failed")
    )
    rate = F.col("n_failed") / F.col("n_docs")
    spread = hosts.agg(
        F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg("n_docs").alias("size")
    )
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1))
    prior = spread.select("m", F.coalesce(strength, F.col("size")).alias("strength"))
    m, s = prior.select("m").scalar(), prior.select("strength").scalar()
    return hosts.withColumn("shrunk", (F.col("n_failed") + m * s) / (F.col("n_docs") + s))


def judge(docs: DataFrame, host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """Measures of every document with ``host_rate`` and ``kept``; ``row_hash`` tells rows with one id apart."""
    measures = durable(text_measures(docs, host))
    hosts = durable(host_rates(measures)).select("host", F.col("shrunk").alias("host_rate"))
    return measures.join(checked_broadcast(hosts), "host").withColumn(
        "kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit)
    )
