"""Benchmark decontamination: token windows of documents against the n-grams of the test items.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII characters after A-Z is lower-cased. A test n-gram is 13
consecutive words of an item; an item of fewer words (but not none) is one n-gram. Each n-gram has an anchor, the
one of its words that the fewest n-grams hold. The n-grams are broadcast by the hash of their anchor while they are at
most ``BROADCAST_GRAMS`` with at most ``BROADCAST_BYTES`` of words (both counted first; the ids of their items never are
broadcast). The texts are read once: every word is looked up among the anchors, and where one fits, the window
around it is compared word by word. Beyond the bounds every window's hash is shuffled to the n-grams' (four numbers
a window), and the words are fetched for the hits only. A document word inside any verified window is hit.

Defined cases: null texts have no words, items without words have no n-gram, a null item_id never shows in
``items``; equal n-grams of several items count for each of them; overlapping windows count a word once; rows
with the same id and text are the same document twice and get the same result; rows with the same id and
different texts are judged apart. Other columns are not read. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import ascii_lower, durable, identified, kept_rows, let, word_windows, words

NGRAM = 13
#: words before lower-casing: digits, letters and all beyond ASCII (named as such; the complement is matched far slower)
PATTERN = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: a document is contaminated if at least one word in twenty is hit
ONE_WORD_IN = 20
#: test n-grams, and bytes of their words, that are broadcast
BROADCAST_GRAMS, BROADCAST_BYTES = 500_000, 64 << 20


def normal_words(text: Column) -> Column:
    return F.transform(words(text, PATTERN), ascii_lower)


def ngrams_of(benchmark: DataFrame, size: int = NGRAM) -> DataFrame:
    """gram (its name), size, ngram (its words), item: one row per distinct n-gram and item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("ws"))
    items = items.where(F.size("ws") > 0).withColumn("size", F.least(F.lit(size), F.size("ws")))
    grams = F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1), lambda i: F.slice("ws", i, F.col("size")))
    rows = items.select("item", "size", F.explode(grams).alias("ngram"))
    named = rows.distinct().select(F.md5(F.array_join("ngram", " ")).alias("gram"), "size", "ngram", "item")
    return durable(named, rows.count())


def _anchored(grams: DataFrame) -> DataFrame:
    """gram, size, ngram with ``offset`` and ``key``: place and hash of the word that the fewest n-grams hold."""
    cells = grams.select("gram", F.posexplode("ngram").alias("offset", "word"))
    common = cells.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct("n", (-F.length("word")).alias("l"), "word", "offset")).alias("best")
    chosen = cells.join(common, "word").groupBy("gram").agg(best)
    return grams.join(chosen, "gram").select(
        "gram", "size", "ngram", F.col("best.offset").alias("offset"), F.xxhash64("best.word").alias("key")
    )


def _by_broadcast(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """Each document's size and hits from one pass; the empty word behind its last one looks up the row for sizes."""
    end = grams.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("gram"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("ngram"),
        F.lit(0).alias("offset"), F.xxhash64(F.lit("")).alias("key"),
    )
    known = F.broadcast(durable(_anchored(grams).unionByName(end), grams.count()))
    cells = texts.select("doc_id", "row_hash", "ws", F.posexplode(F.concat("ws", F.array(F.lit("")))).alias("at", "word"))
    begin = F.col("at") - F.col("offset")
    # word by word and without a lambda, so that explode, lookup and test are one generated loop that copies no text
    fits = F.when(F.col("gram").isNull(), F.col("word") == "").otherwise(F.col("word") != "")
    for i in range(NGRAM):
        fits = fits & ((F.col("size") <= i) | (F.get("ws", begin + i) == F.get("ngram", F.lit(i))))
    hits = cells.withColumn("key", F.xxhash64("word")).join(known, "key").where(fits)
    return hits.select("doc_id", "row_hash", begin.alias("at"), "size", "gram")


def _by_shuffle(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """The same rows where the n-grams are too many to broadcast."""
    out = texts.select(
        "doc_id", "row_hash", F.size("ws").alias("at"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("gram")
    )
    hashed = lambda ws: F.transform(ws, lambda w: F.xxhash64(w))
    found = None
    for size in sorted(r["size"] for r in grams.select("size").distinct().collect()):  # at most ``NGRAM`` values
        keys = grams.where(F.col("size") == size).select("gram", word_windows(hashed("ngram"), size)[0].alias("key"))
        windows = word_windows(hashed("ws"), size)
        rows = texts.select("doc_id", "row_hash", F.posexplode(windows).alias("at", "key")).join(keys, "key")
        rows = rows.select("doc_id", "row_hash", F.struct("at", F.lit(size).alias("size"), "gram").alias("hit"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return out
    found = found.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("r")).agg(F.collect_set("hit").alias("hits"))
    fetched = texts.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")))
    window = F.slice("ws", F.col("hit.at") + 1, F.col("hit.size"))
    fetched = fetched.select("doc_id", "row_hash", "ws", F.explode("hits").alias("hit"))
    fetched = fetched.select("doc_id", "row_hash", "hit.at", "hit.size", "hit.gram", window.alias("window"))
    same = fetched.join(grams.select("gram", "ngram"), "gram").where(F.col("window") == F.col("ngram"))
    return out.unionByName(same.select("doc_id", "row_hash", "at", "size", "gram"))


def sizes_and_hits(docs: DataFrame, ngrams: DataFrame) -> DataFrame:
    """doc_id, row_hash, at, size, gram: every verified n-gram, and for every row its number of words (``at``, gram null)."""
    texts = identified(docs, normal_words(F.col("text")).alias("ws"))
    grams = durable(ngrams.select("gram", "size", "ngram").distinct(), ngrams.count())
    held = grams.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("ngram", " "))), F.lit(0))).first()
    small = held[0] <= BROADCAST_GRAMS and held[1] <= BROADCAST_BYTES
    return durable((_by_broadcast if small else _by_shuffle)(texts, grams), docs.count())


def _covered(spans: Column) -> Column:
    """Words inside the union of (at, size) spans, which are sorted by position."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(s["at"], a["end"]))).alias("n"),
        F.greatest(a["end"], s["at"] + s["size"]).alias("end"),
    )
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: key, n_words, n_hit, items (sorted as strings), spans (at, size), contaminated."""
    ngrams = ngrams_of(benchmark)
    found = sizes_and_hits(docs, ngrams)
    sizes = found.where(F.col("gram").isNull()).select("doc_id", "row_hash", F.col("at").cast("bigint").alias("n_words"))
    hits = found.where(F.col("gram").isNotNull()).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), "at", "size", "gram")
    spans = hits.groupBy("d", "r").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"))
    named = hits.select("d", "r", "gram").distinct().join(ngrams.where(F.col("item").isNotNull()).select("gram", "item"), "gram")
    named = named.groupBy("d", "r").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.withColumnsRenamed({"d": "nd", "r": "nr"})
    per_doc = spans.join(named, F.col("d").eqNullSafe(F.col("nd")) & (F.col("r") == F.col("nr")), "left")
    per_doc = per_doc.select("d", "r", "spans", "items", _covered(F.col("spans")).cast("bigint").alias("hit"))
    joined = sizes.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    return joined.select(
        "doc_id", "row_hash", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
        ((n_hit > 0) & (ONE_WORD_IN * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows."""
    return kept_rows(docs, contamination(docs, benchmark).where("contaminated"), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and the normal words of each document that no test n-gram covers, joined by spaces."""
    spans = contamination(docs, benchmark).select(F.col("doc_id").alias("d"), F.col("row_hash").alias("r"), "spans")
    texts = identified(docs, normal_words(F.col("text")).alias("ws"))
    joined = texts.join(spans.dropDuplicates(["d", "r"]), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_hash") == F.col("r")))
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    rest = let(
        F.struct("ws", hit.alias("hit")),
        lambda x: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(x["ws"]) - 1), x["hit"]), lambda i: F.get(x["ws"], i)
        ),
    )
    clean = F.when(F.col("spans").isNull(), F.col("ws")).otherwise(rest)
    return joined.select("doc_id", F.array_join(clean, " ").alias("text"))
