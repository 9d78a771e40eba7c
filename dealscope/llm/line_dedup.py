"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines with a word in them is a window (lines without a word are passed over
and never removed). A window found again, in a later document or further down, marks the lines it covers
there; covered positions are merged and removed, and the first occurrence keeps its lines. Order is
(doc_id, position). Windows are judged on the input. An occurrence that overlaps its own window's first
occurrence marks only what lies behind it.

Defined cases: null text stays null with no lines; a text of fewer than three such lines has no window and
stays; a null doc_id counts as the largest; rows with the same id and text are the same document twice and
get the same result, both judged as that document; rows with the same id and different texts are ordered by
the hash of the row. Columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import NO_ID, durable, identified, let

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _windows(docs: DataFrame) -> DataFrame:
    """One row per window: its 128-bit key, and the document and positions it covers."""
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("at"))),
        lambda x: x["line"].rlike(HAS_WORD),
    )
    found = let(
        lines,
        lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x) - WINDOW),
            lambda i: F.struct(
                F.md5(F.concat_ws("\n", *[F.get(x, i + k)["line"] for k in range(WINDOW)])).alias("key"),
                i.alias("nth"),
                F.array(*[F.get(x, i + k)["at"] for k in range(WINDOW)]).alias("covers"),
            ),
        ),
    )
    return (
        identified(docs, "text")
        .where(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))) >= WINDOW)
        .select("doc_id", "row_hash", F.inline(found))
        .withColumn("place", F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "row_hash", "nth"))
    )


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, removed: the positions (from 0, in the split text) that later occurrences cover."""
    windows = _windows(docs)
    repeated = durable(
        windows.groupBy("key")
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("key", "first")
    )
    own = (F.col("place.doc") == F.col("first.doc")) & (F.col("place.row_hash") == F.col("first.row_hash"))
    behind = F.when(own, F.col("first.nth") + WINDOW - F.col("place.nth")).otherwise(0)
    return (
        windows.join(repeated, "key")
        .where(F.col("place") != F.col("first"))
        .select("doc_id", "row_hash", F.explode(F.slice("covers", F.greatest(F.lit(0), behind) + 1, WINDOW)).alias("at"))
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("at").alias("removed"))
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with later occurrences cut from ``text``; ``llm_lines`` and ``llm_removed`` count."""
    cut = removed_lines(docs).select(
        F.col("doc_id").alias("_llm_doc_id"), F.col("row_hash").alias("_llm_key_hash"), F.col("removed").alias("_llm_removed")
    )
    marked = docs.withColumn("_llm_row_hash", F.xxhash64("doc_id", "text"))
    joined = marked.join(
        cut,
        marked["doc_id"].eqNullSafe(cut["_llm_doc_id"]) & (marked["_llm_row_hash"] == cut["_llm_key_hash"]),
        "left",
    )
    lines = F.split("text", "\n")
    thinned = let(
        lines,
        lambda x: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_llm_removed"), lambda i: F.get(x, i)), "\n"
        ),
    )
    text = F.when(F.col("_llm_removed").isNull(), F.col("text")).otherwise(thinned)
    return joined.select(
        *[text.alias(c) if c == "text" else joined[c] for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("llm_lines"),
        F.coalesce(F.size("_llm_removed"), F.lit(0)).cast("bigint").alias("llm_removed"),
    )
