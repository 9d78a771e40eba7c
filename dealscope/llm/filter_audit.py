"""Filter interaction audit: what each filter removes in every order of five filters, per part of the corpus.

A document fails A with under 100 words; B if its distinct words are under 80 % of them; C if capitals A-Z are
over 10 % of its code points; D if it holds one of ``#$%&*|``; E if a document of smaller doc_id has the same
text, anywhere in the table. Words are maximal runs of anything but ASCII white space. A part is a ``lang``.

The documents are dealt out as ranges of ids within a part. A range keeps one sorted posting list of failing
places per filter. The union of every set of filters is built from the union of one filter fewer by a galloping
merge (the shorter list's places are searched in the longer one), every step's removals are the difference of
two lists, and only the sizes of those lists leave the range, to be summed per part. So a task holds the lists
of one block of ids, whatever the size of a part.

Defined cases: a null text is empty (and equal to other empty texts), a null lang is the part ''; a null doc_id
counts as the largest, so it never makes another document a copy; rows with the same doc_id are no copies of
each other, each counts, and copies of smaller ids; a document is good or toxic if any row of ``labels`` with
its id says so, and a null id has no label. Texts that are not UTF-8 are judged by their bytes. Other columns
are not read. An empty table gives no rows. Equal texts are found by a 128-bit digest.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import NO_ID, durable, partitions

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: bytes that begin no code point
INNER = bytes(range(0x80, 0xC0))
#: ids that one block of posting lists covers
BLOCK = 1 << 17
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
_ALL = (1 << len(FILTERS)) - 1


def fails(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()
    n, chars = len(words), len(text.translate(None, INNER))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
        | (100 * capitals > CAPITAL_PERCENT * chars) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits, digests = [], []
        for text in batch.column("raw"):
            raw = text.as_py()
            bits.append(fails(raw))
            digests.append(xxhash.xxh3_128_digest(raw))
        kept = {c: batch.column(c) for c in ("id", "part")}
        yield pa.RecordBatch.from_pydict(kept | {"bits": pa.array(bits, pa.int32()), "digest": pa.array(digests, pa.binary())})


def failing(docs: DataFrame) -> DataFrame:
    """id, part, digest, bits and copies: distinct documents with the filters they fail, and how often each stands there."""
    texts = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).cast("binary").alias("raw"),
    )
    n = docs.count()
    own = durable(texts.mapInArrow(_measured, "id bigint, part string, bits int, digest binary"), n)
    rows = own.groupBy("id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("copies"))
    shared = durable(
        own.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"),
        n,
    )
    later = F.when(F.col("id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(shared, "digest", "left").select(
        "id", "part", "digest", F.col("bits").bitwiseOR(later).alias("bits"), "copies"
    )


def without(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What of the sorted list ``a`` is not in the sorted list ``b``: the shorter is searched in the longer."""
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return a[(at == len(b)) | (b[np.minimum(at, len(b) - 1)] != a)] if len(b) else a
    at = np.searchsorted(a, b)
    at = at[(at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)]
    keep = np.ones(len(a), bool)
    keep[at] = False
    return a[keep]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both sorted lists as one, without repeats."""
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    new = without(shorter, longer)
    return np.insert(longer, np.searchsorted(longer, new), new)


def sizes(bits: np.ndarray, copies: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each order and step (120 x 5) the seven counts over one block of documents."""
    n, total = len(FILTERS), int(copies.sum())
    count = lambda places, of=copies: int(of[places].sum())
    postings = [np.flatnonzero(bits >> f & 1) for f in range(n)]
    joined = [np.empty(0, np.int64)]
    for s in range(1, _ALL + 1):
        top = s.bit_length() - 1
        joined.append(union(joined[s ^ 1 << top], postings[top]))
    union_sizes = [count(u) for u in joined]
    step: dict[tuple[int, int], tuple[int, ...]] = {}
    for f in range(n):
        for before in range(_ALL + 1):
            if not before >> f & 1:
                gone = without(postings[f], joined[before])
                step[f, before] = count(gone), count(gone, good), count(gone, toxic)
    shapley = [
        sum(
            math.factorial(k := before.bit_count()) * math.factorial(n - 1 - k) * step[f, before][0]
            for before in range(_ALL + 1)
            if not before >> f & 1
        )
        for f in range(n)
    ]
    out = np.zeros((len(ORDERS), n, len(COUNTS)), np.int64)
    for o, order in enumerate(ORDERS):
        before = 0
        for k, letter in enumerate(order):
            f = FILTERS.index(letter)
            removed, good_lost, toxic_lost = step[f, before]
            unique = step[f, _ALL ^ 1 << f][0]
            failed = count(postings[f])
            before |= 1 << f
            out[o, k] = (
                total - union_sizes[before], removed, failed - removed, unique, good_lost, toxic_lost, shapley[f]
            )
    return out


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per part over the blocks of one range of (part, id), which arrives sorted."""
    sums: np.ndarray | None = None
    part: str | None = None
    held: list[pa.RecordBatch] = []

    def block() -> np.ndarray:
        rows = pa.Table.from_batches(held)
        bits, copies, good, toxic = (rows.column(c).to_numpy().astype(np.int64) for c in ("bits", "copies", "good", "toxic"))
        return sizes(bits, copies, copies * good, copies * toxic)

    def result() -> pa.RecordBatch:
        flat = sums.reshape(-1, len(COUNTS))
        steps = len(FILTERS)
        made = {
            "part": pa.array([part] * len(flat)),
            "filter_order": pa.array([o for o in ORDERS for _ in range(steps)]),
            "step": pa.array(list(range(1, steps + 1)) * len(ORDERS), pa.int32()),
        }
        return pa.RecordBatch.from_pydict(made | {c: pa.array(flat[:, i]) for i, c in enumerate(COUNTS)})

    for batch in batches:
        parts = batch.column("part").to_pylist()
        begin = 0
        while begin < len(parts):
            end = next((i for i in range(begin, len(parts)) if parts[i] != parts[begin]), len(parts))
            full = sum(b.num_rows for b in held) >= BLOCK
            if held and (full or parts[begin] != part):
                sums = block() if sums is None else sums + block()
                held = []
            if sums is not None and parts[begin] != part:
                yield result()
                sums = None
            part = parts[begin]
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        sums = block() if sums is None else sums + block()
        yield result()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the seven counts: 600 rows for every part of ``docs``."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(f"_{c}")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("id"))
    known = known.agg(flag("quality"), flag("toxic"))
    # the largest id stands for null ones
    marked = failing(docs).join(known.where(F.col("id") < NO_ID), "id", "left").select(
        "id", "part", "digest", "bits", "copies",
        F.coalesce("_quality", F.lit(0)).alias("good"), F.coalesce("_toxic", F.lit(0)).alias("toxic"),
    )
    order = ["part", "id", "digest"]
    ranges = durable(marked, docs.count()).repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    found = ranges.mapInArrow(_audited, schema).groupBy("part", "filter_order", "step")
    return found.agg(*[F.sum(c).alias(c) for c in COUNTS])
