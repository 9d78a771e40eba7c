"""N-gram Jaccard join: Bayesian pruning of MinHash candidates, then an exact check.

Documents are sets of five-word shingles. Equal sets form a class; classes are joined. Signatures of 60
MinHash values are cut into 20 bands of three: two sets of Jaccard 0.8 share no band with probability
(1 - 0.8^3)^20 = 6e-7. Inside a bucket the signatures are compared twelve values at a time; with a uniform
prior the similarity after m matches of n has a Beta(m + 1, n - m + 1) posterior, and a pair is dropped when
its probability of reaching the threshold falls below ``TOLERANCE``. What survives connects the classes into
components, and inside a component every pair that survives the same pruning is verified on whole sets.

No group is held by one task: buckets and components larger than a block are dealt out as pairs of
blocks, and a task gives one row per member (its links, and a root of what it is linked with), not one per
pair. Equal texts never meet as pairs.

Defined cases: words are runs of anything but ASCII white space, taken as they are; a text of one to four
words is one shingle; null, empty and blank texts have none, link with nothing and are groups of their own; a
null doc_id counts as the largest; repeated rows are copies of one class, one of which stays. Ties go to the
smallest doc_id. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import NO_ID, durable, identified, kept_rows, partitions, runs
from dealscope.llm.components import components

SHINGLE = 5
#: similarity from which two documents are linked, as a fraction
THRESHOLD = (4, 5)
BANDS, ROWS = 20, 3
STEP = 12
TOLERANCE = 1e-6
#: members of a bucket, and of a component, that one task compares with as many others
BLOCK, SET_BLOCK = 512, 128
#: shingles hashed or multiplied at a time
SLAB = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    n = max(1, len(h) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(values: np.ndarray) -> np.ndarray:
    """The least of each of 60 permutations, the upper 32 bits."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), SLAB):
        part = values[at : at + SLAB]
        for k in range(len(_FACTORS)):
            least[k] = min(least[k], (part * _FACTORS[k]).min())
    return (least >> np.uint64(32)).astype(np.uint32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sigs = [], []
        for text in batch.column("text").to_pylist():
            values = shingles(text)
            keys.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
            sigs.append(signature(values).tobytes() if len(values) else None)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()), "row_hash": batch.column("row_hash"),
                "key": pa.array(keys, pa.binary()), "sig": pa.array(sigs, pa.binary()),
            }
        )


def fewest_matches() -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m matches is dropped."""
    t = THRESHOLD[0] / THRESHOLD[1]
    rules = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
        tail, m = 0.0, 0
        while tail + (p := math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < TOLERANCE:
            tail, m = tail + p, m + 1
        rules.append((n, m))
    return rules


_RULES = fewest_matches()


def survivors(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of signatures that no step drops."""
    seen = 0
    i = j = None
    for n, least in _RULES:
        if i is None:
            matches = np.zeros((len(a), len(b)), np.uint8)
            for k in range(seen, n):
                matches += a[:, k, None] == b[None, :, k]
            i, j = np.nonzero(matches >= least)
            same = matches[i, j].astype(np.int64)
        else:
            same = same + (a[i, seen:n] == b[j, seen:n]).sum(axis=1)
            kept = same >= least
            i, j, same = i[kept], j[kept], same[kept]
        seen = n
    return i, j


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each number is connected with by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _dealt(members: DataFrame, group: str, block: int) -> DataFrame:
    """``members`` (with ``size``, that of their group) repeated for each pair of blocks they belong to, by ``task``."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int")
    spread = members.withColumn("blocks", blocks).withColumn("own", own)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("own", "other"), F.greatest("own", "other")
    spread = spread.withColumn("task", F.xxhash64(group, *pair)).withColumn("second", F.col("own") > F.col("other"))
    spread = spread.withColumn("alone", F.col("own") == F.col("other")).drop("blocks", "own", "other", "size")
    return spread.repartition(partitions(members.sparkSession), "task").sortWithinPartitions("task")


def _sides(rows: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, signatures, positions in the table, and the row numbers of the two sides to compare."""
    keys = rows.column("key").to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    order = [o for n, o in enumerate(order) if not n or keys[o] != keys[order[n - 1]]]
    sigs = rows.column("sig").to_pylist()
    matrix = np.frombuffer(b"".join(sigs[o] for o in order), np.uint32).reshape(len(order), -1)
    second = np.array(rows.column("second").to_pylist())[order]
    if rows.column("alone")[0].as_py():
        side_a = side_b = np.arange(len(order))
    else:
        side_a, side_b = np.flatnonzero(~second), np.flatnonzero(second)
    return [keys[o] for o in order], matrix, np.array(order), side_a, side_b


def _pairs(matrix: np.ndarray, side_a: np.ndarray, side_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surviving pairs, in bands of rows so that the match table stays small."""
    found = []
    for at in range(0, len(side_a), BLOCK):
        for to in range(0, len(side_b), BLOCK):
            i, j = survivors(matrix[side_a[at : at + BLOCK]], matrix[side_b[to : to + BLOCK]])
            i, j = side_a[at + i], side_b[to + j]
            keep = i < j if side_a is side_b else i != j
            found.append((i[keep], j[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): every member of a bucket with the root of what it may be similar to."""
    for rows in runs(batches, "task"):
        keys, matrix, _, side_a, side_b = _sides(rows)
        root = roots(len(keys), *_pairs(matrix, side_a, side_b))
        ends = np.flatnonzero(root != np.arange(len(keys)))
        if len(ends):
            yield pa.RecordBatch.from_pydict(
                {
                    "a": pa.array([keys[e] for e in ends], pa.binary()),
                    "b": pa.array([keys[r] for r in root[ends]], pa.binary()),
                }
            )


def _linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs reach the threshold exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if len(i) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[x], sets[y], True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:
        values, number = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        table = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, len(values), SLAB):
            lo, hi = np.searchsorted(number, [at, at + SLAB])
            slab = np.zeros((len(sets), SLAB), np.float32)
            slab[owner[lo:hi], number[lo:hi] - at] = 1
            table += slab @ slab.T
        common = table[i, j].astype(np.int64)
    return THRESHOLD[1] * common >= THRESHOLD[0] * (sizes[i] + sizes[j] - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, links, root): the documents each member is linked with here, and a root of its links."""
    for rows in runs(batches, "task"):
        keys, matrix, order, side_a, side_b = _sides(rows)
        i, j = _pairs(matrix, side_a, side_b)
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        if not len(used):
            continue
        packed, copies = rows.column("shingles"), np.array(rows.column("copies").to_pylist(), np.int64)[order]
        sets = [np.frombuffer(packed[int(order[u])].as_py(), np.uint64) for u in used]
        good = _linked(sets, back[: len(i)], back[len(i) :])
        i, j = i[good], j[good]
        links = np.zeros(len(keys), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        root = roots(len(keys), i, j)
        ends = np.flatnonzero(links)
        yield pa.RecordBatch.from_pydict(
            {
                "key": pa.array([keys[e] for e in ends], pa.binary()),
                "links": pa.array(links[ends]),
                "root": pa.array([keys[r] for r in root[ends]], pa.binary()),
            }
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1)
            made = pa.array([shingles(row.column("text")[0].as_py()).tobytes()], pa.binary())
            yield pa.RecordBatch.from_pydict({c: row.column(c) for c in row.schema.names if c != "text"} | {"shingles": made})


def _candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) between classes that survive the pruning inside some bucket."""
    size = 4 * ROWS
    bands = [F.xxhash64(F.lit(b), F.substring("sig", b * size + 1, size)) for b in range(BANDS)]
    bucketed = classes.select("key", F.explode(F.array(*bands)).alias("bucket"))
    shared = durable(bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), classes.count())
    members = bucketed.join(shared, "bucket").join(classes.select("key", "sig"), "key")
    return _dealt(members, "bucket", BLOCK).mapInArrow(_connect, "a binary, b binary")


def linked(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, row_hash, class_id, n_links, group_id and whether it is its group's ``first``.

    class_id is the smallest doc_id with the same shingles, group_id the smallest one reached by links, n_links
    the number of other documents of similarity 0.8 or more, copies included.
    """
    n = docs.count()
    signed = durable(
        identified(docs, "text").mapInArrow(_sign, "doc_id bigint, row_hash bigint, key binary, sig binary"), n
    ).withColumn("place", F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.col("row_hash").alias("row")))
    classes = durable(
        signed.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("copies"), F.min("sig").alias("sig")),
        n,
    )
    found = components(_candidates(classes))
    sizes = durable(found.groupBy("root").agg(F.count(F.lit(1)).alias("size")), n)
    members = durable(found.join(sizes, "root").join(classes, found["node"] == classes["key"]).drop("node"), n)
    texts = identified(docs, "text")
    reps = members.withColumnRenamed("root", "found")
    sets = texts.join(
        reps,
        (F.coalesce(texts["doc_id"], F.lit(NO_ID)) == reps["first.doc"]) & (texts["row_hash"] == reps["first.row"]),
    ).select("key", "found", "size", "copies", "sig", "text")
    sets = sets.mapInArrow(_sets, "key binary, found binary, size bigint, copies bigint, sig binary, shingles binary")
    verified = durable(_dealt(sets, "found", SET_BLOCK).mapInArrow(_verify, "key binary, links bigint, root binary"), n)
    groups = components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    known = (
        classes.select("key", "first", "copies")
        .join(links, "key", "left")
        .join(groups.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    known = durable(known, n)
    firsts = durable(known.groupBy("root").agg(F.min("first").alias("group_first")), n)
    known = durable(known.join(firsts, "root").drop("root"), n)
    own = F.coalesce("first", "place")
    group = F.coalesce("group_first", "place")
    return signed.select("doc_id", "row_hash", "place", "key").join(known, "key", "left").select(
        "doc_id", "row_hash",
        F.nullif(own["doc"], F.lit(NO_ID)).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        F.nullif(group["doc"], F.lit(NO_ID)).alias("group_id"),
        (group == F.col("place")).alias("first"),
    )


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are first in their group; of repeated rows one stays."""
    rows = durable(linked(docs).where("first"), docs.count())
    kept = kept_rows(docs, rows, "left_semi")
    repeated = rows.groupBy("doc_id", "row_hash").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    marked = kept.withColumn("_llm_row_hash", F.xxhash64("doc_id", "text"))
    return marked.dropDuplicates(["doc_id", "_llm_row_hash"]).drop("_llm_row_hash")
