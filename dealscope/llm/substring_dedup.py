"""Substring dedup by recompression.

Word sequences are compressed in rounds: equal neighbours become a run symbol, then the alphabet is halved by
a bit of each name and every (left, right) neighbour pair becomes a symbol. A name is a hash of what the
symbol stands for, so names are global: equal substrings get equal symbols wherever they stand, but for the
ends, whose symbols depend on what lies beyond. Each symbol carries the stretch of words that decides it, so
it is known exactly which windows of 13 words hold a symbol in its interior whatever surrounds them.

1. Every window is represented by its highest interior symbol (its anchor), named by the words that decide
   it; the names are dealt out by hash, and those that occur in two documents are sent back to them.
2. Windows whose anchor is shared are named whole (128 bits) and dealt out by anchor; the document with the
   smallest id keeps a window, the others are told.
3. Words covered by windows told to a document are cut.

A task sends one entry for a name that several of its documents share, so a passage that a third of all
documents hold arrives once from each task's slice of text. Names travel packed, sorted by document.

Defined cases: a null or blank text has no words; a text of fewer than 13 words has no window and stays; a
null doc_id counts as the largest; rows with one doc_id never cut each other and are cut by smaller ids
alike; windows are judged on the input, not on what is left. Only doc_id and text are read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import NO_ID, partitions, runs, slices

WINDOW = 13
ROUNDS = 3
#: levels below this are too short to tell windows apart; such windows stand for themselves
LOWEST = 2
SLICE_BYTES = 2_000_000
#: buckets per shuffle partition
SPREAD = 4
_FAR = 1 << 40
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


class Slice:
    """The words of some documents one after the other, with their symbols."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = np.array(ids, np.int64)
        self.words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in self.words for w in ws), np.uint64, len(self.doc))
        self.begin, self.end = self.starts[self.doc], self.ends[self.doc]
        at = np.arange(len(self.doc))
        #: where windows begin
        self.windows = at[at + WINDOW <= self.end]
        self._powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.h), m)]), dtype=np.uint64) for m in (_M1, _M3)]
        inverse = [np.uint64(pow(int(m), -1, 1 << 64)) for m in (_M1, _M3)]
        self._back = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(self.h), m)]), dtype=np.uint64) for m in inverse]
        self._sums = [
            np.concatenate([[np.uint64(0)], np.cumsum(v * p[:-1], dtype=np.uint64)])
            for v, p in zip((self.h, mixed(self.h + _M1)), self._powers, strict=True)
        ]

    def named(self, start: np.ndarray, end: np.ndarray, half: int = 0) -> np.ndarray:
        """64 bits of the name of each stretch of words."""
        return mixed((self._sums[half][end] - self._sums[half][start]) * self._back[half][start] + (end - start).astype(np.uint64))

    def levels(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each round from the first: its number, and the stretch (from, to) that decides each symbol."""
        h, begin, end = self.h, self.begin, self.end
        name, s = h, np.arange(len(h))
        e, low, high = s + 1, s, s + 1
        for level in range(1, ROUNDS + 1):
            if not len(name):
                return
            # runs of one symbol
            d = self.doc[s]
            heads = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (d[1:] != d[:-1])]))
            tails = np.concatenate([heads[1:], [len(name)]]) - 1
            times = (tails - heads + 1).astype(np.uint64)
            rs, re = s[heads], e[tails]
            left, right = rs > begin[rs], re < end[rs]
            near = np.where(h[rs - 1] != h[e[heads] - 1], rs - 1, low[heads - 1])
            rlow = np.minimum(np.minimum.reduceat(low, heads), np.where(left, near, -_FAR))
            after, following = np.minimum(re, len(h) - 1), np.minimum(tails + 1, len(name) - 1)
            near = np.where(h[after] != h[s[tails]], re + 1, high[following])
            rhigh = np.maximum(np.maximum.reduceat(high, heads), np.where(right, near, _FAR))
            name = np.where(times > 1, mixed(name[heads] + times * _M3), name[heads])
            # pairs of a left and a right symbol
            is_left = (mixed(name + np.uint64(level * int(_M1) % (1 << 64))) >> np.uint64(40)) & np.uint64(1) == 0
            d = self.doc[rs]
            pair = np.concatenate([is_left[:-1] & ~is_left[1:] & (d[1:] == d[:-1]), [False]])
            one = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
            two = np.minimum(one + 1, len(name) - 1)
            joined = pair[one]
            has_next = re[one] < end[rs[one]]
            has_last = rs[one] > begin[rs[one]]
            alone_left = ~joined & is_left[one]
            alone_right = ~joined & ~is_left[one]
            low = np.where(joined, np.minimum(rlow[one], rlow[two]), rlow[one])
            low = np.where(alone_right, np.minimum(low, np.where(has_last, rlow[one - 1], -_FAR)), low)
            high = np.where(joined, np.maximum(rhigh[one], rhigh[two]), rhigh[one])
            high = np.where(alone_left, np.maximum(high, np.where(has_next, rhigh[two], _FAR)), high)
            name = np.where(joined, mixed(name[one] * _M1 + (name[two] ^ _M3)), name[one])
            s, e = rs[one], np.where(joined, re[two], re[one])
            yield level, name, low, high

    def anchors(self) -> np.ndarray:
        """A name for every window: that of its anchor, the leftmost interior symbol of the highest level."""
        low, high = np.full(len(self.h), -1), np.zeros(len(self.h), np.int64)
        for level, name, from_, to in self.levels():
            if level < LOWEST:
                continue
            fits = np.flatnonzero(to - from_ <= WINDOW)
            fits = fits[np.lexsort((-fits, ~name[fits]))]  # the least name is written last, of equal ones the leftmost
            from_, to = from_[fits], to[fits]
            first = np.maximum(to - WINDOW, self.begin[from_])
            count = np.maximum(0, np.minimum(from_, self.end[from_] - WINDOW) - first + 1)
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            low[at], high[at] = np.repeat(from_, count), np.repeat(to, count)
        w = self.windows
        own = low[w] < 0
        return self.named(np.where(own, w, low[w]), np.where(own, w + WINDOW, high[w]))


def _packed(docs: np.ndarray) -> bytes:
    """Sorted ids as differences, which compress well."""
    return np.diff(docs, prepend=0).astype(np.int64).tobytes()


def _unpacked(rows: pa.Table, column: str, ids: bool = False) -> np.ndarray:
    """The packed numbers of all rows, one after the other."""
    parts = [np.frombuffer(x, np.int64 if ids else np.uint64) for x in rows.column(column).to_pylist()]
    return np.concatenate([np.cumsum(x) for x in parts] if ids else parts)


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray], docs: np.ndarray, told: np.ndarray) -> dict[int, dict[str, bytes]]:
    """Per bucket the packed columns and ids, those already ``told`` apart."""
    out: dict[int, dict[str, bytes]] = {}
    order = np.lexsort((docs, told, bucket))
    bucket, docs, told = bucket[order], docs[order], told[order]
    cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (told[1:] != told[:-1])) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        if hi > lo:
            mark = "told_" if told[lo] else ""
            row = {mark + c: v[order[lo:hi]].tobytes() for c, v in columns.items()}
            out.setdefault(int(bucket[lo]), {}).update(row | {mark + "docs": _packed(docs[lo:hi])})
    return out


def _rows(dealt: dict[int, dict[str, bytes]], columns: list[str]) -> pa.RecordBatch:
    names = [m + c for m in ("", "told_") for c in [*columns, "docs"]]
    arrays = {n: pa.array([row.get(n, b"") for row in dealt.values()], pa.binary()) for n in names}
    return pa.RecordBatch.from_pydict({"bucket": pa.array(list(dealt), pa.int32())} | arrays)


def _distinct(docs: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the distinct (keys, doc), sorted by keys and then doc; the number of each one's keys; the first of those."""
    order = np.lexsort((docs, *keys))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    d = docs[order]
    again = np.concatenate([[False], same & (d[1:] == d[:-1])])[: len(order)]
    group = np.cumsum(np.concatenate([[0], ~same]))[: len(order)]
    order, group = order[~again], group[~again]
    return order, group, np.searchsorted(group, group)


def _offer(buckets: int):
    """Map side of step 1: each slice's anchor names, one entry where several of its documents share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            own = Slice(batch.column("id").to_pylist(), batch.column("text").to_pylist())
            if not len(own.windows):
                continue
            names, docs = own.anchors(), own.ids[own.doc[own.windows]]
            order, group, first = _distinct(docs, names)
            names, docs = names[order], docs[order]
            size = np.bincount(group)[group]
            heads = first == np.arange(len(first))
            # the first document offers the name; where others share it, all of them are told
            at = np.concatenate([np.flatnonzero(heads), np.flatnonzero(size > 1)])
            told = np.concatenate([np.zeros(int(heads.sum()), bool), np.ones(int((size > 1).sum()), bool)])
            bucket = (mixed(names[at]) % np.uint64(buckets)).astype(np.int32)
            yield _rows(_dealt(bucket, {"names": names[at]}, docs[at], told), ["names"])

    return run


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side of step 1: (id, name) for every name that two documents hold."""
    for rows in runs(batches, "bucket"):
        names, docs = _unpacked(rows, "names"), _unpacked(rows, "docs", ids=True)
        order, group, _ = _distinct(docs, names)
        order = order[np.bincount(group)[group] > 1] if len(order) else order
        names = np.concatenate([names[order], _unpacked(rows, "told_names")])
        docs = np.concatenate([docs[order], _unpacked(rows, "told_docs", ids=True)])
        if len(docs):
            yield pa.RecordBatch.from_pydict({"id": pa.array(docs), "name": pa.array(names.view(np.int64))})


def _claim(buckets: int):
    """Map side of step 2: windows with a shared anchor, each for its smallest document here; the others are told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            own = Slice(batch.column("id").to_pylist(), batch.column("text").to_pylist())
            if not len(own.windows):
                continue
            lists = batch.column("names")
            held = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_pylist()).astype(np.uint64)
            shared = mixed(lists.flatten().to_numpy().view(np.uint64) ^ mixed(held + _M1))
            names, doc = own.anchors(), own.doc[own.windows]
            ask = np.isin(mixed(names ^ mixed(doc.astype(np.uint64) + _M1)), shared)
            at, names, docs = own.windows[ask], names[ask], own.ids[doc[ask]]
            low, high = own.named(at, at + WINDOW), own.named(at, at + WINDOW, 1)
            order, _, first = _distinct(docs, high, low)
            if not len(order):
                continue
            told = first != np.arange(len(order))
            bucket = (mixed(names[order]) % np.uint64(buckets)).astype(np.int32)
            yield _rows(_dealt(bucket, {"low": low[order], "high": high[order]}, docs[order], told), ["low", "high"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side of step 2: per document the names of its windows that a smaller one holds."""
    for rows in runs(batches, "bucket"):
        low, high, docs = _unpacked(rows, "low"), _unpacked(rows, "high"), _unpacked(rows, "docs", ids=True)
        order, _, first = _distinct(docs, high, low)
        order = order[first != np.arange(len(order))]
        low = np.concatenate([low[order], _unpacked(rows, "told_low")])
        docs = np.concatenate([docs[order], _unpacked(rows, "told_docs", ids=True)])
        if not len(docs):
            continue
        order = np.argsort(docs, kind="stable")
        low, docs = low[order], docs[order]
        cuts = np.flatnonzero(docs[1:] != docs[:-1]) + 1
        parts = np.split(low, cuts)
        yield pa.RecordBatch.from_pydict(
            {"id": pa.array(docs[np.concatenate([[0], cuts])]), "cut": pa.array([x.tobytes() for x in parts], pa.binary())}
        )


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: the text of every document without its cut words."""
    for batch in slices(batches, "text", SLICE_BYTES):
        cuts = batch.column("cuts").to_pylist()
        texts = batch.column("text").to_pylist()
        kept, n_words, n_removed = [], [], []
        for text, cut in zip(texts, cuts, strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            gone = 0
            if cut:
                own = Slice([0], [text])
                hit = own.windows[np.isin(own.named(own.windows, own.windows + WINDOW), np.frombuffer(b"".join(cut), np.uint64))]
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + WINDOW, -1)
                covered = np.cumsum(edge[:-1]) > 0
                gone = int(covered.sum())
                n_words.append(len(words))
                words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
            else:
                n_words.append(len(words))
            n_removed.append(gone)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"), "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()),
            }
        )


def _binary(columns: list[str]) -> str:
    return "bucket int, " + ", ".join(f"{m}{c} binary" for m in ("", "told_") for c in [*columns, "docs"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the words left, joined by one space) for every document."""
    parts = partitions(docs.sparkSession)
    buckets = parts * SPREAD
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    offered = texts.mapInArrow(_offer(buckets), _binary(["names"])).repartition(parts, "bucket")
    shared = offered.sortWithinPartitions("bucket").mapInArrow(_share, "id bigint, name bigint")
    shared = shared.groupBy("id").agg(F.collect_set("name").alias("names"))
    claimed = texts.join(shared, "id").mapInArrow(_claim(buckets), _binary(["low", "high"])).repartition(parts, "bucket")
    settled = claimed.sortWithinPartitions("bucket").mapInArrow(_settle, "id bigint, cut binary")
    cuts = settled.groupBy("id").agg(F.collect_list("cut").alias("cuts"))
    rest = texts.join(cuts, "id", "left").mapInArrow(_without, "id bigint, n_words bigint, n_removed bigint, kept string")
    return rest.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")
