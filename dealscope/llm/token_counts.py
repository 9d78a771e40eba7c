"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

A text is split as the tokenizer splits it; each distinct word is relaxed once (``bpe.relax``), which gives
the number of tokens of each of its prefixes. The counts of a whole text are running sums over its words, so
the token count of any prefix, the longest prefix within a budget and whether a limit is passed are read off
without encoding again.

The prefix of a text may split otherwise than the text does: where it ends behind white space, inside a
contraction or inside the string of a special token. Those few places are counted by their own split.

Defined cases: a null text counts as empty; the string of a special token inside a text is that token;
repeated rows are counted one by one; very long words take as many steps as they have bytes; other columns
are passed on. Words met before are remembered per Python worker, up to a bound.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from dealscope.llm.bpe import Merges, relax
from dealscope.llm.common import slices

#: the published split of byte-level vocabularies, with white space as in the Unicode property
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CONTRACTIONS = ("'re", "'ve", "'ll")
BATCH_BYTES = 6_000_000
REMEMBERED = 400_000
PACKED = 8


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: itself if printable, else 256 onwards."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        stands = byte_symbols()
        raw = lambda t: "".join(chr(stands[c]) for c in t)  # noqa: E731  one character a byte
        tokens = [raw(t) for t in sorted(spec["model"]["vocab"], key=spec["model"]["vocab"].get)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(raw(x), raw(y)): i for i, (x, y) in enumerate(pairs)}
        self.merges = Merges(tokens, lambda x, y: ranks.get((x, y)))
        self.split, self.blank = regex.compile(SPLIT), regex.compile(r"\p{White_Space}*")
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        by_size: dict[int, list[tuple[int, int]]] = {}
        self.long: dict[str, int] = {}
        for i, t in enumerate(tokens):
            if self.merges.reachable(i):
                if len(t) <= PACKED:
                    by_size.setdefault(len(t), []).append((int.from_bytes(t.encode("latin-1"), "big"), i))
                else:
                    self.long[t] = i
        self.packed = {}
        for size, found in by_size.items():
            found.sort()
            self.packed[size] = np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found])
        heads: dict[int, set[int]] = {}
        for t in self.long:
            heads.setdefault(int.from_bytes(t[:PACKED].encode("latin-1"), "big"), set()).add(len(t))
        self.head_sizes = {k: sorted(v) for k, v in heads.items()}
        self.heads = np.array(sorted(heads), np.uint64)
        self.known: dict[str, int] = {}

    def edges(self, text: bytes, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and id of every token found in ``text`` inside one word."""
        data = np.frombuffer(text, np.uint8).astype(np.uint64)
        packed, at = np.zeros(len(data), np.uint64), np.arange(len(data))
        starts, sizes, ids = [], [], []
        for size in range(1, PACKED + 1):
            inside = at + size <= word_end[at]
            at, packed = at[inside], (packed[inside] << np.uint64(8)) | data[at[inside] + size - 1]
            keys, tokens = self.packed.get(size, (np.empty(0, np.uint64), np.empty(0, np.int64)))
            if not len(at) or not len(keys):
                continue
            found = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
            hit = keys[found] == packed
            starts.append(at[hit])
            sizes.append(np.full(int(hit.sum()), size))
            ids.append(tokens[found[hit]])
        if len(at) and len(self.heads):
            found = np.minimum(np.searchsorted(self.heads, packed), len(self.heads) - 1)
            hit = self.heads[found] == packed
            letters = text.decode("latin-1")
            more = [
                (s, n, self.long[letters[s : s + n]])
                for s, head, end in zip(at[hit].tolist(), packed[hit].tolist(), word_end[at[hit]].tolist(), strict=True)
                for n in self.head_sizes[head]
                if s + n <= end and letters[s : s + n] in self.long
            ]
            for column, values in zip((starts, sizes, ids), zip(*more, strict=True), strict=False):
                column.append(np.array(values))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, sizes, ids))

    def prefixes(self, words: list[str]) -> list[np.ndarray]:
        """For each word (without repeats) the token counts of its prefixes of 0, 1, ... bytes."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        first, _, count = relax(self.merges, lengths, *self.edges(b"".join(raw), np.repeat(np.cumsum(lengths), lengths)))
        return np.split(count, first[1:]) if len(words) else []

    def parts(self, text: str) -> list[str]:
        """The words of ``text``; special tokens are parts of their own."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        pieces = self.at_special.split(text)
        return list(chain.from_iterable([p] if i % 2 else self.split.findall(p) for i, p in enumerate(pieces)))

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.parts(t) for t in texts]
        new = list(set(chain.from_iterable(split)) - self.known.keys() - set(self.special))
        if new:
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            lengths = np.array([len(r) for r in raw], np.int64)
            ends = np.cumsum(lengths)
            first, _, count = relax(self.merges, lengths, *self.edges(b"".join(raw), np.repeat(ends, lengths)))
            self.known.update(zip(new, count[first + lengths].tolist(), strict=True))
        self.known.update(dict.fromkeys(self.special, 1))
        return [sum(map(self.known.__getitem__, words)) for words in split]

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token count of ``text[:p]`` for every p from 0 to its length."""
        counts = np.zeros(len(text) + 1, np.int64)
        parts = self.parts(text)
        words = list(dict.fromkeys(p for p in parts if p not in self.special))
        table = dict(zip(words, self.prefixes(words), strict=True))
        at = total = 0
        run_at, run_total = 0, 0  # where the white space before this part began, and the tokens up to there
        opened = 0  # where the text behind the last special token began
        opened_total = 0
        for part in parts:
            if part in self.special:
                for p in range(1, len(part)):
                    counts[at + p] = opened_total + self.count([text[opened : at + p]])[0]
                total += 1
                counts[at + len(part)] = total
                at += len(part)
                run_at, run_total, opened, opened_total = at, total, at, total
                continue
            own = table[part]
            ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in part])
            counts[at + 1 : at + 1 + len(part)] = total + own[ends]
            lead = self.blank.match(part).end()
            if lead and at > run_at:  # the prefix ends in a longer run of white space
                run = text[run_at : at + lead]
                by_byte = self.prefixes([run])[0]
                sizes = np.cumsum([len(c.encode("utf-8")) for c in run])
                counts[run_at + 1 : at + lead + 1] = run_total + by_byte[sizes]
            if part in CONTRACTIONS:
                counts[at + 2] = total + 2
            at += len(part)
            total += int(own[-1])
            if lead < len(part) or at == run_at + len(part):
                counts[at] = total
            if lead < len(part):
                run_at, run_total = at, total
        return counts


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def _extended(docs: DataFrame, *fields: StructField) -> StructType:
    return StructType([f for f in docs.schema.fields if f.name not in {x.name for x in fields}] + list(fields))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """All columns of ``docs`` but text, with n_bytes (UTF-8) and n_tokens."""
    fields = StructField("n_bytes", LongType()), StructField("n_tokens", LongType())
    schema = StructType([f for f in _extended(docs, *fields).fields if f.name != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            made = {"n_bytes": sizes, "n_tokens": pa.array(own.count(texts), pa.int64())}
            kept = {f.name: batch.column(f.name) for f in schema.fields if f.name not in made}
            yield pa.RecordBatch.from_pydict(kept | made)

    return docs.mapInArrow(run, schema)


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """All columns of ``docs`` with ``truncated``: the longest prefix of ``text`` within ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            cut = []
            for t in batch.column("text").to_pylist():
                fits = None if t is None else np.flatnonzero(own.prefix_counts(t) <= budget)
                cut.append(None if fits is None else t[: int(fits[-1])])
            kept = {n: batch.column(n) for n in batch.schema.names if n != "truncated"}
            yield pa.RecordBatch.from_pydict(kept | {"truncated": pa.array(cut, pa.string())})

    return docs.mapInArrow(run, _extended(docs, StructField("truncated", StringType())))
