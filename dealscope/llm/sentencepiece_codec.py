"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch (runs of spaces and what follows them; no piece of the vocabulary goes on behind
a word) stand one after the other in one index text. Its suffixes are sorted, every piece of the vocabulary is
searched in them by bisection, and each suffix in a piece's range is an edge of the lattice. The edges are
sorted by position and relaxed (``bpe.relax``): the vocabulary is a merge vocabulary, so the edge that is taken
at a position is the one that keeps the merge order, not the one of the best summed score.

Defined cases: a null text encodes to null, an empty text to no ids. A character outside the vocabulary becomes
its UTF-8 bytes. The character U+2581 reads as a space, as in the library, and decodes to one. Very long words
take as many relaxing steps as they have characters. Repeated rows are encoded one by one; other columns are
passed on as they are. Words met before are remembered per Python worker, up to a bound.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from dealscope.llm.bpe import Merges, relax
from dealscope.llm.common import slices

SPACE = "▁"
#: bytes of text in one batch, and words that a worker remembers
BATCH_BYTES = 2_000_000
REMEMBERED = 200_000
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by the ``depth`` symbols from there on (prefix doubling)."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    seen = 1
    while True:
        later = np.zeros(len(rank), np.int64)
        if seen < len(rank):
            later[:-seen] = rank[seen:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key)
        if 2 * seen >= depth:
            return order
        ranked = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        seen *= 2


def ranges(text: np.ndarray, order: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (a row of code points, -1 behind its end) the range of suffixes that begin with it."""
    padded = np.concatenate([text, np.full(pieces.shape[1], -1, text.dtype)])

    def bisect(upper: bool) -> np.ndarray:
        low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
        while (low < high).any():
            active = np.flatnonzero(low < high)
            mid = (low[active] + high[active]) // 2
            at = order[mid]
            # the first symbol that differs decides; none: equal
            state = np.zeros(len(active), np.int8)
            for k in range(pieces.shape[1]):
                undecided = np.flatnonzero((state == 0) & (k < sizes[active]))
                if not len(undecided):
                    break
                a, b = padded[at[undecided] + k], pieces[active[undecided], k]
                state[undecided] = np.sign(a.astype(np.int64) - b)
            right = (state < 0) | ((state == 0) & upper)
            low[active] = np.where(right, mid + 1, low[active])
            high[active] = np.where(right, high[active], mid)
        return low

    return bisect(False), bisect(True)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        tokens = [model.id_to_piece(i) if plain[i] else None for i in range(n)]
        scores = {t: -model.get_score(i) for i, t in enumerate(tokens) if t}
        self.merges = Merges(tokens, lambda x, y: scores.get(x + y))
        used = [i for i in range(n) if tokens[i] and self.merges.reachable(i)]
        self.ids = np.array(used, np.int64)
        self.sizes = np.array([len(tokens[i]) for i in used], np.int64)
        self.pieces = np.full((len(used), int(self.sizes.max())), -1, np.int32)
        for row, i in enumerate(used):
            self.pieces[row, : self.sizes[row]] = [ord(c) for c in tokens[i]]
        self.single = np.sort(np.array([ord(tokens[i]) for i in used if len(tokens[i]) == 1], np.int32))
        self.unknown: dict[str, int] = {}
        self.spelled = {i: [i] for i in used}
        self.text = {i: tokens[i] for i in used}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def edges(self, text: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and token of every piece found in ``text`` that stays inside its word."""
        order = suffix_order(text, self.pieces.shape[1])
        low, high = ranges(text, order, self.pieces, self.sizes)
        found = high - low
        piece = np.repeat(np.arange(len(found)), found)
        start = order[np.repeat(low - np.cumsum(found) + found, found) + np.arange(len(piece))]
        inside = start + self.sizes[piece] <= word_end[start]
        start, piece = start[inside], piece[inside]
        sizes, ids = self.sizes[piece], self.ids[piece]
        odd = np.flatnonzero(~np.isin(text, self.single))
        if len(odd):
            for c in np.unique(text[odd]).tolist():
                if chr(c) not in self.unknown:
                    t = self.unknown[chr(c)] = self.merges.add(chr(c))
                    self.spelled[t] = [self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")]
            start = np.concatenate([start, odd])
            sizes = np.concatenate([sizes, np.ones(len(odd), np.int64)])
            ids = np.concatenate([ids, [self.unknown[chr(c)] for c in text[odd].tolist()]])
        return start, sizes, ids

    def learn(self, words: list[str]) -> None:
        """Encode words not met before and remember their ids."""
        lengths = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        ends = np.cumsum(lengths)
        first, last, count = relax(self.merges, lengths, *self.edges(text, np.repeat(ends, lengths)))
        node, left = first + lengths, np.arange(len(words))
        back: list[tuple[np.ndarray, np.ndarray]] = []
        token_size = np.array([len(t) if t else 0 for t in self.merges.tokens], np.int64)
        while len(left):  # from the last token of every word to its first
            tokens = last[node]
            back.append((left, tokens))
            node = node - token_size[tokens]
            more = node > first[left]
            node, left = node[more], left[more]
        word = np.concatenate([w for w, _ in back])
        tokens = np.concatenate([t for _, t in back])
        step = np.concatenate([np.full(len(w), -i) for i, (w, _) in enumerate(back)])
        order = np.lexsort((step, word))
        word, tokens = word[order], tokens[order]
        if (tokens >= token_size.size - len(self.unknown)).any():
            spelled = [self.spelled[t] for t in tokens.tolist()]
            word = np.repeat(word, [len(s) for s in spelled])
            tokens = np.array([i for s in spelled for i in s], np.int64)
        size = np.bincount(word, minlength=len(words))
        at = len(self.known)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, tokens.astype(np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(set(chain.from_iterable(split)) - self.known.keys())
        if new:
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        sizes = self.size[index]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.begin[index] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        per_text = np.cumsum([0, *(len(words) for words in split)])
        totals = np.concatenate([[0], ends])[per_text]
        return flat, np.diff(totals)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        if not hasattr(self, "raw"):
            self.raw = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | {b: bytes([k]) for k, b in enumerate(self.byte_ids)}
        text = b"".join([self.raw.get(i, b"") for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _more(schema: StructType, *fields: StructField) -> StructType:
    return StructType([f for f in schema.fields if f.name not in {x.name for x in fields}] + list(fields))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(kept | columns)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``token_ids`` and ``n_tokens`` of ``text`` (a column of that name is replaced).

    ``decoded`` adds the text that the ids decode to, worked out in the same pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").to_pylist()
            flat, sizes = own.encode(texts)
            missing = pa.array([t is None for t in texts])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=missing)
            made = {"token_ids": ids, "n_tokens": pa.array(sizes.astype(np.int64))}
            if decoded:
                parts = zip(texts, np.split(flat, offsets[1:-1]), strict=True)
                made["decoded"] = pa.array([None if t is None else own.decode(part.tolist()) for t, part in parts], pa.string())
            yield _with(batch, **made)

    fields = [StructField("token_ids", ArrayType(IntegerType())), StructField("n_tokens", LongType())]
    if decoded:
        fields.append(StructField("decoded", StringType()))
    return docs.mapInArrow(run, _more(docs.schema, *fields))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """All columns with ``decoded``: the text of ``token_ids``; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("token_ids").to_pylist()]
            yield _with(batch, decoded=pa.array(texts, pa.string()))

    return tokens.mapInArrow(run, _more(tokens.schema, StructField("decoded", StringType())))
