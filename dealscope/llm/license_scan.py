"""License scans: fuzzy search for short notices by exact seeds and bounded-error verification.

A text's words (after A-Z is lower-cased, as everywhere in this folder) are joined by single spaces. A notice
of the list below may occur there with up to ``errors`` inserted, deleted or changed characters. It is cut into
errors + 1 pieces, and by the pigeonhole principle every such occurrence holds one piece unchanged. All pieces of
all notices are found in one pass over the text (an Aho-Corasick automaton); each hit gives a window in which the
notice may stand, windows that touch are joined, and there the regex library looks for the notice with at most
its errors, takes the best match and reports its words and edits. Joined windows are searched in bounded
stretches that overlap by a whole occurrence, so a text full of seeds costs no more than its length times the list.

The base phrases are places where their words stand consecutively, without errors, and come from the same pass.

The score is 1 if a phrase or notice stands unchanged, else 1 - edits / length of the best match, 0 without any.

Defined cases: a null text is empty and has no words; rows are judged one by one, so null ids, repeated rows and
equal ids need no rule; occurrences of different notices may overlap and each is reported, those of one notice
do not. Other columns are not read. Bytes that are not UTF-8 count as one unknown character each in notices. An
empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: phrase -> label, found without errors
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: notice -> label, found with one error for each ``LETTERS_AN_ERROR`` characters
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc",
    "boost software license version 1 0": "bsl",
    "spdx license identifier": "spdx",
}
LETTERS_AN_ERROR = 11
#: characters that one call of the regex library searches at most, beside the notice itself
STRETCH = 2_000
#: separators become spaces, A-Z small letters; digits, a-z and all bytes from 0x80 stay
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
SPAN = "array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,edits:int,base:boolean>>"


class Notice(NamedTuple):
    text: str
    label: str
    errors: int
    pattern: regex.Pattern


def errors_allowed(notice: str) -> int:
    return len(notice) // LETTERS_AN_ERROR


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their place in the notice."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """The automaton and patterns for one list of phrases and notices."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        self.phrases = phrases
        self.notices = [
            Notice(n, label, errors_allowed(n), regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={errors_allowed(n)}}}"))
            for n, label in notices.items()
        ]
        self.seeds: dict[str, list[tuple[int | None, int]]] = {}
        for p in phrases:
            self.seeds.setdefault(p, []).append((None, 0))
        for i, n in enumerate(self.notices):
            for at, piece in pieces(n.text, n.errors):
                self.seeds.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for seed in self.seeds:
            self.automaton.add_word(seed, seed)
        self.automaton.make_automaton()

    def windows(self, text: str) -> tuple[list[tuple[int, str]], dict[int, list[list[int]]]]:
        """Places of the phrases, and for each notice the joined windows where it may stand."""
        exact, found = [], {}
        size = len(text)
        for end, seed in self.automaton.iter(text):
            start = end + 1 - len(seed)
            for notice, at in self.seeds[seed]:
                if notice is None:
                    if (not start or text[start - 1] == " ") and (end + 1 == size or text[end + 1] == " "):
                        exact.append((start, seed))
                    continue
                n = self.notices[notice]
                found.setdefault(notice, []).append(
                    (max(0, start - at - n.errors), min(size, start - at + len(n.text) + n.errors))
                )
        joined = {}
        for notice, spans in found.items():
            out: list[list[int]] = []
            for a, b in sorted(spans):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            joined[notice] = out
        return exact, joined

    def matches(self, text: str, notice: Notice, windows: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        """start, end and edits of the notice's occurrences; each the best of the stretch that is left to search."""
        longest = len(notice.text) + notice.errors
        for begin, end in windows:
            at = begin
            while end - at >= len(notice.text) - notice.errors:
                stop = min(end, at + STRETCH + longest)
                hit = notice.pattern.search(text, at, stop)
                if hit is None:
                    if stop == end:
                        break
                    at = stop - longest
                    continue
                # occurrences before the best one of the stretch are found in what precedes it
                yield from self.matches(text, notice, [[at, hit.start()]])
                yield hit.start(), hit.end(), sum(hit.fuzzy_counts)
                at = hit.end()

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        """The number of words of a text, and its spans by their first word."""
        words = raw.translate(NORMAL).split()
        text = b" ".join(words).decode("utf-8", "replace")
        exact, windows = self.windows(text)
        spans = []
        for start, phrase in exact:
            spans.append((start, start + len(phrase), self.phrases[phrase], phrase, 0, True))
        for i, found in windows.items():
            n = self.notices[i]
            for start, end, edits in self.matches(text, n, found):
                if start < end:
                    spans.append((start, end, n.label, n.text, edits, False))
        out, word, seen = [], 0, 0
        for start, end, label, notice, edits, base in sorted(spans):
            start += text[start] == " "
            word, seen = word + text.count(" ", seen, start), start
            last = word + text.count(" ", start, max(start, end - (text[end - 1] == " ")))
            out.append({"label": label, "notice": notice, "first_word": word, "last_word": last, "edits": edits, "base": base})
        return len(words), out


@functools.cache
def scanner(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(dict(phrases), dict(notices))


def license_spans(docs: DataFrame, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words and spans (label, notice, first_word, last_word, edits, base) of every document."""
    lists = tuple((PHRASES if phrases is None else phrases).items()), tuple((NOTICES if notices is None else notices).items())
    span_type = pa.list_(
        pa.struct(
            {
                "label": pa.string(), "notice": pa.string(), "first_word": pa.int64(), "last_word": pa.int64(),
                "edits": pa.int32(), "base": pa.bool_(),
            }
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(*lists)
        for batch in batches:
            found = [own.scan(raw.as_py()) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array([n for n, _ in found], pa.int64()),
                    "spans": pa.array([s for _, s in found], span_type),
                }
            )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, spans {SPAN}")


def licenses(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels (base ones, and all) and the score."""
    found = license_spans(docs, notices).withColumn("base", F.filter("spans", lambda s: s["base"]))
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    likeness = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda s: s["first_word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda s: s["first_word"])).alias("last_word"),
        listed(F.col("base")).alias("base_labels"), listed(F.col("spans")).alias("labels"),
        F.round(F.coalesce(F.array_max(likeness), F.lit(0.0)), 9).alias("score"), "spans",
    )
