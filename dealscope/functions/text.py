"""Text expressions: words, chunks, intents, sections, links, character vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from dealscope import fixed_values as fv

WORD = r"([^\s\p{Z}]+)"
TOKEN = r"([\p{L}\p{N}_]+)"
EDGE = r"[^\p{L}\p{N}_]"


def words(text: Column) -> Column:
    """Blank-separated words."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of two distinct-token arrays, 0 if one is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    every = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / every)


def chunk_array(word_array: Column, size: int = fv.CHUNK_WORDS, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Overlapping chunks of words; an empty text has none."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.floor((F.size(word_array) - 1) / step).cast("int"))
    pieces = F.transform(
        starts, lambda i: F.array_join(F.slice(word_array, i * step + 1, F.lit(size)), " ")
    )
    return F.when(F.size(word_array) > 0, pieces).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def block_array(text: Column) -> Column:
    """Trimmed blocks between blank lines, empty ones removed."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda b: b != "")


def intent(question: Column) -> Column:
    """First intent with a keyword in the question, aggregation by default."""
    q, out = F.lower(question), None
    for name, keywords in fv.INTENT_KEYWORDS:
        hit = q.rlike(f"(^|{EDGE})({'|'.join(keywords)})($|{EDGE})")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("aggregation")


def recommendation_sections(text: Column) -> Column:
    """The text behind each section's heading, up to the next section.

    Headings carry a sign each; where no sign is followed by its label, the bare labels are the headings.
    """
    signs = [sign for _, _, sign in fv.RECOMMENDATION_SECTIONS]
    any_label = "(?i)" + "|".join(label for _, label, _ in fv.RECOMMENDATION_SECTIONS)

    def behind(heading: str, stop: str) -> Column:
        rest = F.get(F.split(text, rf"(?i){heading}\s*:?", 2), 1)
        return strip(F.coalesce(F.split(rest, stop, 2)[0], F.lit("")))

    signed, bare = [], []
    for _, label, sign in fv.RECOMMENDATION_SECTIONS:
        signed.append(behind(rf"{sign}\s*{label}", "|".join(s for s in signs if s != sign)))
        bare.append(behind(label, any_label))
    use_signs = F.concat(*signed) != ""
    fields = [
        F.when(text.isNotNull(), F.when(use_signs, x).otherwise(y)).alias(name)
        for (name, _, _), x, y in zip(fv.RECOMMENDATION_SECTIONS, signed, bare, strict=True)
    ]
    return F.struct(*fields)


RECOMMENDATION = "priority_action string, risk_flag string, opportunity string"
REVIEW = (
    "total_score int, dimension_scores map<string,int>, specific_feedback string, "
    "rewrite_instructions map<string,string>, highest_priority_fix string"
)


def recommendation_json(text: Column) -> Column:
    """Recommendation struct from JSON; bad JSON gives empty fields."""
    r = F.from_json(text, RECOMMENDATION)
    return F.struct(
        *[F.coalesce(r[n], F.lit("")).alias(n) for n in ("priority_action", "risk_flag", "opportunity")]
    )


def review_json(text: Column) -> Column:
    """Review struct from JSON with defaults; unreadable input scores 50, fix "code"."""
    r = F.from_json(text, REVIEW + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = r.isNull() | r["_bad"].isNotNull() | text.isNull()
    no_text = F.lit("Could not parse critic response")
    return F.struct(
        F.when(bad, 50).otherwise(F.coalesce(r["total_score"], F.lit(50))).alias("total_score"),
        F.when(bad, F.create_map().cast("map<string,int>"))
        .otherwise(F.coalesce(r["dimension_scores"], F.create_map().cast("map<string,int>")))
        .alias("dimension_scores"),
        F.when(bad, no_text).otherwise(F.coalesce(r["specific_feedback"], F.lit(""))).alias("specific_feedback"),
        F.when(bad, F.lit("code")).otherwise(F.coalesce(r["highest_priority_fix"], F.lit("code"))).alias("highest_priority_fix"),
    )


def code_block(text: Column) -> Column:
    """First fenced block, or the whole text, trimmed."""
    fenced = r"(?s)```(?:python)?\s*(.*?)```"
    return strip(F.when(text.rlike(fenced), F.regexp_extract(text, fenced, 1)).otherwise(text))


def unsafe_patterns(code: Column) -> Column:
    """The unsafe fragments a snippet contains, in list order."""
    listed = F.array(*[F.lit(p) for p in fv.UNSAFE_CODE])
    return F.filter(listed, lambda p: F.contains(code, p))


def slug(title: Column, length: int = 60) -> Column:
    """File-safe title."""
    return F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}_\-]", "_"), 1, length)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of the MD5."""
    return F.substring(F.md5(text), 1, 16)


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def character_vector(column: str, lowered: str, dims: int = fv.EMBEDDING_DIMS) -> Column:
    """X11: character frequencies, then MD5 bytes, zero-padded to ``dims``.

    ``lowered`` names a column with the lower-cased text, so it is built once and
    not once per character; the digest is over the text as given.
    """
    n = f"CAST(greatest(1, length({lowered})) AS DOUBLE)"
    parts = []
    for ch in fv.EMBEDDING_CHARS:
        parts.append(f"(length({lowered}) - length(replace({lowered}, '{ch}', ''))) / {n}")
    for i in range(16):
        parts.append(f"CAST(conv(substring(md5({column}), {2 * i + 1}, 2), 16, 10) AS DOUBLE) / 255D")
    parts += ["0D"] * (dims - len(parts))
    return F.expr(f"array({', '.join(parts[:dims])})")


_CHAR_CODES = np.frombuffer(fv.EMBEDDING_CHARS.encode(), dtype=np.uint8)
#: bytes of text counted at a time
_COUNT_BYTES = 4_000_000


def character_vectors_of(texts: pa.StringArray, digests: pa.BinaryArray) -> pa.Array:
    """X11 for one Arrow batch, from the texts and their MD5 digests; null texts have no vector.

    All counted characters are ASCII, and no byte of another UTF-8 character is, so one two-dimensional byte
    histogram (text by byte value) of the batch's buffer gives every count.
    """
    # the one character whose small form takes more than one
    low = pc.utf8_lower(pc.replace_substring(pc.fill_null(texts, ""), "\u0130", "i\u0307"))
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    out = np.zeros((len(low), fv.EMBEDDING_DIMS))
    begin = 0
    while begin < len(low):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - sizes[begin] + _COUNT_BYTES, "right")))
        part = np.frombuffer(b"".join(low[begin:end].cast(pa.binary()).to_pylist()), np.uint8)
        row = np.repeat(np.arange(end - begin), sizes[begin:end])
        counts = np.bincount(row * 256 + part, minlength=(end - begin) * 256).reshape(-1, 256)
        # every character has one byte that is no continuation
        length = counts.sum(axis=1) - counts[:, 0x80:0xC0].sum(axis=1)
        out[begin:end, : len(_CHAR_CODES)] = counts[:, _CHAR_CODES] / np.maximum(1, length)[:, None]
        begin = end
    known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
    digest = np.frombuffer(b"".join(digests.drop_null().to_pylist()), np.uint8).reshape(-1, 16)
    out[known, len(_CHAR_CODES) : len(_CHAR_CODES) + 16] = digest / 255.0
    offsets = np.arange(len(out) + 1, dtype=np.int32) * fv.EMBEDDING_DIMS
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(~known))
