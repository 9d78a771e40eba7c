"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are found as leftmost non-overlapping matches of their pattern, kind by kind, and a match that fails
its check (parts of an address at most 255, Luhn with 14 to 19 digits, 10 to 15 digits of a phone number) is
dropped without another try. The method adds the kinds ``iban`` (mod 97), ``ssn`` (number groups) and
``account`` (runs of 8 to 17 digits); a span of an added kind is reported if its score reaches ``REPORT``.
A score starts at the kind's prior, gains for a passed checksum and for a context word within ``CONTEXT`` code points on
either side (up to the neighbouring matches of its pattern), and loses for a word that tells of something else. Base
spans stay whatever their score.

A pattern's matches are taken with the pieces of text between them, so that positions follow from lengths. The
patterns are possessive and begin a run of their characters only at its start or where the last match ended,
so a long run without a match is passed once.

Defined cases: a null text is empty; positions are code points, end exclusive; equal texts give equal spans;
rows are judged one by one, so repeated rows and null ids need no rule. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import located

_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: kind -> pattern, in the order in which equal starts are listed
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "account": r"(?<![0-9.-])[0-9]{8,17}(?![0-9.-])",
}
#: a cheap sign that a text may hold a kind at all
SIGN = {
    "email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]{3}-[0-9]{2}-", "account": "[0-9]{8}",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.5, "account": 0.2}
CHECKSUM_GAIN, CONTEXT_GAIN, CONTEXT_LOSS, REPORT = 0.4, 0.3, 0.3, 0.5
CONTEXT = 40
#: fixed values: words that speak for and against a kind, in the languages of the corpus
FOR = {
    "email": "e-?mail|contact|write|kontakt|correo|courriel", "ip": "ip|address|host|server|adresse|servidor|serveur",
    "card": "card|visa|credit|payment|karte|tarjeta|carte", "phone": "phone|call|tel|mobile|fax|telefon|tel[ée]fono|t[ée]l[ée]phone",
    "iban": "iban|bank|account|transfer|konto|cuenta|compte|banque|banco", "ssn": "ssn|social|security",
    "account": "account|konto|cuenta|compte|bank|banque|banco",
}
AGAINST = "version|order|invoice|isbn|serial|page|rechnung|seite|factura|p[áa]gina|facture"

#: zeros may lead; the last of them is given back where nothing else stands
_AT_MOST_255 = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, size - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code without spaces leaves 1 modulo 97, its first four characters moved behind."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (F.when(value > 9, rest * 100).otherwise(rest * 10) + value) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_AT_MOST_255}(?:\.{_AT_MOST_255}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _score(kind: str, before: Column, after: Column) -> Column:
    near = F.lower(F.concat(F.substring(before, -CONTEXT, CONTEXT), F.lit("\n"), F.substring(after, 1, CONTEXT)))
    checked = CHECKSUM_GAIN if kind in ("card", "iban") else 0.0
    gain = F.when(near.rlike(rf"(?<!\p{{L}})(?:{FOR[kind]})(?!\p{{L}})"), CONTEXT_GAIN).otherwise(0.0)
    loss = F.when(near.rlike(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})"), CONTEXT_LOSS).otherwise(0.0)
    return F.round(F.lit(PRIOR[kind] + checked) + gain - loss, 2)


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,score:double>>"


def _spans(kind: str, rank: int, pattern: str) -> Column:
    """The confirmed spans of one kind in ``text``."""

    found = located(F.col("text"), pattern, lambda match: _confirmed(kind, match))
    spans = F.transform(
        found,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (s["start"] + F.length(s["match"])).alias("end"), _score(kind, s["before"], s["after"]).alias("score"),
        ),
    ).cast(_SPAN)
    return F.when(F.col("text").rlike(SIGN[kind]), spans).otherwise(F.array().cast(_SPAN))


def _found(texts: DataFrame) -> DataFrame:
    """All columns of ``texts`` with ``base`` and ``added``."""
    base = [_spans(kind, rank, p) for rank, (kind, p) in enumerate(BASE.items())]
    added = [_spans(kind, len(BASE) + rank, p) for rank, (kind, p) in enumerate(ADDED.items())]
    found = texts.select("*", F.concat(*base).alias("base"), F.concat(*added).alias("added"))
    # an added span that touches a base span tells nothing new
    free = F.filter(
        "added",
        lambda a: (a["score"] >= REPORT) & ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])),
    )
    return found.withColumn("added", free)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``added``: arrays of (start, rank, kind, end, score), each kind in order of its matches."""
    return _found(_texts(docs)).drop("text")


def listed(found: Column) -> Column:
    """kind:start:end of each span by start, then kind in the order above, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.sort_array(found), one), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def masked(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every span's characters replaced by its kind in brackets."""
    found = _found(_texts(docs)).select("doc_id", "text", F.sort_array(F.concat("base", "added")).alias("all"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        piece = F.concat(F.substring("text", state["at"] + 1, s["start"] - state["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.when(fresh, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    tail = lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text")))
    return found.select("doc_id", F.aggregate("all", zero, cut, tail).alias("text"))
