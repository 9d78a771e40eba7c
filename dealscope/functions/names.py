"""Column-name rules. They run on the driver over column names only."""

from __future__ import annotations

import re

from dealscope import fixed_values as fv


def _has(name: str, words, strict: bool = False) -> bool:
    if strict:
        tokens = name.split("_")
        return any(w in tokens or ("_" in w and w in name) for w in words)
    return any(w in name for w in words)


def is_currency_name(name: str, strict: bool = False) -> bool:
    """A currency keyword inside the name (as a whole token when ``strict``)."""
    return _has(name.lower(), fv.CURRENCY_NAMES, strict)


def is_percentage_name(name: str, strict: bool = False) -> bool:
    return _has(name.lower(), fv.PERCENTAGE_NAMES, strict)


def is_email_name(name: str, strict: bool = False) -> bool:
    return _has(name.lower(), fv.EMAIL_HINTS, strict)


def is_phone_name(name: str, strict: bool = False) -> bool:
    return _has(name.lower(), fv.PHONE_HINTS, strict)


def is_id_name(name: str) -> bool:
    n = name.lower()
    return n.endswith(fv.ID_SUFFIXES) or n.startswith(fv.ID_PREFIXES) or n in fv.ID_EXACT


def profile_type(name: str, kind: str) -> str | None:
    """Type by name for the profiler; None means "by distinct count"."""
    n = name.lower()
    if kind == "date":
        return "date"
    if kind == "boolean":
        return "categorical"
    if kind == "number":
        if is_currency_name(n):
            return "currency"
        return "identifier" if _has(n, fv.PROFILE_ID_HINTS) else "numeric"
    if is_email_name(n):
        return "email"
    if is_phone_name(n):
        return "phone"
    return "identifier" if _has(n, fv.PROFILE_ID_HINTS) else None


_KEY = re.compile(
    "(?:{})?(?P<core>.*?)(?:{})?".format("|".join(map(re.escape, fv.KEY_PREFIXES)), "|".join(map(re.escape, fv.KEY_SUFFIXES)))
)


def bare_key(name: str) -> str:
    """The words of a name between one key prefix and one key suffix, set apart by blanks."""
    core = _KEY.fullmatch(name.strip().lower())["core"]
    return core.translate(str.maketrans("_-", "  ")).strip()


def _in_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word of matches per character of ``b``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & every
    return len(a) - open_.bit_count()


def name_similarity(a: str, b: str) -> float:
    """Share of characters in common order between the bare keys; 0.95 if those agree, 1 if the names do."""
    first, second = bare_key(a), bare_key(b)
    if first != second:
        return 2.0 * _in_common(first, second) / (len(first) + len(second))
    return 1.0 if a.casefold() == b.casefold() else 0.95
