"""Added spans of personal data, secret candidates and their features, and training samples, against brute force."""

import math
import random
import re

import regex

from dealscope.llm import pii, secret_scan, url_filter

# ---- personal data


def mod97(code):
    turned = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def brute_added(text):
    """Confirmed spans of the added kinds with their scores, those that touch a base span left out."""
    base = []
    for kind, pattern in {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            odd = sum(int(c) for c in digits[::-2])
            luhn = (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-1][::2])) % 10 == 0
            fits = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15,
            }
            if fits[kind]:
                base.append((m.start(), m.end()))
    out = []
    for kind, pattern in pii.ADDED.items():
        matches = list(regex.finditer(pattern, text))
        for n, m in enumerate(matches):
            if kind == "iban" and not mod97(m[0].replace(" ", "")):
                continue
            left = matches[n - 1].end() if n else 0
            right = matches[n + 1].start() if n + 1 < len(matches) else len(text)
            near = (text[max(left, m.start() - 40) : m.start()] + "\n" + text[m.end() : min(right, m.end() + 40)]).lower()
            word = lambda words: regex.search(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})", near) is not None  # noqa: B023, E731
            score = pii.PRIOR[kind] + (0.4 if kind == "iban" else 0) + 0.3 * word(pii.FOR[kind]) - 0.3 * word(pii.AGAINST)
            if round(score, 2) >= 0.5 and not any(a < m.end() and m.start() < b for a, b in base):
                out.append((kind, m.start(), m.end(), round(score, 2)))
    return sorted(out)


def test_added_spans_equal_brute_force(documents):
    draw = random.Random(12)
    pieces = [
        "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789", "000-45-6789",
        "123456789", "12345678901234567", "4539578763621486", "account", "konto", "Cuenta", "order", "page", "social security",
        "bank", "téléphone", " ", " ", ", ", "x", "é", "a@b.cc", "1.2.3.4", "\n", "the words between are many and say nothing at all",
    ]
    rows = [(i, "".join(draw.choice(pieces) + draw.choice([" ", "", ", "]) for _ in range(draw.randint(0, 14)))) for i in range(500)]
    rows += [(1000, "123456789 is my account"), (1001, "123456789 is the order"), (1002, None)]
    got = {r["doc_id"]: sorted((s["kind"], s["start"], s["end"], s["score"]) for s in r["added"]) for r in pii.spans(documents(rows)).collect()}
    want = {i: brute_added(t or "") for i, t in rows}
    assert got == want and sum(map(len, want.values())) > 150
    assert got[1000] and not got[1001]


# ---- secrets


def brute_candidates(text, trigrams):
    chars = "[A-Za-z0-9+/_-]"
    found = list(re.finditer(rf"(?<!{chars}){chars}{{16,}}", text))
    out = []
    for n, m in enumerate(found):
        v = m[0]
        left, right = (found[n - 1].end() if n else 0), (found[n + 1].start() if n + 1 < len(found) else len(text))
        before, after = text[max(left, m.start() - 24) : m.start()], text[m.end() : min(right, m.end() + 24)]
        kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
        share = [v.count(c) / len(v) for c in set(v)]
        names = lambda t: float(re.search(secret_scan.NAMES, t) is not None)
        features = {
            "length": len(v), "transitions": sum(kind(a) != kind(b) for a, b in zip(v, v[1:], strict=False)) / len(v),
            "digit_share": sum(c.isdigit() for c in v) / len(v), "upper_share": sum(c.isupper() for c in v) / len(v),
            "entropy": -sum(p * math.log2(p) for p in share),
            "coverage": sum(v.lower()[i : i + 3] in trigrams for i in range(len(v) - 2)) / len(v),
            "named": names(before), "named_after": names(after),
            "assigned": float(re.search(r"[=:]\s*[\"']?$", before) is not None), "quoted": float(before[-1:] in ("'", '"') and before != ""),
        }
        out.append((m.start(), v, features))
    return out


def test_candidates_and_features_equal_brute_force(documents):
    draw = random.Random(7)
    letters = "abcXYZ019+/_-"
    pieces = ["password = '", "token: ", "api_key=\"", "word ", "is the secret", ", ", ".", "é ", "\n", "internationalization "]
    value = lambda: "".join(draw.choice(letters) for _ in range(draw.choice([5, 15, 16, 40, 200])))
    rows = [(i, "".join(draw.choice(pieces) + draw.choice(["", value()]) + draw.choice(["", " ", "'"]) for _ in range(draw.randint(0, 9)))) for i in range(150)]
    rows += [(900, "aB3/" * 5_000), (901, None), (902, "internationalizations"), (903, "a" * 1_000 + "9" * 1_500)]
    trigrams = ["int", "nat", "ion", "abc"]
    got = {(r["doc_id"], r["start"]): r for r in secret_scan.candidates(documents(rows), trigrams).collect()}
    want = {(i, at): (v, f) for i, t in rows for at, v, f in brute_candidates(t or "", trigrams)}
    assert got.keys() == want.keys() and len(want) > 150
    for place, (v, features) in want.items():
        assert got[place]["value"] == v and got[place]["end"] == place[1] + len(v)
        for name, x in features.items():
            assert abs(got[place][name] - x) < 1e-9, (place, name, got[place][name], x)


def test_a_repeated_finding_does_not_fill_the_sample(documents):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(20))
    key = lambda: "".join(draw.choice("ABCdef0123456789/+") for _ in range(32))
    rows = [(i, "the same internationalizationword stands here") for i in range(600)]
    rows += [(1000 + i, f"plain {word()} text") for i in range(60)] + [(2000 + i, f"password = '{key()}'") for i in range(60)]
    found = secret_scan.candidates(documents(rows), [])
    known = found.withColumn("label", secret_scan.rule_label())
    model = secret_scan.train(known, rows=80)
    scored = {r["doc_id"]: r["score"] for r in secret_scan.scored(found, model).collect()}
    assert all(scored[2000 + i] > 0.5 for i in range(60)) and all(scored[1000 + i] < 0.5 for i in range(60)) and scored[0] < 0.5


def test_a_repeated_url_does_not_fill_the_sample(spark):
    rows = [(i, "https://good.example/a", 0) for i in range(3_000)] + [(5_000 + i, f"http://bad-{i}.example/x?id={i}&q=1", 1) for i in range(400)]
    rows += [(9_000 + i, f"https://good.example/page{i}", 0) for i in range(400)]
    labelled = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    model = url_filter.UrlModel(labelled, rows=300)
    judged = {r["page_id"]: r["blocked"] for r in model.blocked(url_filter.lexical(labelled.select("page_id", "url"))).collect()}
    assert 0 < model.rate < 1 and not judged[0]
    assert sum(judged[5_000 + i] for i in range(400)) > 360 and sum(judged[9_000 + i] for i in range(400)) < 40
