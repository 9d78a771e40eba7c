"""License scans, the filter audit and whitening against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.llm import filter_audit, license_scan, whitening

# ---- license scans


def plain_words(text):
    keep = lambda c: c.isascii() and c.isalnum() or ord(c) >= 0x80
    return "".join(c if keep(c) else " " for c in "".join(c.lower() if c.isascii() else c for c in text or "")).split(" ")


def base_places(text):
    ws = [w for w in plain_words(text) if w]
    found = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return ws, sorted(found)


def fewest_edits(notice, text):
    """The least edit distance of the notice to any piece of the text, by dynamic programming."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(notice, 1):
        new = np.empty_like(row)
        new[0] = i
        for j in range(1, len(text) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != text[j - 1]))
        row = new
    return int(row.min())


@pytest.fixture(scope="module")
def notice_rows():
    draw = random.Random(4)
    letters = "abcdefghij éü7"

    def spoiled(t, n):
        for _ in range(n):
            at = draw.randrange(len(t))
            t = draw.choice([t[:at] + t[at + 1 :], t[:at] + draw.choice(letters) + t[at:], t[:at] + draw.choice(letters) + t[at + 1 :]])
        return t

    filler = lambda: " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 8))) for _ in range(draw.randint(0, 12)))
    notices = list(license_scan.NOTICES)
    rows = []
    for i in range(160):
        notice = draw.choice(notices)
        rows.append((i, f"{filler()} {spoiled(notice, draw.randint(0, license_scan.errors_allowed(notice) + 2)).title()}, {filler()}"))
    pieces = ["MIT License", "mit-license", "submit license", "mit licenses", "Apache\nLICENSE", "GENERAL public license", ".", " ", "é", "mit"]
    rows += [(1000 + i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 12)))) for i in range(150)]
    return rows


def test_base_phrases_and_notices(documents, notice_rows):
    got = {r["doc_id"]: r for r in license_scan.licenses(documents(notice_rows)).collect()}
    assert len(got) == len(notice_rows)
    fuzzy = 0
    for i, text in notice_rows:
        ws, places = base_places(text)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(ws), len(places)), text
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        joined, want, best = " ".join(ws), {label for _, label in places}, [0.0, *(1.0 for _ in places)]
        for notice, label in license_scan.NOTICES.items():
            edits = fewest_edits(notice, joined) if joined else len(notice)
            if edits <= license_scan.errors_allowed(notice):
                want.add(label)
                best.append(1 - edits / len(notice))
                fuzzy += 0 < edits
        assert r["labels"] == ",".join(sorted(want)), text
        assert r["score"] == round(max(best), 9), text
    assert fuzzy > 60


def test_spans_of_repeated_notices(documents, odd):
    one, other = "licensed under the apache license version 2 0", "licenced under the apache licence version 20"
    rows = [(1, " x ".join([one, other] * 200)), (2, one * 3), (3, "released under the mit " * 3_000), (4, (one + " ") * 2_000)]
    got = {r["doc_id"]: r["spans"] for r in license_scan.license_spans(documents(rows)).collect()}
    fuzzy = {i: [s for s in found if not s["base"]] for i, found in got.items()}
    apache = [s for s in fuzzy[1] if s["label"] == "apache"]
    assert [s["edits"] for s in apache] == [0, 3] * 200
    assert [s["first_word"] for s in apache[:3]] == [0, 9, 17] and [s["last_word"] for s in apache[:3]] == [7, 15, 24]
    assert len([s for s in fuzzy[2] if s["label"] == "apache"]) == 3
    assert len([s for s in fuzzy[4] if s["label"] == "apache"]) == 2_000 and all(s["edits"] == 0 for s in fuzzy[4] if s["label"] == "apache")
    assert license_scan.licenses(odd).count() == odd.count() and license_scan.licenses(odd.where("false")).count() == 0
    assert license_scan.licenses(documents([(1, "my own notice stands heer")]), {"my own notice stands here": "own"}).first()["labels"] == "own"


def test_pieces_cover_the_notice():
    for notice in license_scan.NOTICES:
        cut = license_scan.pieces(notice, license_scan.errors_allowed(notice))
        assert "".join(p for _, p in cut) == notice and len(cut) == license_scan.errors_allowed(notice) + 1
        assert all(notice[a : a + len(p)] == p and len(p) > 5 for a, p in cut)


# ---- filter audit


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); every count by going through all documents in every order."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = {}
    for i, t, lang in rows:
        t = t or ""
        ws = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if w]
        caps = sum("A" <= c <= "Z" for c in t)
        bad = {
            "A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * caps > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": t in least and (i is None or i > least[t]),
        }
        docs.setdefault(lang or "", []).append(({f for f, b in bad.items() if b}, i in good, i in toxic))
    out = {}
    for part, found in docs.items():
        for order in itertools.permutations("ABCDE"):
            rest = found
            for k, f in enumerate(order):
                gone = [d for d in rest if f in d[0]]
                rest = [d for d in rest if f not in d[0]]
                failed = sum(f in d[0] for d in found)
                out[part, "".join(order), k + 1] = [
                    len(rest), len(gone), failed - len(gone), sum(d[0] == {f} for d in found),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
    for part in docs:
        for f in "ABCDE":
            own = [(p, o, k) for p, o, k in out if p == part and o[k - 1] == f]
            total = sum(out[x][1] for x in own)
            for x in own:
                out[x].append(total)
    return {k: tuple(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def audit_rows():
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["w%d" % draw.randrange(60), "A B", "#", "é", "Cap"]) for _ in range(draw.choice([3, 90, 130]))) for _ in range(50)]
    texts += [" ".join(f"word{j}" for j in range(120)), " ".join(f"word{j}" for j in range(99)), None, "", " \n"]
    rows = [(i, draw.choice(texts), draw.choice(["en", "de", None, "", "fr"])) for i in range(400)]
    rows += [(None, texts[0], "en"), (None, texts[50], "fr"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], "xx"), (8, texts[1], "en")]
    labels = [(draw.randrange(400), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    return rows, labels


def audit_tables(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    return docs.selectExpr("*", "1 AS bits", "2 AS part", "3 AS digest", "4 AS n_chars"), spark.createDataFrame(
        labels, "doc_id bigint, quality int, toxic int"
    ).selectExpr("*", "'x' AS id", "1 AS good")


def audited(spark, rows, labels):
    found = filter_audit.audit(*audit_tables(spark, rows, labels)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COUNTS) for r in found}
    assert len(got) == len(found)
    return got


@pytest.mark.parametrize("block", [50, 1 << 17])
def test_audit_equals_brute_force(spark, audit_rows, monkeypatch, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    assert audited(spark, *audit_rows) == brute_audit(*audit_rows)


def test_audit_of_nothing_and_of_repeated_rows(spark):
    assert audited(spark, [], []) == {}
    rows = [(5, "same row " * 60, "en")] * 30 + [(6, "same row " * 60, "en")] * 3
    assert audited(spark, rows, []) == brute_audit(rows, [])


@pytest.mark.parametrize("seed", range(20))
def test_sorted_lists_merge(seed):
    draw = np.random.default_rng(seed)
    a, b = (np.unique(draw.integers(0, 200, draw.choice([0, 1, 30, 300]))) for _ in range(2))
    assert filter_audit.without(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert filter_audit.union(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


# ---- whitening


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3).selectExpr("*", "'x' AS id", "1 AS vector", "2 AS n")


def brute_whitening(rows, dims):
    usable = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and len(v) == dims]
    x = np.array([np.floor(64 * v).astype(np.int64) + 1_000_000 for _, v in usable])
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    c = distinct - s / n
    values, directions = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in usable], x, n, s, values[::-1], directions[:, ::-1]


@pytest.mark.parametrize("dims,count", [(24, 400), (5, 60), (40, 30)])
def test_whitening(spark, dims, count):
    draw = np.random.default_rng(dims)
    data = (draw.standard_normal((count, dims)) * np.exp(-np.arange(dims) / 6)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000 + i, data[0].tolist()) for i in range(50)]
    rows += [(2000, None), (2001, [None] + [1.0] * (dims - 1)), (2002, [float("nan")] * dims), (2003, [1.0]), (2004, []), (None, data[1].tolist())]
    ids, x, n, s, values, directions = brute_whitening(rows, dims)
    rank = int((values > 1e-12 * values[0]).sum())
    k = min(16, rank)
    found = whitening.whiten(vectors_of(spark, rows)).toPandas()
    assert found.groupby("component").size().to_dict() == dict.fromkeys(range(1, k + 1), len(ids))
    assert set(found["n"]) == {n} and set(found.columns) >= {"vec_id", "explained"}
    assert found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9
    want = {i: int(((n * r - s).astype(object) ** 2).sum()) for i, r in zip(ids, x, strict=True)}
    assert {(None if i != i else int(i)): d for i, d in zip(found["vec_id"], found["deviation"], strict=True)} == want
    for c in range(k):
        own = found[found["component"] == c + 1]
        assert own["explained"].max() == pytest.approx(values[c] / values.sum(), rel=1e-9)
        brute = {i: v for i, v in zip(ids, (x - s / n) @ directions[:, c] / np.sqrt(values[c]), strict=True)}
        got = {(None if i != i else int(i)): v for i, v in zip(own["vec_id"], own["whitened"], strict=True)}
        sign = np.sign(got[0] * brute[0])
        assert max(abs(got[i] - sign * brute[i]) for i in brute) < 1e-6


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).count() == 0
    two = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1e30, 2.0]), (4, [1e30, 2.0])])).collect()
    assert {r["component"] for r in two} == {1} and len(two) == 4


def test_equal_eigenvalues(spark):
    rows = [(2 * i + k, [float(k * 2 - 1) if j == i else 0.0 for j in range(20)]) for i in range(20) for k in range(2)]
    found = whitening.whiten(vectors_of(spark, rows)).toPandas()
    assert found["identity_error"].max() < 1e-9 and found["component"].nunique() == 16
    assert found["explained"].max() == pytest.approx(1 / 20) and found["explained"].min() == pytest.approx(1 / 20)


@pytest.mark.parametrize("dims,wanted", [(64, 16), (150, 16), (16, 16), (3, 2), (30, 29)])
def test_jacobi_davidson_reaches_double_precision(dims, wanted):
    draw = np.random.default_rng(dims)
    x = draw.standard_normal((4 * dims, dims)) * np.exp(-np.arange(dims) / dims)
    a = x.T @ x / len(x)
    values, vectors, residuals = whitening.jacobi_davidson(lambda t: a @ t, dims, wanted)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:wanted], rtol=0, atol=1e-12 * values[0])
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-12
    assert residuals.max() <= 1e-11 * values[0]


def test_exact_deviations_beyond_64_bits():
    x = np.array([[2**40, -(2**40)], [1, 1]])
    floats, squares = whitening.deviations(x, 10**6, [5, 7])
    assert squares[0] is None and squares[1] == (10**6 - 5) ** 2 + (10**6 - 7) ** 2
    assert floats[1].tolist() == [10**6 - 5, 10**6 - 7]
