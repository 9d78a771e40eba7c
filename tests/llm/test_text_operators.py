"""The text operators against brute force on small tables, odd rows included."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealscope.llm import decontamination, line_dedup, ngram_join, pii, quality_rules, secret_scan, substring_dedup, url_filter
from dealscope.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def phrase(draw, n, vocabulary=9):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed_rows():
    """Texts that share passages, copies and near-copies, lines and runs of one word."""
    draw = random.Random(8)
    passages = [phrase(draw, 20, 40) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [draw.choice([phrase(draw, draw.randrange(1, 30), 40), draw.choice(passages), "b " * 30]) for _ in range(draw.randrange(1, 6))]
        rows.append((i, draw.choice([" ", "\n", " \n\n"]).join(parts), f"host{i % 5}"))
    rows += [(100 + i, rows[i][1], "host1") for i in range(0, 20, 2)]
    rows += [(200 + i, rows[i][1] + " tail", "host2") for i in range(0, 20, 3)]
    draw.shuffle(rows)
    return rows


def removed_words(rows):
    first = {}
    split = {i: WORD.findall(t or "") for i, t in rows}
    for i, ws in split.items():
        for p in range(len(ws) - 12):
            key = tuple(ws[p : p + 13])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, ws in split.items():
        gone = {q for p in range(len(ws) - 12) if first[tuple(ws[p : p + 13])] < i for q in range(p, p + 13)}
        out[i] = (len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone))
    return out


def test_substrings(documents, mixed_rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(documents(mixed_rows)).collect()}
    assert got == removed_words([r[:2] for r in mixed_rows])


@pytest.mark.parametrize("seed", range(3))
def test_equal_windows_have_equal_anchors(seed):
    """The interior symbols of a window do not depend on what surrounds it."""
    draw = random.Random(seed)
    texts = [phrase(draw, 400, 2 + 3 * seed) for _ in range(6)]
    own = substring_dedup.Slice(list(range(6)), texts)
    flat = [w for ws in own.words for w in ws]
    anchors = {}
    for at, name in zip(own.windows.tolist(), own.anchors().tolist(), strict=True):
        assert anchors.setdefault(tuple(flat[at : at + 13]), name) == name


def test_substrings_of_odd_rows(odd):
    rows = substring_dedup.dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    by = {(r["doc_id"], r["kept"]): r for r in rows}
    assert by[(8, "x" * 20_000)]["n_removed"] == 0 and by[(9, " ".join(["a b"] * 8_000))]["n_removed"] == 0
    assert [r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert substring_dedup.dedup_substrings(odd.where("false")).count() == 0


def test_null_id_is_the_largest(documents):
    text = phrase(random.Random(1), 30, 50)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(documents([(None, text), (2**62, text)])).collect()}
    assert got == {None: 30, 2**62: 0}


def shingle_set(text):
    ws = WORD.findall(text or "")
    return frozenset(" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_links(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    links = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b), links[b].add(a)
    group = {}
    for i in sorted(sets):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in group:
                group[j] = i
                todo += links[j]
    same = {i: min([j for j in links[i] if sets[j] == sets[i]] + [i]) for i in sets}
    return {i: (same[i], group[i], len(links[i])) for i in sets}


def near_copies(n, seed=2):
    draw = random.Random(seed)
    base = phrase(draw, 300, 5_000).split()
    rows = []
    for i in range(n):
        ws = list(base)
        for _ in range(draw.randrange(0, 9)):
            ws[draw.randrange(len(ws))] = f"new{draw.randrange(99)}"
        rows.append((i, " ".join(ws)))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_links(documents, mixed_rows, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", block)
    rows = [r[:2] for r in mixed_rows] + [(1000 + i, t) for i, t in near_copies(25)]
    found = ngram_join.linked(documents(rows)).collect()
    assert {r["doc_id"]: (r["class_id"], r["group_id"], r["n_links"]) for r in found} == brute_links(rows)


def test_links_of_odd_rows(odd):
    found = ngram_join.linked(odd).collect()
    assert len(found) == odd.count()
    assert [r["n_links"] for r in found if r["doc_id"] == 5] == [1, 1]
    assert {r["n_links"] for r in found if r["doc_id"] != 5} == {0}
    kept = ngram_join.first_of_each_group(odd)
    assert kept.count() == odd.count() - 1 and kept.columns == odd.columns
    assert ngram_join.linked(odd.where("false")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """The rule drops a pair of similarity 0.8 with a probability far below one in a thousand."""
    draw = np.random.default_rng(5)
    kept = 0
    for _ in range(2_000):
        same = draw.random(60) < 0.8
        a, b = np.zeros((1, 60), np.uint32), np.where(same, 0, 1).astype(np.uint32)[None]
        kept += len(ngram_join.survivors(a, b)[0])
    assert kept >= 1_999


def test_components(spark):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(50, 50 + k) for k in range(1, 30)] + [(90 + draw.randrange(9), 90 + draw.randrange(9)) for _ in range(6)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(50, 80)} == {50}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_lines(rows):
    """rows: (doc_id, text) in order."""
    first, windows = {}, []
    for i, text in sorted(rows):
        lines = text.split("\n")
        full = [p for p, line in enumerate(lines) if WORD.search(line)]
        for n in range(len(full) - 2):
            key = tuple(lines[p] for p in full[n : n + 3])
            windows.append((i, n, key, full[n : n + 3]))
            first.setdefault(key, (i, n))
    gone = {}
    for i, n, key, at in windows:
        doc, nth = first[key]
        if (doc, nth) != (i, n):
            skip = max(0, nth + 3 - n) if doc == i else 0
            gone.setdefault(i, set()).update(at[skip:])
    return {i: "\n".join(line for p, line in enumerate(t.split("\n")) if p not in gone.get(i, ())) for i, t in rows}


def test_lines(documents):
    draw = random.Random(6)
    rows = [(i, "\n".join(draw.choice(["a", "b", "c", "", " ", "dd"]) for _ in range(draw.randrange(1, 25)))) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_odd_rows(odd):
    cut = line_dedup.dedup_lines(odd)
    assert cut.columns[: len(odd.columns)] == odd.columns
    same = [(r["doc_id"], r["text"]) for r in cut.collect()]
    assert sorted(map(str, same)) == sorted(str((r["doc_id"], r["text"])) for r in odd.collect())
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


LOWER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(docs, items):
    lower = lambda t: LOWER.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item, text in items:
        ws = lower(text)
        k = min(13, len(ws))
        for p in range(len(ws) - k + 1 if k else 0):
            grams.setdefault(tuple(ws[p : p + k]), set()).add(str(item))
    out = []
    for i, text in docs:
        ws, hit, found = lower(text), set(), set()
        for k in {len(g) for g in grams}:
            for p in range(len(ws) - k + 1):
                if (g := tuple(ws[p : p + k])) in grams:
                    hit |= set(range(p, p + k))
                    found |= grams[g]
        out.append((i, len(ws), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def test_contamination(spark, documents, mixed_rows):
    draw = random.Random(3)
    items = [(i, r[1][: draw.randrange(10, 200)].upper()) for i, r in enumerate(mixed_rows[:12])]
    items += [(50, "Short Item"), (51, "É é"), (52, None), (53, "..."), (54, "short item"), (None, phrase(draw, 15, 40))]
    docs = [r[:2] for r in mixed_rows] + [(900, "a short ITEM and É é, É É"), (901, None), (902, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(documents(docs), bench).collect()
    flat = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in got]
    want = [(i, n, h, [x for x in f if x != "None"], c) for i, n, h, f, c in brute_hits(docs, items)]
    assert sorted(flat, key=str) == sorted(want, key=str)
    clean = decontamination.without_contaminated(documents(docs), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(w[0] for w in want if not w[4])


def test_contamination_without_broadcast(spark, documents, mixed_rows, monkeypatch):
    bench = spark.createDataFrame([(1, mixed_rows[0][1]), (2, "x y")], "item_id bigint, text string")
    want = decontamination.contamination(documents(mixed_rows), bench).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_GRAMS", 0)
    assert sorted(want) == sorted(decontamination.contamination(documents(mixed_rows), bench).collect())
    assert decontamination.contamination(documents(mixed_rows), bench.where("false")).where("n_hit > 0").count() == 0


def test_many_ngrams_and_a_long_text(spark, documents, monkeypatch):
    """Both ways agree on 20,001 n-grams, one of them held by 2,000 items, and a text of 20,000 words."""
    draw = random.Random(11)
    long = " ".join(f"w{draw.randrange(3_000)}" for _ in range(20_000))
    ws = long.split()
    items = [(i, " ".join(ws[10 * i : 10 * i + 22])) for i in range(1_990)]
    items += [(10_000 + i, " ".join(f"q{i}x{j}" for j in range(14))) for i in range(50)] + [(20_000 + i, "one shared item") for i in range(2_000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, long), (2, "here is One Shared Item again"), (3, "nothing of it"), (4, "One shared one shared item")]
    got = sorted(decontamination.contamination(documents(rows), bench).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect())
    assert [(r["doc_id"], r["n_words"]) for r in got] == [(1, 20_000), (2, 6), (3, 3), (4, 5)]
    assert got[0]["n_hit"] == len({p for i in range(1_990) for p in range(10 * i, min(10 * i + 22, 20_000))}) and len(got[0]["items"]) == 1_990
    assert [len(r["items"]) for r in got[1:]] == [2_000, 0, 2_000] and [r["n_hit"] for r in got[1:]] == [3, 0, 3]
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 1_000)
    again = decontamination.contamination(documents(rows), bench).select("doc_id", "n_words", "n_hit", "items", "contaminated")
    assert sorted(again.collect()) == got


def test_spans_are_cut(spark, documents):
    passage = " ".join(f"p{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    rows = decontamination.without_spans(documents([(1, f"before {passage} after"), (2, "Nothing here")]), bench)
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == {1: "before after", 2: "nothing here"}


def test_contamination_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "same row twice"), (2, None)], "item_id bigint, text string")
    got = decontamination.contamination(odd, bench).collect()
    assert len(got) == odd.count() and [r["n_hit"] for r in got if r["doc_id"] == 5] == [3, 3]
    none = bench.where("false")
    assert {r["n_hit"] for r in decontamination.contamination(odd, none).collect()} == {0}
    assert decontamination.contamination(odd.where("false"), bench).count() == 0


def brute_measures(text):
    ws = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    where = {}
    for p in range(len(ws) - 4):
        where.setdefault(tuple(ws[p : p + 5]), []).append(p)
    twice = {q for ps in where.values() if len(ps) > 1 for p in ps for q in range(p, p + 5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(twice)


def test_measures(documents, mixed_rows, odd):
    for docs in (documents([(i, t + " #$ <é>") for i, t, _ in mixed_rows]), odd):
        rows = quality_rules.text_measures(docs).collect()
        texts = sorted(((r["doc_id"], brute_measures(r["text"])) for r in docs.select("doc_id", "text").collect()), key=str)
        got = [(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in rows]
        assert sorted(got, key=str) == texts


def test_a_failing_host_loses_its_documents(documents):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "too short", "bad") for i in range(60)] + [(100, good, "bad"), (101, good, None)]
    rows += [(200 + i, good, f"host{i % 9}") for i in range(60)] + [(300, "short", "host1")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents(rows)).collect()}
    assert not kept[100] and kept[101] and all(kept[200 + i] for i in range(60)) and not kept[300]


def test_one_bad_document_does_not_condemn_a_small_host(documents):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good, f"host{i % 9}") for i in range(90)] + [(500, "bad", "small"), (501, good, "small")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(documents(rows)).collect()}
    assert kept[501] and not kept[500]


def test_rules_of_empty_table(odd):
    assert quality_rules.judge(odd.where("false")).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda m=m: True, "ip": lambda m=m: all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]()
            if fits:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def test_base_spans(documents, odd):
    draw = random.Random(5)
    pieces = [
        "a@b.cc", "_x@d.ee", "@", ".", "1.2.3.4", "300.1.1.1", "0255.1.1.1", "10.0.0.1", "0.0.0.0", "1.0.0.0", "00.0.00.1", "127.0.0.256", "4539578763621486", "4539 5787 6362 1486",
        "+1 (212) 555-8457", "+49", "-", " ", "  ", "é", "\U0001F600", "x", "12", "9", "+", "\n", "(", ")", "a.b@c-d.e.f",
    ]
    rows = [(i, "".join(draw.choice(pieces) for _ in range(draw.randint(0, 25)))) for i in range(800)]
    rows += [(9000, "a.b@" * 3_000), (9001, "1.2." * 3_000), (9002, "1" * 30_000), (9003, "a@" + ".a" * 20_000), (9004, None), (9005, "0" * 3_000 + ".1.1.1 " + "0" * 3_000)]
    rows += [(9100 + i, t) for i, t in enumerate("10.0.0.1 127.0.0.1 0.0.0.0 192.168.1.20 008.8.8.8 1.0.0.0 00.0.00.1 0.0.0.256".split())]
    got = {r["doc_id"]: r["base"] for r in pii.spans(documents(rows)).select("doc_id", pii.listed(F.col("base")).alias("base")).collect()}
    assert got == {i: brute_spans(t) for i, t in rows}
    assert pii.spans(odd).count() == odd.count() and pii.spans(odd.where("false")).count() == 0


def test_added_spans_need_checksum_or_context(documents):
    rows = [
        (1, "iban GB82 WEST 1234 5698 7654 32 please"), (2, "code GB83 WEST 1234 5698 7654 32 here"),
        (3, "my account 123456789"), (4, "order page 123456789"), (5, "social security 123-45-6789"),
    ]
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in pii.spans(documents(rows)).collect()}
    assert got[1] == ["iban"] and got[2] == [] and got[3] == ["account"] and got[4] == [] and got[5] == ["ssn"]
    masked = {r["doc_id"]: r["text"] for r in pii.masked(documents(rows)).collect()}
    assert masked[3] == "my account [account]" and masked[4] == rows[3][1]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "https://A.ORG/x", "http://org/", "http://org", "http://xorg/", "http://a.org?x=/", "http://b.example.org/es/1",
        "http://example.org/es", "http://example.org/en/12#/a", "http://x.com/fr/?a=1&b=2", "http://x.com/de/a", "ftp://x.net:80/a-b", "http://x.com/de/a",
        "a://b://c.org/", "http://É.org/é", "http://" + "a" * 5_000 + ".com/" + "1/" * 2_000, "http://a.net/\n/x",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("label", F.lit(1))
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    actions = {r: a for a, r in url_filter.RULES}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule = brute_rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and (rule is None or got[i]["verdict"] == actions[rule])
    assert url_filter.judge(pages.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages.where("page_id < 4")).collect()} == {"allow"}


def test_url_trees_learn_from_labels(spark):
    draw = random.Random(2)
    rows = []
    for i in range(600):
        bad = i % 2
        path = "-".join(str(draw.randrange(10**6)) for _ in range(4)) if bad else draw.choice(["news", "about", "help"])
        rows.append((i, f"http://site{draw.randrange(30)}.test/{path}" + "?a=1&b=2&c=3" * bad, bad))
    labelled = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    model = url_filter.UrlModel(labelled.where("page_id < 400"))
    held = model.blocked(url_filter.lexical(labelled.where("page_id >= 400"), F.col("label"))).collect()
    assert sum(r["blocked"] == (r["label"] == 1) for r in held) >= 0.95 * len(held)


def test_secrets(documents):
    draw = random.Random(9)
    rows = []
    for i in range(300):
        key = "".join(draw.choice("0123456789abcdef") for _ in range(40))
        word = "".join(draw.choice(["tion", "the", "ing", "and"]) for _ in range(6))
        plain = " ".join(draw.choice(["nothing", "thetion", "anding", "here"]) for _ in range(30))
        rows.append((i, f"{plain} password={key} {word} {plain}" if i % 2 else f"{plain} {word} {plain}"))
    rows += [(1000, f"bare {'0123456789abcdef' * 2} text"), (1001, None), (1002, "")]
    found = secret_scan.scan(documents(rows)).collect()
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in found)
    keys = [r for r in found if r["doc_id"] < 1000 and len(r["value"]) == 40]
    others = [r for r in found if r["doc_id"] < 1000 and len(r["value"]) != 40]
    assert len(keys) == 150 and all(r["secret"] for r in keys)
    assert others and not any(r["secret"] for r in others)


def test_secrets_of_odd_rows(odd):
    found = secret_scan.scan(odd).collect()
    assert [(r["doc_id"], r["end"]) for r in found] == [(8, 20_000)]
    assert secret_scan.scan(odd.where("false")).count() == 0
