"""The pipeline against a brute-force version of its five stages, and the registered queries."""

import statistics

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_text_operators import brute_hits, brute_lines, brute_links, brute_measures  # noqa: E402

import __spark_entry__  # noqa: E402
from dealscope.llm import line_dedup, quality_rules  # noqa: E402
from dealscope.llm.queries import PIECES, QUERIES, vocabulary  # noqa: E402
from tools.compare import compare, connect  # noqa: E402


def brute_quality(rows):
    """rows: doc_id -> (text, host); the ids that stay."""
    hosts, failed = {}, {}
    for i, (text, host) in rows.items():
        n, chars, symbols, dup, repeated = brute_measures(text)
        lines = sum(bool(line.strip(" \t\n\r\x0b\x0c")) for line in text.split("\n"))
        failed[i] = n < 10 or 100 * repeated > 20 * n
        bad = failed[i] or 100 * symbols > 10 * chars or 100 * dup > 30 * lines
        hosts.setdefault(host, []).append(bad)
    rates = [sum(b) / len(b) for b in hosts.values()]
    m, v = statistics.mean(rates), statistics.variance(rates)
    s = max(1.0, m * (1 - m) / v - 1) if v else statistics.mean(map(len, hosts.values()))
    shrunk = {h: (sum(b) + m * s) / (len(b) + s) for h, b in hosts.items()}
    return [i for i, (_, host) in rows.items() if not failed[i] and shrunk[host] <= quality_rules.HOST_LIMIT]


def test_stages_equal_brute_force(spark, sf):
    import sentencepiece

    rows = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {i: rows[i][0] for i in brute_quality(rows)}
    cut = brute_lines(list(texts.items()))
    texts = {i: t for i, t in cut.items() if t == texts[i] or any(c not in " \t\n\r\x0b\x0c" for c in t)}
    links = brute_links(list(texts.items()))
    texts = {i: t for i, t in texts.items() if links[i][1] == i}
    texts = {i: texts[i] for i, *_, hit in brute_hits(list(texts.items()), items) if not hit}
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    want = {i: (t, len(t), library.encode(t)) for i, t in texts.items()}
    found = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"], r["token_ids"]) for r in found} == want
    assert len(found) == len(want) and all(r["round_trip"] for r in found)


def test_stages_keep_the_columns_of_documents(spark, sf, odd):
    docs = odd.withColumnRenamed("source", "host").selectExpr("*", "host AS source", "length(text) AS n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert kept.count() <= docs.count()
        assert stage(spark, docs.where("false"), sf).count() == 0


def test_a_text_cut_to_nothing_goes(spark, sf, documents):
    text = "first line here\nsecond line here\nthird line here"
    docs = documents([(1, text), (2, text), (3, "")]).selectExpr("*", "length(text) AS n_chars")
    kept = corpus_pipeline.lines(spark, docs, sf).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]
    assert line_dedup.dedup_lines(docs).count() == 3


def test_every_query_is_registered():
    known = __spark_entry__.queries()
    assert set(QUERIES) < set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, name):
    from types import SimpleNamespace

    sql = __spark_entry__.oracle_sql().get(name)
    status, *_, note = compare(spark, connect(sf), SimpleNamespace(name=name, plan=QUERIES[name], sql=sql), sf)
    assert status in ("ok", "ROWS"), note
