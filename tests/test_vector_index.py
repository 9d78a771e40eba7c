"""The vector index against brute force, and what it leaves out."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.operators import corpus as cp
from dealscope.operators import vector_index as vi


def brute(asked, corpus, k, metric, limit=None):
    out = {}
    for q, v in asked:
        if v is None:
            continue
        rows = []
        for key, w in corpus:
            if w is None:
                continue
            a, b = np.array(v, float), np.array(w, float)
            if metric == "l2":
                d = float(((a - b) ** 2).sum())
            else:
                norms = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1 - float(a @ b) / norms if norms > 1e-9 else 1.0
            rows.append((round(d, 9) + 0.0, key))
        out[q] = [(key, d) for d, key in sorted(rows)[:k] if limit is None or d <= limit]
    return {q: r for q, r in out.items() if r}


def found(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r["question"], []).append((r["key"], r["distance"]))
    return {q: sorted(r, key=lambda x: (x[1], x[0])) for q, r in out.items()}


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [key for key, _ in got[q]] == [key for key, _ in want[q]], q
        assert [d for _, d in got[q]] == pytest.approx([d for _, d in want[q]], abs=2e-9)


@pytest.fixture(scope="module")
def clouds():
    """Clusters with copies, one of which holds a third of all rows."""
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((12, 8)) * 4
    rows = [(i, (centres[i % 12] + draw.standard_normal(8) * 0.2).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(250)] + [(2000, None)] + [(2001, [0.0] * 8), (2002, [0.0] * 8)]
    asked = [(f"a{i}", (centres[i % 12] + draw.standard_normal(8) * 0.3).tolist()) for i in range(60)]
    asked += [(f"b{i}", rows[5][1]) for i in range(40)] + [("zero", [0.0] * 8), ("null", None), ("far", [99.0] * 8)]
    return rows, asked


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("k,limit", [(1, None), (7, None), (300, None), (5, 0.5)])
def test_equals_brute_force(spark, clouds, monkeypatch, metric, k, limit):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 32)
    rows, asked = clouds
    index = vi.build_index(spark.createDataFrame(rows, "id long, vec array<double>").repartition(3), "id", "vec", metric=metric)
    result = vi.search(spark.createDataFrame(asked, "name string, vec array<double>"), "name", "vec", index, k, limit)
    same(found(result.hits), brute(asked, rows, k, metric, limit))
    work = result.work.first()
    assert work["questions"] == 102 and work["corpus"] == 652 and work["all_pairs"] == 102 * 652
    if k < 300:
        assert work["pairs_computed"] < work["all_pairs"] / 3


def test_small_blocks_are_not_joined_to_one_row(spark, clouds, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vi, "CHUNK", 4)
    rows, asked = clouds
    index = vi.build_index(spark.createDataFrame(rows, "id long, vec array<double>"), "id", "vec")
    assert index.blocks(spark).agg(F.max("n")).first()[0] <= 16
    same(found(vi.search(spark.createDataFrame(asked, "name string, vec array<double>"), "name", "vec", index, 3).hits), brute(asked, rows, 3, "l2"))


def test_blocks_are_sent_to_groups_of_questions(spark, monkeypatch):
    """Vectors that pivots can't tell apart, with many ties: a block is sent once a group, not once a question."""
    monkeypatch.setattr(vi, "BLOCK_ROWS", 32)
    monkeypatch.setattr(vi, "GROUP", 150)
    monkeypatch.setattr(vi, "FEWEST_BLOCKS", 2)
    kept = {}
    stored = vi._stored
    monkeypatch.setattr(vi, "_stored", lambda df, path, name: kept.setdefault(name, stored(df, path, name)))
    draw = np.random.default_rng(4)
    rows = [(f"k{i}", draw.integers(0, 3, 6).astype(float).tolist()) for i in range(900)]
    asked = [(i, draw.integers(0, 3, 6).astype(float).tolist() if i % 3 else draw.uniform(0, 2, 6).tolist()) for i in range(700)]
    index = vi.build_index(spark.createDataFrame(rows, "id string, vec array<double>"), "id", "vec")
    result = vi.search(spark.createDataFrame(asked, "name long, vec array<double>"), "name", "vec", index, 6)
    same(found(result.hits), brute(asked, rows, 6, "l2"))
    questions, blocks = kept["asked"].count(), index.blocks(spark).count()
    groups = kept["grouped"].select("group").distinct().count()
    assert 1 < groups < questions / 50 and blocks > 10
    assert kept["near"].count() <= groups * blocks
    assert kept["second"].count() <= 6 * questions * -(-blocks // 2) < questions * blocks * 6


def test_empty_sides(spark, clouds):
    rows, asked = clouds
    corpus, questions = spark.createDataFrame(rows, "id long, vec array<double>"), spark.createDataFrame(asked, "name string, vec array<double>")
    nothing = vi.build_index(corpus.where("false"), "id", "vec")
    assert vi.search(questions, "name", "vec", nothing).hits.count() == 0
    index = vi.build_index(corpus.where("id < 5"), "id", "vec")
    assert vi.search(questions.where("false"), "name", "vec", index).hits.count() == 0
    assert len(found(vi.search(questions, "name", "vec", index, 50).hits)["far"]) == 5
    with pytest.raises(Exception, match="entries"):
        vi.search(questions.selectExpr("name", "array(1d) AS vec"), "name", "vec", index).hits.collect()


def test_character_vectors_of_a_batch(spark):
    texts = ["Hello, World 42!", "", "ÀÉ İstanbul K — 你好 \U0001F600", "a" * 5_000_000, None, "x\0y", "zz top"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r["id"]: r["vector"] for r in cp.embed(rows, "t").collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
            continue
        low = text.lower()
        expected = [low.count(c) / max(1, len(low)) for c in fv.EMBEDDING_CHARS]
        expected += [b / 255.0 for b in hashlib.md5(text.encode()).digest()]
        assert got[i] == pytest.approx(expected + [0.0] * (64 - len(expected))), text[:20]
    assert cp.embed(rows.where("false"), "t").count() == 0


def test_no_vector_is_shuffled_for_another_group(spark, monkeypatch):
    """Blocks are read where they are stored, and questions are dealt once, whatever the groups and stripes."""
    monkeypatch.setattr(vi, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vi, "GROUP", 60)
    monkeypatch.setattr(vi, "FEWEST_BLOCKS", 2)
    kept, shuffled = {}, []
    stored = vi._stored

    def spy(df, path, name):
        def walk(node):
            if "Exchange" in node.nodeName():
                shuffled.append((name, node.output().toString()))
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(df._jdf.queryExecution().sparkPlan())
        return kept.setdefault(name, stored(df, path, name))

    monkeypatch.setattr(vi, "_stored", spy)
    draw = np.random.default_rng(6)
    rows = [(f"k{i}", draw.uniform(0, 1, 12).tolist()) for i in range(500)]
    asked = [(i, draw.uniform(0, 1, 12).tolist()) for i in range(150)]
    index = vi.build_index(spark.createDataFrame(rows, "id string, vec array<double>").repartition(4), "id", "vec")
    result = vi.search(spark.createDataFrame(asked, "name long, vec array<double>"), "name", "vec", index, 4)
    same(found(result.hits), brute(asked, rows, 4, "l2"))
    assert kept["grouped"].select("group").distinct().count() > 1
    assert kept["second"].where("q IS NULL").count() > kept["grouped"].select("group").distinct().count()
    assert not [x for x in shuffled if "data#" in x[1]]
    assert len([name for name, out in shuffled if name == "second"]) == 1


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (3e4, 1.0), (0.0, 1e18), (0.0, 1e-25)])
def test_single_precision_leaves_no_neighbour_out(shift, scale):
    """Bounds that single precision cannot tell, or cannot hold, are judged in double precision."""
    draw = np.random.default_rng(8)
    blocks = [draw.uniform(0, 1, (40, 6)) * scale + shift for _ in range(8)]
    asked = np.vstack([draw.uniform(0, 1, (300, 6)) * scale + shift, blocks[0][:9]])
    row = {
        "q": pa.array([list(range(len(asked)))], pa.list_(pa.int64())),
        "theta": pa.array([[2.0 * scale * scale + 1.0] * len(asked)], pa.list_(pa.float64())),
        "home": pa.array([["none"] * len(asked)]),
        "v": pa.array([asked.tobytes()], pa.binary()),
    }
    unit = vi._Asked(pa.RecordBatch.from_pydict(row), np.zeros((1, 6)), 3, 9, False)
    for n, block in enumerate(blocks):
        unit.meet(f"b{n}", block, pa.array(range(40 * n, 40 * n + 40)), np.zeros(1), np.full(1, np.inf))
    got = pa.Table.from_batches([next(unit.result(pa.int64()))]).to_pylist()
    everything = np.vstack(blocks)
    want = []
    for q, v in enumerate(asked):
        gap = np.round(((everything - v) ** 2).sum(axis=1), 9)
        want += [(q, rep) for rep in sorted(range(len(gap)), key=lambda i: (gap[i], i))[:3]]
    assert [(r["q"], r["rep"]) for r in got] == want
