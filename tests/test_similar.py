"""Similar account names against all pairs; first values of a file."""

import datetime as dt
import random

from pyspark.sql import functions as F

from dealscope.operators import corpus as cp
from dealscope.operators import questions as qs
from dealscope.operators import semantic_types as st
from dealscope.session import scratch_path


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_every_pair_within_two_edits_is_found(spark):
    draw = random.Random(9)
    letters = "abcé7"

    def spoiled(t, n):
        for _ in range(n):
            at = draw.randrange(len(t) + 1)
            t = draw.choice([t[:at] + t[at + 1 :], t[:at] + draw.choice(letters) + t[at:], t[:at] + draw.choice(letters) + t[at + 1 :]])
        return t

    names = ["a", "b", "ab", "", "abc", "--", None, "x" * 41, "x" * 43, "x" * 39, "ab" * 300, "ab" * 299 + "b"]
    for size in (3, 8, 15, 39, 40, 41, 42, 43, 44, 60, 300):
        for _ in range(5):
            base = "".join(draw.choice(letters) for _ in range(size))
            names += [base, base] + [spoiled(base, draw.randint(0, 4)) for _ in range(4)]
    rows = spark.createDataFrame([(n,) for n in names], "account_name string").repartition(3)
    got = {(r["name"], r["other"]): (r["distance"], r["accounts"], r["other_accounts"]) for r in qs.similar_accounts(rows, F.col("account_name")).collect()}
    counts = {}
    for n in names:
        if n:
            counts[n] = counts.get(n, 0) + 1
    distinct = sorted(counts)
    want = {}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2:
                want[a, b] = (d, counts[a], counts[b])
    assert got == want and len(want) > 150
    assert qs.similar_accounts(rows.where("false"), F.col("account_name")).count() == 0


def test_names_are_not_compared_pair_by_pair(spark):
    """Far apart names share no block, so the join sees next to nothing of 4,000 x 4,000 pairs."""
    names = spark.range(4_000).select(F.md5(F.col("id").cast("string")).alias("name"))
    holding, asking = qs._blocks_of(names)
    shared = holding.groupBy("block").agg(F.count("*").alias("n")).where("n > 1")
    assert shared.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0] < 1_000
    assert holding.count() == asking.count()


def test_blocks_of_names_are_not_broadcast(spark):
    """A small table of names makes a large one of blocks: it has no place in the driver."""
    names = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("account_name"))
    plan = qs.similar_accounts(names, F.col("account_name"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 4


def test_first_values_in_file_order(spark):
    path = scratch_path(spark, "typed")
    rows = [(None, None, None, None)] + [(i, i / 4, i % 2 == 0, dt.datetime(2024, 1, 1, 0, 0, i % 60)) for i in range(500)]
    schema = "id bigint, ratio double, flag boolean, at timestamp_ntz"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b")
    spark.createDataFrame([(None, None, True, None)], schema).coalesce(1).write.parquet(f"{path}/a")
    df = spark.read.option("recursiveFileLookup", True).schema(schema).parquet(path)
    got = {r["column"]: r["samples"] for r in st.first_values(df).collect()}
    assert got == {
        "id": ["0", "1", "2"], "ratio": ["0.0", "0.25", "0.5"], "flag": ["true", "true", "false"],
        "at": ["2024-01-01T00:00:00", "2024-01-01T00:00:01", "2024-01-01T00:00:02"],
    }
    assert st.first_values(df.where("false")).count() == 0


def test_similar_patterns_equal_all_pairs_and_tokens_are_ordered_by_frequency(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["longestcommonword"]
    asked = [(i, " ".join(draw.sample(words, draw.randint(1, 12)) + ["longestcommonword"])) for i in range(120)]
    stored = [(f"c{i:03d}_{n}", q + draw.choice(["", " again", " w1 w2"])) for i, q in asked for n in range(2)] + [("none", ""), ("null", None)]
    rows = spark.createDataFrame(asked, "question_id int, question string"), spark.createDataFrame(stored, "code string, question string")
    got = sorted((r["question_id"], r["code"], round(r["similarity"], 9)) for r in cp.similar_patterns(*rows, threshold=0.6).collect())
    want = []
    for i, q in asked:
        a, hits = set(q.split()), set()
        for code, s in stored:
            b = set((s or "").split())
            if b and len(a & b) / len(a | b) >= 0.6:
                hits.add((len(a & b) / len(a | b), code))
        best = {}
        for similarity, code in sorted(hits, reverse=True)[:3]:
            best[code, round(similarity, 9)] = 1
        want += [(i, code, similarity) for code, similarity in best]
    assert got == sorted(want) and len(got) > 150
    sets = spark.createDataFrame([(str(i), [f"x{i}", "pairedlongword" if i < 2 else f"y{i}"]) for i in range(3_000)], "set_id string, tokens array<string>")
    ordered = cp._rare_first(sets, cp._token_counts(sets)).where("set_id = '1'").first()["tokens"]
    assert ordered == ["x1", "pairedlongword"]
