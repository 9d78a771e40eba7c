"""Literal cases for the operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions import names
from dealscope.functions import text as tx
from dealscope.functions.dates import whole_days
from dealscope.functions.ordering import with_global_order, with_ntiles
from dealscope.operators import analytics as an
from dealscope.operators import changes as ch
from dealscope.operators import corpus as cp
from dealscope.operators import joins as jn
from dealscope.operators import logs as lg
from dealscope.operators import profiling as pf
from dealscope.operators import quality as ql
from dealscope.operators import semantic_types as st
from dealscope.operators import shaping as sh


def column(spark, name, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")


def inferred(spark, name, values, kind="string"):
    cast, types = st.infer_and_cast(column(spark, name, values, kind))
    return types[name].semantic, [r[0] for r in cast.collect()]


# --- types -------------------------------------------------------------------------


def test_currency_cast(spark):
    assert inferred(spark, "revenue", ["£1,234,567", "$890,000", "€ 45,000"]) == (
        "currency", [1234567.0, 890000.0, 45000.0],
    )


def test_currency_by_value_needs_a_symbol(spark):
    assert inferred(spark, "x", ["£10", "20", "abc"])[0] == "currency"
    assert inferred(spark, "x", ["10", "20", "30"])[0] == "numeric"


def test_percentage_cast(spark):
    assert inferred(spark, "win_rate", ["75%", "40 %", "90%"]) == ("percentage", [75.0, 40.0, 90.0])


@pytest.mark.parametrize(
    "cells", [["2024-01-05", "2024-1-6"], ["05/01/2024", "31/12/2024"], ["01/31/2024", "12/31/2024"],
              ["2024/01/05"], ["05-01-2024"], ["2024-01-05T10:11:12"]],
)
def test_date_formats(spark, cells):
    semantic, values = inferred(spark, "when", cells)
    assert semantic == "date" and all(isinstance(v, dt.datetime) for v in values)


def test_date_needs_seventy_percent(spark):
    assert inferred(spark, "note", ["2024-01-05", "a", "b"])[0] != "date"
    assert inferred(spark, "note", ["2024-01-05"] * 7 + ["a"] * 3)[0] == "date"


def test_date_shape_rejects_other_cells(spark):
    assert inferred(spark, "when", ["2024-13-45", "2024-99-99"])[0] != "date"


def test_hints_and_distinct_counts(spark):
    assert inferred(spark, "email", ["a@b.c"])[0] == "email"
    assert inferred(spark, "mobile", ["x1"])[0] == "phone"
    assert inferred(spark, "account_id", [f"u-{i}" for i in range(40)])[0] == "identifier"
    assert inferred(spark, "stage", ["Open", "Won"] * 20)[0] == "categorical"
    assert inferred(spark, "notes", [f"text {i}" for i in range(80)])[0] == "text"
    assert inferred(spark, "ok", [True, False], "boolean")[0] == "categorical"


def test_number_guard(spark):
    df = column(spark, "v", ["1.0f", "inf", "NaN", "1e3", " 7 ", "-2.5", ".5", "abc"])
    got = [r[0] for r in df.select(F.expr(st.number_sql("v"))).collect()]
    assert got == [None, None, None, 1000.0, 7.0, -2.5, 0.5, None]


def test_strict_names():
    assert names.is_percentage_name("duration") and not names.is_percentage_name("duration", strict=True)
    assert names.is_currency_name("network") and not names.is_currency_name("network", strict=True)
    assert names.is_currency_name("deal_value", strict=True)


# --- joins -------------------------------------------------------------------------


def test_name_similarity():
    assert names.name_similarity("Region_Key", "region_key") == 1.0
    assert names.name_similarity("fk_region", "region_uuid") == 0.95
    assert names.name_similarity("order-date", "order_data") == 2 * 9 / 20
    assert names.name_similarity("qty", "memo") == 0.0


@pytest.mark.parametrize(
    "left, right, best", [([1, 2, 3], [1, 2, 3, 4, 5], 1.0), ([1, 2, 3], [10, 20, 30], 0.0),
                          ([1, 2, 3, 4], [1, 2], 1.0), ([], [1], 0.0), ([1, None], [1, None, 2], 1.0)],
)
def test_value_overlap(spark, left, right, best):
    a, b = column(spark, "k", left, "bigint"), column(spark, "k", right, "bigint")
    assert jn.overlap(a, b, "k", "k").first()["value_overlap"] == best


def test_join_quality(spark):
    a, b = column(spark, "k", [1, 2, 3, 4], "bigint"), column(spark, "k", [1, 2], "bigint")
    q = jn.join_quality(a, b, "k", "k").first()
    assert (q["match_rate"], q["lost_left_rows"], q["lost_right_rows"]) == (0.5, 2, 0)
    q = jn.join_quality(b, a, "k", "k").first()
    assert (q["lost_right_rows"], q["warnings"]) == (2, "")
    many = column(spark, "k", [1, 1, 1, 2], "bigint")
    assert jn.join_quality(a, many, "k", "k").first()["duplicate_risk"] is False
    assert jn.join_quality(b, many, "k", "k").first()["duplicate_risk"] is True


def test_mixed_key_types_compare_as_numbers(spark):
    tables = {
        "accounts": spark.createDataFrame([("1",), ("2",), ("3",)], "account_id string"),
        "deals": spark.createDataFrame([(1.0,), (2.0,)], "account_id double"),
    }
    found = jn.suggest(tables)
    assert [(c.name_similarity, c.value_overlap, c.confidence) for c in found] == [(1.0, 1.0, 1.0)]


def test_unrelated_tables_have_no_candidates(spark):
    tables = {
        "a": spark.createDataFrame([("x", 1.5)], "alpha string, beta double"),
        "b": spark.createDataFrame([(7,)], "zzz bigint"),
    }
    assert jn.suggest(tables) == [] and jn.build_chain(tables, []).master is None


def test_chain_skips_merged_and_prefixes_clashes(spark):
    tables = {
        "accounts": spark.createDataFrame([(1, "A", "x")], "account_id bigint, name string, note string"),
        "contacts": spark.createDataFrame([(7, 1, "B")], "contact_id bigint, account_id bigint, name string"),
        "activities": spark.createDataFrame([(9, 7)], "activity_id bigint, contact_id bigint"),
    }
    candidates = [
        jn.Candidate("accounts", "contacts", "account_id", "account_id"),
        jn.Candidate("contacts", "activities", "contact_id", "contact_id"),
        jn.Candidate("accounts", "activities", "account_id", "contact_id", confidence=0.2),
    ]
    chain = jn.build_chain(tables, candidates)
    assert chain.master.columns == ["account_id", "name", "note", "contact_id", "contacts__name", "activity_id"]
    assert tuple(chain.master.first()) == (1, "A", "x", 7, "B", 9)


def test_null_safe_join(spark):
    a, b = column(spark, "k", [1, None], "bigint"), column(spark, "k", [None], "bigint")
    assert jn.equi_join(a, b, "k", "k", "inner").count() == 0
    assert jn.equi_join(a, b, "k", "k", "inner", null_safe=True).count() == 1
    with pytest.raises(ValueError):
        jn.equi_join(a, b, "k", "k", "cross")


# --- profiles ----------------------------------------------------------------------


def profile(spark, name, values, kind="double"):
    return pf.profile_columns(column(spark, name, values, kind), "t", "2024-01-01").first()


def test_numeric_statistics(spark):
    p = profile(spark, "x", [100.0, 200.0, 300.0])
    assert (p["min_num"], p["max_num"], p["mean"], p["median"], p["std"]) == (100, 300, 200, 200, 100)
    assert profile(spark, "x", [10.0, 20.0, 30.0, 40.0, 50.0])["median"] == 30
    assert profile(spark, "x", [5.0])["std"] == 0.0


def test_nulls_and_nan_count_alike(spark):
    p = profile(spark, "x", [1.0, None, 3.0, float("nan")])
    assert (p["null_count"], p["null_pct"], p["distinct_count"]) == (2, 50.0, 2)


def test_median_of_a_hot_value(spark):
    rng = random.Random(7)
    values = [5.0] * 4000 + [rng.uniform(0, 10) for _ in range(6001)]
    expected = round(sorted(values)[len(values) // 2], 4)
    assert profile(spark, "x", values)["median"] == expected


def test_approximate_profile_has_the_same_shape(spark):
    df = column(spark, "x", [1.0, 2.0, 2.0, 9.0], "double")
    quick = pf.profile_columns(df, "t", "2024-01-01", exact=False)
    assert quick.columns == pf.profile_columns(df, "t", "2024-01-01").columns
    assert quick.first()["distinct_count"] == 3


def rules(spark, name, values, kind):
    facts = pf.quality_facts(column(spark, name, values, kind), "t", "2024-01-01")
    return [(r["severity"], r["rule"]) for r in ql.column_issues(facts).collect()]


def test_null_rules(spark):
    assert rules(spark, "x", ["a"] * 6 + [None] * 4, "string") == [("warning", "HIGH_NULLS")]
    assert rules(spark, "x", ["a"] * 9 + [None], "string") == []
    assert rules(spark, "x", [None, None], "string") == [("error", "FULLY_EMPTY")]


def test_money_and_date_rules(spark):
    assert rules(spark, "revenue", [0.0, -5.0, 10.0], "double") == [
        ("warning", "ZERO_REVENUE"), ("warning", "NEGATIVE_REVENUE"),
    ]
    assert rules(spark, "x", [0.0, -5.0], "double") == []
    assert rules(spark, "day", [dt.datetime(2025, 1, 1)], "timestamp_ntz") == [("warning", "FUTURE_DATES")]


def test_duplicate_rule(spark):
    few = pf.profile_table(column(spark, "x", [1, 1] + list(range(2, 60)), "bigint"), "t")
    many = pf.profile_table(column(spark, "x", [1, 1, 2], "bigint"), "t")
    assert [i["severity"] for i in ql.table_issues(few).collect()] == ["warning"]
    assert [i["severity"] for i in ql.table_issues(many).collect()] == ["error"]


# --- changes -----------------------------------------------------------------------

V1 = [(1, "Alice", 10.0), (2, "Bob", 20.0), (3, "Charlie", 30.0)]
SCHEMA = "id bigint, name string, val double"


def tables(spark):
    v1 = spark.createDataFrame(V1, SCHEMA)
    v2 = spark.createDataFrame(V1 + [(4, "Dave", 40.0)], SCHEMA)
    corrected = spark.createDataFrame(V1[:2] + [(3, "Charlotte", 30.0)], SCHEMA)
    return v1, v2, corrected


def test_classification(spark):
    v1, v2, corrected = tables(spark)
    registry = ch.fingerprint(v1, "t", "")
    classes = [
        ch.classify(ch.fingerprint(df, name, ""), registry).first()["class"]
        for name, df in (("t", v1), ("t", v1.orderBy(F.desc("id"))), ("t", corrected), ("t", v2),
                         ("t", v1.withColumn("x", F.lit(1))), ("u", v1))
    ]
    assert classes == ["DUPLICATE", "DUPLICATE", "CORRECTED_DATA", "UPDATED_VERSION", "UPDATED_VERSION", "NEW_TABLE"]


def test_row_hash_sees_null_position(spark):
    a = spark.createDataFrame([(1, None)], "a bigint, b bigint")
    b = spark.createDataFrame([(None, 1)], "a bigint, b bigint")
    hashes = [ch.fingerprint(d, "t", "").first()["row_hash"] for d in (a, b)]
    assert hashes[0] != hashes[1]


def test_diffs(spark):
    v1, v2, corrected = tables(spark)
    d = ch.diff(v1, v2, ["id"]).first()
    assert (d["rows_added"], d["rows_removed"], d["summary"]) == (1, 0, "1 new row")
    d = ch.diff(v1, corrected, ["id"]).first()
    assert d["summary"] == "1 new row, 1 row removed, 1 value corrected in name"
    assert ch.diff(v1, v1, ["id"]).first()["summary"] == "No changes detected"
    s = ch.change_samples(v1, corrected, ["id"]).first()
    assert (s["column"], s["old_value"], s["new_value"]) == ("name", "Charlie", "Charlotte")


def test_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, val string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id bigint, val string")
    merged = ch.merge_latest(old, new, "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        ch.merge_latest(old, new.drop("id"), "id")


# --- results -----------------------------------------------------------------------


@pytest.mark.parametrize(
    "rows, nulls, retries, assumed, cannot, expected",
    [(5, 0.0, 0, False, False, 100), (5, 0.0, 1, False, False, 80), (5, 0.0, 3, False, False, 40),
     (0, 0.0, 0, False, False, 20), (0, 0.0, 10, False, False, 0), (5, 0.0, 0, False, True, 0),
     (1, 0.0, 0, False, False, 90), (5, 0.5, 0, True, False, 75)],
)
def test_confidence(spark, rows, nulls, retries, assumed, cannot, expected):
    score = sh.confidence(F.lit(rows), F.lit(nulls), F.lit(retries), F.lit(assumed), F.lit(cannot))
    assert spark.range(1).select(score).first()[0] == expected


def test_what_if(spark):
    a = spark.createDataFrame([("revenue", 1000000.0), ("zero", 0.0), ("gone", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("revenue", 1500000.0), ("zero", 5.0)], "metric string, value double")
    got = {r["metric"]: (r["change"], r["pct_change"]) for r in sh.what_if(a, b).collect()}
    assert got == {"revenue": (500000.0, "+50.0%"), "zero": (5.0, ""), "gone": (None, "")}


def test_bad_search_pattern_keeps_rows(spark):
    df = column(spark, "x", ["Alpha", None])
    assert sh.search(df, "[").count() == 2 and sh.search(df, "ALP").count() == 1


# --- text --------------------------------------------------------------------------


def test_chunks(spark):
    long = " ".join(f"w{i}" for i in range(1200))
    df = spark.createDataFrame([(1, ""), (2, "Hello world"), (3, long), (4, None)], "id int, t string")
    got = cp.chunks(df, F.col("id").cast("string"), "t").collect()
    assert [r["id"] for r in got] == ["2_0", "3_0", "3_1", "3_2"]
    assert got[0]["chunk"] == "Hello world"
    assert got[2]["chunk"].split()[0] == "w450" and got[3]["chunk"].split()[-1] == "w1199"
    assert {w for r in got[1:] for w in r["chunk"].split()} == set(long.split())


def test_character_vector(spark):
    import hashlib

    text = "Hello, World 42!"
    vector = cp.embed(column(spark, "t", [text, ""]), "t").collect()[0]["vector"]
    low = text.lower()
    expected = [low.count(c) / len(low) for c in fv.EMBEDDING_CHARS]
    expected += [b / 255.0 for b in hashlib.md5(text.encode()).digest()]
    expected += [0.0] * (64 - len(expected))
    assert len(vector) == 64 and vector == pytest.approx(expected)


def test_embedding_hook(spark):
    import pandas as pd

    def lengths(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [float(len(t))])

    got = cp.embed(column(spark, "t", ["ab", "c"]), "t", lengths).collect()
    assert [list(r["vector"]) for r in got] == [[2.0], [1.0]]


@pytest.mark.parametrize(
    "question, expected",
    [("What is the total revenue?", "aggregation"), ("Compare Q1 versus Q2", "comparison"),
     ("Top 10 accounts", "ranking"), ("What if we add 10%", "what_if"), ("hello", "aggregation"),
     ("stop the summit", "aggregation"), ("Any missing dates?", "data_quality")],
)
def test_intents(spark, question, expected):
    assert spark.range(1).select(tx.intent(F.lit(question))).first()[0] == expected


def test_recommendation_forms(spark):
    signed = "🎯 PRIORITY ACTION: call\nthem ⚠️ RISK FLAG: late 💡 OPPORTUNITY: more"
    plain = "priority action: call RISK FLAG: late OPPORTUNITY: more"
    df = column(spark, "t", [signed, plain, "nothing"]).select(tx.recommendation_sections(F.col("t")).alias("r"))
    got = [tuple(r) for r in df.select("r.*").collect()]
    assert got == [("call\nthem", "late", "more"), ("call", "late", "more"), ("", "", "")]


def test_whole_days(spark):
    pairs = [(dt.datetime(2024, 1, 1, 23, 50), dt.datetime(2024, 1, 2, 0, 10)),
             (dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1, 23, 59, 59))]
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(whole_days(F.col("a"), F.col("b"))).collect()] == [0, -1]


def test_similar_questions_equal_brute_force(spark):
    import regex

    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(12)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for _ in range(60)]
    texts += ["same question again"] * 40  # a third of all rows asks the same
    questions = spark.createDataFrame(list(enumerate(texts)), "question_id int, question string")
    patterns = spark.createDataFrame([(f"c{i:03d}", t) for i, t in enumerate(texts)], "code string, question string")

    def tokens(t):
        return set(regex.findall(r"[\p{L}\p{N}_]+", t.lower()))

    for threshold in (0.85, 0.5):
        got = cp.similar_patterns(questions, patterns, threshold)
        got = {(r["question_id"], r["code"]) for r in got.collect()}
        expected = set()
        for i, q in enumerate(texts):
            scored = []
            for j, p in enumerate(texts):
                a, b = tokens(q), tokens(p)
                s = len(a & b) / len(a | b)
                if s >= threshold:
                    scored.append((s, f"c{j:03d}"))
            expected |= {(i, code) for _, code in sorted(scored, reverse=True)[:3]}
        assert got == expected


# --- order -------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_global_order_equals_a_plain_sort(spark, hot):
    rng = random.Random(11)
    rows = [(i, 7 if rng.random() < hot else rng.randint(0, 500)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = with_global_order(df, "v", "k", running="run", rows="n", total="t").orderBy("row_num").collect()
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r["k"] for r in got] == [k for k, _ in expected]
    running = 0
    for r, (_, v) in zip(got, expected):
        running += v
        assert r["run"] == running
    assert got[0]["n"] == 2000 and got[0]["t"] == running


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 101])
def test_ntiles_equal_the_window_function(spark, n):
    df = spark.range(n).withColumn("v", (F.col("id") * 7) % 5)
    got = with_ntiles(df, [("v", "up", False), ("v", "down", True)], "id", 4)
    got = got.withColumn("x", F.expr("ntile(4) over (order by v, id)")).withColumn(
        "y", F.expr("ntile(4) over (order by v desc, id)")
    )
    assert got.filter("up <> x or down <> y").count() == 0 and got.count() == n


def test_pareto_reaches_hundred(spark):
    df = spark.createDataFrame([(1, 50.0), (2, 30.0), (3, 20.0), (None, 9.0)], "k bigint, v double")
    got = [(r["k"], r["cum_pct"]) for r in an.pareto(df, "k", "v").orderBy("rank").collect()]
    assert got == [(1, 50.0), (2, 80.0), (3, 100.0)]


# --- logs --------------------------------------------------------------------------


def test_recent_and_final(spark):
    log = spark.createDataFrame([(i, dt.datetime(2024, 1, 1, 0, i)) for i in range(10)], "id int, ts timestamp_ntz")
    assert [r["id"] for r in lg.recent(log, "ts", "id", 3).collect()] == [9, 8, 7]
    tries = spark.createDataFrame([("a", 1, 50), ("a", 2, 90), ("a", 3, 95), ("b", 1, 10), ("b", 5, 20), ("b", 6, 99)],
                                  "query_id string, iteration int, score int")
    final = {(r["query_id"], r["iteration"]) for r in lg.final_flags(tries).filter("is_final").collect()}
    assert final == {("a", 2), ("b", 5)}


def test_rubrics_total_hundred():
    assert all(sum(w.values()) == 100 for w in fv.RUBRIC_WEIGHTS.values())
