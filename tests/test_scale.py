"""Plans and results under skew: one key holds a third of all rows or more."""

import random

import pytest
from pyspark.sql import functions as F

from dealscope.functions.ordering import first_per_group
from dealscope.operators import changes as ch
from dealscope.operators import joins as jn
from dealscope.operators import logs as lg
from dealscope.operators import profiling as pf
from dealscope.plans import bindings as b
from dealscope.plans import load_all


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 50), i, rng.randint(0, 9)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k bigint, seq bigint, v bigint")


def test_rank_limit_runs_before_the_shuffle(skewed):
    _, df = skewed
    plan = plan_of(first_per_group(df, ["k"], [F.col("seq").desc()], 3))
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_latest_row_of_a_hot_key(skewed):
    rows, df = skewed
    got = {r["k"]: r["seq"] for r in first_per_group(df, ["k"], [F.col("seq").desc()]).collect()}
    expected = {}
    for k, seq, _ in rows:
        expected[k] = max(seq, expected.get(k, -1))
    assert got == expected


def test_join_quality_of_a_hot_key(skewed):
    rows, df = skewed
    q = jn.join_quality(df, df, "k", "k").first()
    sizes = {}
    for k, _, _ in rows:
        sizes[k] = sizes.get(k, 0) + 1
    assert q["expansion"] == round(sum(n * n for n in sizes.values()) / len(rows), 4)
    assert q["lost_left_rows"] == 0 and q["matched_keys"] == len(sizes)


def test_top_values_of_a_hot_value(skewed):
    rows, df = skewed
    got = pf.top_values(df.select(F.col("k").cast("string").alias("k")), "t").collect()
    sizes = {}
    for k, _, _ in rows:
        sizes[str(k)] = sizes.get(str(k), 0) + 1
    expected = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(r["value"], r["value_count"]) for r in sorted(got, key=lambda r: r["rank"])] == expected


def test_actions_of_a_hot_session(spark):
    rows = [("hot", p) for p in (3, 9, 17, 40, 62)] + [("cold", 5)]
    df = spark.createDataFrame(rows, "session string, position int")
    got = {(r["session"], r["position"]): r["number"] for r in lg.number_in_session(df, "session", "position").collect()}
    assert got == {("hot", 3): 1, ("hot", 9): 2, ("hot", 17): 3, ("hot", 40): 4, ("hot", 62): 5, ("cold", 5): 1}


def test_day_parts_make_the_document(spark):
    notes = spark.createDataFrame([("d1", 2, "b"), ("d1", 1, "a"), ("d2", 3, "c")], "day string, seq int, note string")
    parts = sorted(lg.day_document_parts(notes, "day", "seq", "note").collect())
    assert "".join(r["part"] for r in parts if r["day"] == "d1") == "a\n\n---\n\nb"
    assert "".join(r["part"] for r in parts if r["day"] == "d2") == "c"


def test_row_changes_count_distinct_rows(spark):
    old = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (3, "c"), (3, "c")], "id int, v string")
    assert tuple(ch.row_changes(old, new).first()) == (1, 1)
    assert tuple(ch.row_changes(old, new.withColumn("x", F.lit(1))).first()) == (2, 2)


def test_only_needed_columns_are_read(spark, sf):
    plan = plan_of(load_all()["k1_revenue_concentration"].plan(spark, sf))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_filters_reach_the_scan(spark, sf):
    plan = plan_of(b.deals(spark, sf).filter(F.col("deal_value") > 400000).select("deal_id"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,400000.0)]" in plan


def test_global_order_scans_the_facts_once(spark, sf):
    df = load_all()["w1_pareto_accounts"].plan(spark, sf)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 1


def test_row_hash_deals_rows_to_as_many_tasks_as_the_session_shuffles(spark, sf):
    plan = plan_of(load_all()["u1_row_hash"].plan(spark, sf))
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan
