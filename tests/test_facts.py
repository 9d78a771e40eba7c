"""Medians by selection, profiles by digest, one form for equal numbers."""

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealscope.functions import ordering
from dealscope.functions import selection as sl
from dealscope.functions.numbers import number_form_sql, whole_form_sql
from dealscope.operators import analytics as an
from dealscope.operators import changes as ch
from dealscope.operators import joins as jn
from dealscope.operators import profiling as pf
from dealscope.operators import quality as ql
from dealscope.plans import load_all
from dealscope.session import scratch_path


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- medians


@pytest.mark.parametrize("slot_rows", [4, 100_000])
def test_medians_by_narrowing(spark, slot_rows):
    draw = random.Random(3)
    columns = [
        [draw.gauss(0, 1) for _ in range(501)], [draw.choice([1.0, 2.0, 3.0]) for _ in range(400)], [5.0], [1.0, 2.0],
        [10.0 ** draw.randint(-200, 200) * draw.choice([-1, 1]) for _ in range(300)], [0.0] * 900 + [float(i) for i in range(100)],
        [float("inf"), 1.0, 2.0], [-0.0, 0.0, 1.0, 1.0],
    ]
    counts = {}
    for i, values in enumerate(columns):
        for v in values:
            counts[i, v + 0.0] = counts.get((i, v + 0.0), 0) + 1
    rows = spark.createDataFrame([(i, v, n) for (i, v), n in counts.items()], "ordinal int, value double, n bigint")
    found = sl.medians(rows.repartition(3), slot_rows)
    for i, values in enumerate(columns):
        assert found[i] == (len({v + 0.0 for v in values}), statistics.median(values)), i


def test_median_of_a_million_distinct_values(spark):
    """Half of them lie within a millionth of the range; no task sorts more than the stated number."""
    n = 1_000_001
    spread = F.when(F.col("id") % 2 == 0, F.col("id") / 1e12).otherwise(F.col("id").cast("double"))
    df = spark.range(n).select(spread.alias("x"), (F.col("id") * 7 % 1_000_003).alias("k"))
    got = {r["column"]: r for r in pf.profile_columns(df, "t", "2024-01-01").collect()}
    assert got["x"]["distinct_count"] == n and got["k"]["distinct_count"] == n
    values = sorted(i / 1e12 if i % 2 == 0 else float(i) for i in range(n))
    assert got["x"]["median"] == round(values[n // 2], 4)
    assert got["k"]["median"] == statistics.median(i * 7 % 1_000_003 for i in range(n))
    rows = df.select(F.lit(0).alias("ordinal"), F.col("k").cast("double").alias("value"), F.lit(1).cast("bigint").alias("n")).persist()
    whole = [sl.Range(0, n // 2 + 1, 0.0, 1_000_002.0, 0, n)]
    while whole[0].rows > 5_000:
        whole = sl._narrowed(rows, whole)
    assert sl._inside(rows, whole).count() == whole[0].rows <= 5_000
    assert sl.at_ranks(rows, whole, 5_000) == {(0, n // 2 + 1): got["k"]["median"]}


# ---- profiles by digest


def test_issues_read_each_table_once(spark, sf):
    names = ("customer", "orders", "lineitem", "part")
    facts = pf.all_quality_facts({n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names}, "2024-01-01")
    df = ql.all_issues(facts)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert [final.count(f"{n}.parquet") for n in names] == [1] * 4 and final.count("FileScan parquet") == 4


def test_only_digests_and_marks_are_shuffled(spark, sf):
    table = spark.read.parquet(f"{sf}/customer.parquet")
    plan = pf.profile_table(table, "t")._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanged) == 1 and "c_name" not in exchanged[0] and "h1" in exchanged[0]


def test_digest_tells_nulls_and_cells_apart(spark):
    rows = [("a", None), (None, "a"), ("a", None), ("", None), (None, None), ("ab", "c"), ("a", "bc"), (None, None)]
    df = spark.createDataFrame(rows, "x string, y string")
    assert tuple(pf.duplicate_rows(df).first()) == (8, 2)
    facts = pf.quality_facts(df, "t", "2024-01-01")
    assert {r["column"]: r["null_count"] for r in facts.collect() if r["column"]} == {"x": 3, "y": 5}
    assert {r["rule"] for r in ql.all_issues(facts).collect()} == {"DUPLICATE_ROWS", "HIGH_NULLS", "HIGH_OVERALL_NULL"}
    assert tuple(pf.duplicate_rows(df.where("false")).first()) == (0, 0)


def test_many_columns_need_more_than_one_word(spark):
    wide = spark.range(10).select(*[F.when(F.col("id") < i, F.col("id").cast("double") - 4).alias(f"revenue{i}") for i in range(40)])
    facts = {r["column"]: r for r in pf.quality_facts(wide, "t", "2024-01-01").collect()}
    for i in range(40):
        shown = [x - 4 for x in range(10) if x < i]
        got = facts[f"revenue{i}"]
        assert (got["null_count"], got["zero_count"], got["negative_count"]) == (10 - len(shown), shown.count(0), sum(x < 0 for x in shown))


# ---- equal numbers

SAME = ["12345678.5", "1.23456785E7", "+12345678.50", "0012345678.5e0", "123456785e-1"]


def test_number_form(spark):
    given = [*SAME, "0", "-0.0", "0E-18", ".0", "1e3", "1000", "1E+3", "-1e18", "-1000000000000000000", "1E-7", "0.0000001", "Infinity", "1e", "x"]
    rows = spark.createDataFrame([(x,) for x in given], "t string").selectExpr("t", f"{number_form_sql('t')} AS f")
    form = {r["t"]: r["f"] for r in rows.collect()}
    assert {form[x] for x in SAME} == {"12345678.5"}
    assert {form[x] for x in ("0", "-0.0", "0E-18", ".0")} == {"0"}
    assert {form[x] for x in ("1e3", "1000", "1E+3")} == {"1000"} and form["-1e18"] == form["-1000000000000000000"] == "-1" + "0" * 18
    assert form["1E-7"] == form["0.0000001"] == "0.0000001" and form["Infinity"] == "Infinity" and form["1e"] == "1e"
    whole = spark.createDataFrame([(0,), (1000,), (-(2**63),), (7,)], "v bigint").selectExpr(f"{whole_form_sql('v')} AS f").collect()
    assert [r["f"] for r in whole] == ["0", "1000", "-9223372036854775808", "7"]


@pytest.mark.parametrize(
    "left,right,kinds",
    [
        ([12345678.5, 1e18, 1e-7], [Decimal("12345678.5000000"), Decimal(10**18), Decimal("0.0000001")], ("double", "decimal(38,7)")),
        (["12345678.5", "1e3", "5"], [12345678.5, 1000.0, 5.0], ("string", "double")),
        (["1e3", "-7", "0"], [1000, -7, 0], ("string", "bigint")),
        ([10**18, 3], [1e18, 3.0], ("bigint", "double")),
        ([Decimal("12345678.50")], ["12345678.5"], ("decimal(10,2)", "string")),
    ],
)
def test_keys_of_different_types_join_by_value(spark, left, right, kinds):
    a = spark.createDataFrame([(x,) for x in left], f"k {kinds[0]}")
    b = spark.createDataFrame([(x,) for x in right], f"k {kinds[1]}")
    found = jn.join_quality(a, b, "k", "k").first()
    assert found["matched_keys"] == len(left) and found["lost_left_rows"] == 0


def test_a_widened_type_changes_no_row(spark):
    old = spark.createDataFrame([(1, 2, "x"), (2, None, None)], "id int, v int, t string")
    wide = old.select(F.col("t"), F.col("id").cast("bigint").alias("id"), F.col("v").cast("decimal(12,2)").alias("v"))
    assert tuple(ch.row_changes(old, wide).first()) == (0, 0)
    assert tuple(ch.row_changes(old, wide.withColumn("v", F.col("v").cast("double") + 0.5)).first()) == (1, 1)
    days = spark.sql("SELECT DATE'2024-01-02' AS d")
    assert tuple(ch.row_changes(days, days.select(F.col("d").cast("timestamp_ntz").alias("d"))).first()) == (0, 0)


def test_an_update_is_scanned_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def tick(rows):
        for row in rows:
            reads.add(1)
            yield row

    df = spark.createDataFrame(spark.sparkContext.parallelize([(1,), (2,)], 1).mapPartitions(tick), "id int")
    registry = ch.fingerprint(df.limit(0), "other", "t0")
    classified, _ = ch.process_update("t", df, registry, None, ["id"], "t1")
    before = reads.value
    assert classified.first()["class"] == "NEW_TABLE" and classified.count() == 1 and reads.value == before


# ---- sums


def test_sums_keep_small_large_and_infinite_values(spark):
    inf = float("inf")
    rows = [("small", 4e-10), ("small", 4e-10), ("large", 1e22), ("large", 1e22), ("inf", inf), ("inf", 1.0), ("nan", float("nan")), ("none", None), ("plain", 0.1), ("plain", 0.2)]
    df = spark.createDataFrame(rows, "k string, v double")
    totals = {r["k"]: (r["total"], r["mean"]) for r in an.group_totals(df, "k", "v").collect()}
    assert totals["small"][0] == pytest.approx(8e-10) and totals["large"] == (2e22, 1e22) and totals["inf"][0] == inf
    assert totals["plain"][0] == 0.3 and totals["nan"] == totals["none"] == (0.0, None)
    order = [(r["k"], r["rank"], r["cum_pct"]) for r in an.pareto(df, "k", "v").orderBy("rank").collect()]
    assert order == [("inf", 1, 100.0), ("large", 2, 100.0), ("plain", 3, 100.0), ("small", 4, 100.0)]
    assert [r["k"] for r in an.leading_accounts(df, "k", "v").collect()] == ["inf"]
    finite = df.where("k IN ('small', 'plain', 'large')")
    assert [(r["k"], r["cum_pct"]) for r in an.pareto(finite, "k", "v").orderBy("rank").collect()] == [("large", 100.0), ("plain", 100.0), ("small", 100.0)]
    tiny = spark.createDataFrame([("a", 6e-10), ("b", 3e-10), ("c", 1e-10)], "k string, v double")
    assert [(r["k"], r["cum_pct"]) for r in an.pareto(tiny, "k", "v").orderBy("rank").collect()] == [("a", 60.0), ("b", 90.0), ("c", 100.0)]
    assert [(r["rank"], r["k"]) for r in an.ranked(df, "k", "v").orderBy("rank").collect()] == [(1, "inf"), (2, "large"), (3, "plain"), (4, "small")]

def test_slots_of_a_range_and_ranks_that_share_it(spark):
    """The compiled slot is the one of the global order, and the two ranks of a median cost one pass."""
    cases = [([], [0.0]), ([1.0], [0.0, 1.0, 2.0]), ([float(i) for i in range(63)], [-1.0, 0.0, 7.0, 7.5, 8.0, 31.0, 55.5, 62.0, 70.0])]
    rows = spark.createDataFrame([(b, v) for b, vs in cases for v in vs], "bounds array<double>, value double")
    value, bounds = F.col("value"), F.col("bounds")
    assert rows.where(sl._slot(value, bounds) != ordering.slot_of(value, bounds)).count() == 0 and rows.count() == 13
    path = scratch_path(spark, "values")
    spark.range(1_000).selectExpr("CAST(id % 2 AS INT) AS ordinal", "CAST(id AS DOUBLE) AS value", "2L AS n").write.parquet(path)
    values = spark.read.parquet(path)
    ranges = [sl.Range(o, k, 0.0, 999.0, 0, 500) for o in (0, 1) for k in (500, 501)]
    got = sl._narrowed(values, ranges)
    assert len(got) == 4 and all(r.low <= (499.0 if r.rank == 500 else 500.0) + r.ordinal <= r.high + 2 for r in got)
    assert {o: (f.distinct, f.median) for o, f in sl.medians(values, slot_rows=20).items()} == {0: (500, 499.0), 1: (500, 500.0)}
