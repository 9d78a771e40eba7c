"""Cases that the test tables do not hold: tiny and huge values, odd keys, clashes, repeated batches."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealscope.operators import analytics as an
from dealscope.operators import changes as ch
from dealscope.operators import corpus as cp
from dealscope.operators import joins as jn
from dealscope.operators import logs as lg
from dealscope.operators import profiling as pf
from dealscope.operators import questions as qs
from dealscope.operators import shaping as sh
from dealscope.streaming import ingest


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_sums_are_not_rounded_before_adding(spark):
    df = spark.createDataFrame([("a", 0.004), ("a", 0.004), ("b", float("nan")), ("b", 1.0), ("c", 1e17)], "k string, v double")
    got = {r["k"]: (r["total"], r["mean"]) for r in an.group_totals(df, "k", "v").collect()}
    assert got == {"a": (0.008, 0.004), "b": (1.0, 1.0), "c": (1e17, 1e17)}


def test_pareto_and_rank_on_text_and_null_keys(spark):
    names = ["Ünited", "acme", "acmf", "b", "", "zz long name indeed", "zz long name inside"]
    df = spark.createDataFrame([(n, 10.0) for n in names] + [(None, 5.0), ("top", 99.0)], "name string, v double")
    ranked = an.ranked(df, "name", "v").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 10)) and ranked[0]["name"] == "top" and ranked[-1]["name"] is None
    assert [r["name"] for r in ranked[1:-1]] == sorted(names, key=lambda n: n.encode())
    assert an.pareto(df, "name", "v").agg(F.max("cum_pct")).first()[0] == 100.0


def test_ties_over_many_text_keys_are_spread(spark):
    df = spark.range(5_000).select(F.concat(F.lit("k"), F.md5(F.col("id").cast("string"))).alias("name"), F.lit(1.0).alias("v"))
    got = an.ranked(df, "name", "v").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5_001)) and [r["name"] for r in got] == sorted(r["name"] for r in got)


def test_numbers_in_a_session_for_any_positions(spark):
    places = [3, 3, 5, 64, 70, 5_000, 2_000_000] + list(range(100, 170))
    df = spark.createDataFrame([("s", p, i) for i, p in enumerate(places)] + [(None, 1, 900)], "s string, p bigint, i int")
    got = lg.number_in_session(df, "s", "p", ("i",)).collect()
    assert sorted(r["number"] for r in got if r["s"]) == list(range(1, 78))
    assert [r["i"] for r in sorted((r for r in got if r["s"]), key=lambda r: r["number"])][:3] == [0, 1, 2]


def test_wide_keys_keep_all_digits(spark):
    ids = [2**53 + i for i in range(4)]
    left, right = (spark.createDataFrame([(i,) for i in x], "id bigint") for x in (ids, ids[:2]))
    shared = jn.shared_values({"a": left, "b": right}, [("a", "b", "id", "id")])
    assert shared[("a", "b", "id", "id")] == (4, 2, 2)


def test_text_keys_meet_number_keys(spark):
    left = spark.createDataFrame([("1", "a"), (" 02", "b"), ("x", "c"), (None, "d"), ("9007199254740993", "e")], "k string, l string")
    right = spark.createDataFrame([(1, 10), (2, 20), (7, 70), (9007199254740993, 90), (9007199254740992, 91)], "k bigint, r int")
    q = jn.join_quality(left, right, "k", "k").first()
    assert (q["matched_keys"], q["lost_left_rows"], q["lost_right_rows"]) == (3, 2, 2)
    for how, n in (("inner", 3), ("left", 5), ("right", 5), ("outer", 7)):
        assert jn.equi_join(left, right, "k", "k", how).count() == n
    assert rows(jn.equi_join(left, right, "k", "k", "inner"), "l", "r") == [("a", 10), ("b", 20), ("e", 90)]
    tenth = spark.createDataFrame([(Decimal("1.50"),), (Decimal("2.00"),)], "k decimal(10,2)")
    assert jn.join_quality(tenth, spark.createDataFrame([(2,)], "k bigint"), "k", "k").first()["matched_keys"] == 1


def test_chain_after_a_clash_uses_the_right_column(spark):
    tables = {
        "deals": spark.createDataFrame([(1, 10, "deal name")], "deal_id int, account_id int, name string"),
        "accounts": spark.createDataFrame([(10, "acme")], "account_id int, name string"),
        "sectors": spark.createDataFrame([("acme", "steel"), ("deal name", "wrong")], "name string, sector string"),
    }
    chain = [jn.Candidate("deals", "accounts", "account_id", "account_id"), jn.Candidate("accounts", "sectors", "name", "name")]
    assert jn.build_chain(tables, chain).master.first()["sector"] == "steel"


def test_cell_changes_of_grown_tables_and_changed_types(spark):
    old = spark.createDataFrame([(1, "1.0", "x"), (2, "2.0", "y")], "id int, v string, w string")
    new = spark.createDataFrame([(1, 1.0, "x"), (2, 2.5, "z"), (3, 3.0, "w")], "id int, v double, w string")
    assert rows(ch.cell_changes(old, new, ["id"]), "column", "changed_cells") == [("v", 1), ("w", 1)]
    one = ch.diff(old, new, ["id"]).first()
    assert (one["changed_cells"], one["changed_columns"]) == (2, "v, w")


def test_unlisted_categories_stay(spark):
    deals = spark.createDataFrame(
        [(1, "A", "Closed Won", 5.0), (1, "New", "Closed Won", 5.0), (2, "New", "Closed Won", 7.0)],
        "account_id int, service_line string, stage string, deal_value double",
    )
    assert rows(qs.cross_sell(deals, ["A", "B"]), "account_id", "New", "missing_lines") == [(2, 7.0, "A, B")]
    wide = sh.pivot(deals, "account_id", "service_line", ["A"], {"n": F.count(F.lit(1))})
    assert rows(wide, "account_id", "A", "New") == [(1, 1, 1), (2, None, 1)]


def test_names_of_any_script_are_compared(spark):
    names = ["株式会社ソニー", "株式会社 ソニー", "Ünited", "nited", "---", "!!!"]
    df = spark.createDataFrame([(n,) for n in names], "account_name string")
    got = qs.duplicate_accounts(df, qs.name_key(F.col("account_name"))).collect()
    assert [r["accounts"] for r in got] == [2] and got[0]["name_key"] == "株式会社ソニー"


def test_links_of_all_spellings(spark):
    html = "<A HREF='//cdn.test/p'>x</A><a class=b href = \"/q\">y</a><a href='HTTP://c.test/'>z</a><a href='mailto:a'>m</a>"
    df = spark.createDataFrame([(1, "https://a.test/x", html)], "page_id int, url string, html string")
    assert [r["link"] for r in cp.links(df).orderBy("pos").collect()] == ["https://cdn.test/p", "https://a.test/q", "HTTP://c.test/"]


def test_decimals_are_counted_exactly_and_kept_in_matrices(spark):
    df = spark.createDataFrame([("a", Decimal(10**20)), ("b", Decimal(10**20 + 1))], "k string, v decimal(38,0)")
    counts = pf.distinct_counts(pf.value_counts({"t": df})).collect()
    assert {r["ordinal"]: r["distinct_count"] for r in counts}[1] == 2
    assert an.numeric_matrix(df, "k", "k").columns == ["k", "v"]


@pytest.mark.parametrize("values, last", [(["a", "b", "a"], "a"), (["a", "a", "b"], "b")])
def test_a_batch_may_revert_an_older_one(spark, tmp_path, values, last):
    folder, base = tmp_path / "in", str(tmp_path / "table")
    folder.mkdir()
    for n, value in enumerate(values):
        (folder / f"{n}.csv").write_text(f"k,v,seq\n1,{value},{n % 2}\n")
        stream = ingest.new_files(spark, str(folder), "k int, v string, seq int")
        ingest.upsert(stream, "t", base, str(tmp_path / "checkpoint"))
    assert ingest.current(spark, base, "k", "seq").first()["v"] == last
