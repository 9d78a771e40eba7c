"""Sources and sinks on small files."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from dealscope.operators import quality as ql
from dealscope.session import scratch_path, shared_folder
from dealscope.sources import benchmarks as bm
from dealscope.sources import loading as ld
from dealscope.sources import tables as src


def test_csv_reads_text_and_nulls(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([("1", "N/A"), ("2", ""), ('say "hi", you', "x")], "a string, b string")
    src.write_csv(df, path)
    got = sorted(map(tuple, src.read_csv(spark, path).collect()))
    assert got == [("1", None), ("2", None), ('say "hi", you', "x")]


def test_missing_folder(spark):
    with pytest.raises(FileNotFoundError):
        ld.load(spark, scratch_path(spark, "none"))


def test_parquet_copies(spark):
    folder, built = scratch_path(spark, "copies"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert src.cached(spark, folder, "k1", build).count() == 3
    assert src.cached(spark, folder, "k1", build).count() == 3 and len(built) == 1
    assert src.cached_keys(spark, folder) == ["k1"]
    assert src.invalidate(spark, folder, "k1") and src.cached_keys(spark, folder) == []


def test_versions_newest_first(spark):
    base = scratch_path(spark, "versions")
    names = [src.save_version(spark.range(n), base, "a/b", dt.datetime(2024, 1, n)) for n in (1, 2, 3)]
    assert [tuple(r) for r in src.list_versions(spark, base, "a/b").collect()] == [
        (names[2], 3), (names[1], 2), (names[0], 1),
    ]
    assert src.load_version(spark, base, "a/b", names[0]).count() == 1


def test_text_tree(spark):
    base = pathlib.Path(scratch_path(spark, "tree"))
    for name, text in {
        "base/glossary.txt": "terms\nhere", "scraped/news/a.txt": "story", "scraped/x/trade/b.txt": "deep",
        "meeting_notes/notes_20240105.txt": "met", "meeting_notes/other.txt": "no", "stray.txt": "no",
    }.items():
        file = base / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = {tuple(r) for r in src.read_text_tree(spark, str(base)).collect()}
    assert got == {
        ("base_glossary", "base", "glossary.txt", None, "terms\nhere"),
        ("scraped_news_a", "news", "a.txt", None, "story"),
        ("scraped_trade_b", "trade", "b.txt", None, "deep"),
        ("note_20240105", "meeting_notes", "notes_20240105.txt", "20240105", "met"),
    }


def test_lines_are_written_in_order(spark):
    path = scratch_path(spark, "lines")
    df = spark.range(500).select(F.col("id"), F.format_string("line %d", "id").alias("line"))
    src.write_lines(df.orderBy(F.rand(1)), path, ["id"])
    parts = sorted(pathlib.Path(path).glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text.splitlines() == [f"line {i}" for i in range(500)]


def test_benchmark_rows(spark):
    rows = {(r[0], r[1], r[2]): (r[3], r[4]) for r in bm.benchmark_rows()}
    assert rows[("win_rates", "competitive_tender", "median")] == (28.0, "28")
    assert rows[("average_deal_size", "fm_sector_median", "value")] == (None, "£210k (BIFM 2024)")


def test_nested_report(spark):
    tables = spark.createDataFrame([("t", 4, 1, 2, 50.0, 0.0, "")],
                                   "table string, row_count bigint, col_count bigint, duplicate_rows bigint, "
                                   "duplicate_pct double, overall_null_pct double, empty_columns string")
    issues = ql.table_issues(tables)
    report = ql.nested_report(tables, issues).first()["report"]
    assert '"issues":[{"severity":"error","rule":"DUPLICATE_ROWS","affected_rows":2' in report.replace('"column":null,', "")


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or shared_folder(spark) == named.rstrip("/")
