"""Load CSV tables from a folder or a list of paths: bad rows apart, copies reused, counts from the pass that loads.

A table is one CSV file or a folder of CSV parts. Its files' headers are read first (one line a file); files of
equal header are read together, and a file that lacks columns of the others gives null there. Each row goes
through one pass: it is parsed, counted by an ``Observation`` and written to the table's Parquet copy, rows with
too few, too many or broken cells in a folder of their own. The copy's key comes from the paths and modification
times of the files, so an unchanged table is read from its copy, with the counts stored beside it.

A table that cannot be read is a failed status row; the others load.
"""

from __future__ import annotations

import csv
import hashlib
import io
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscope.session import scratch_path
from dealscope.sources import tables as src

BAD = "_corrupt_record"
STATUS = (
    "name string, status string, n_columns int, n_rows bigint, n_bad bigint, missing_columns array<string>, "
    "cache string, error string"
)
BAD_ROWS = "name string, file string, record string"


class Loaded(NamedTuple):
    """``tables``: good rows by table name; ``bad_rows``: (name, file, record); ``status``: one row per table."""

    tables: dict[str, DataFrame]
    bad_rows: DataFrame
    status: DataFrame


class _Counts(NamedTuple):
    rows: int
    bad: int
    missing: list[str]


def load(spark: SparkSession, sources: str | list[str], cache: str | None = None, **options) -> Loaded:
    """Every ``.csv`` of a folder, or of a list of paths; ``cache`` is the folder of the copies (a new one if none).

    Quoted cells may hold line breaks if ``multiLine=True`` is given; files are not split then.
    """
    if isinstance(sources, str):
        sources = [f"{sources.rstrip('/')}/{name}" for name in src.list_folder(spark, sources)]
    cache = cache or scratch_path(spark, "loaded")
    tables, bad, status = {}, [], []
    for path in sources:
        name = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
        try:
            good, broken, counts, hit = _load_table(spark, path.rstrip("/"), cache, options)
        except Exception as exc:  # isolate the failure to this table
            status.append((name, "failed", 0, 0, 0, [], None, str(exc).split("\n")[0][:200]))
            continue
        tables[name] = good
        if counts.bad:
            bad.append(broken.select(F.lit(name).alias("name"), "file", "record"))
        status.append(
            (name, "loaded", len(good.columns), counts.rows, counts.bad, counts.missing, "hit" if hit else "miss", None)
        )
    bad_rows = spark.createDataFrame([], BAD_ROWS)
    for one in bad:
        bad_rows = bad_rows.unionByName(one)
    return Loaded(tables, bad_rows, spark.createDataFrame(status, STATUS))


def _load_table(spark, path: str, cache: str, options: dict) -> tuple[DataFrame, DataFrame, _Counts, bool]:
    files = src.data_files(spark, path)
    if not files:
        raise ValueError("no data files")
    stamp = "".join(f"{file}::{changed}\n" for file, changed in sorted(files)) + repr(sorted(options.items()))
    copy = f"{cache}/{hashlib.sha1(stamp.encode()).hexdigest()[:16]}"
    hit = src.path_exists(spark, f"{copy}/counts/_SUCCESS")
    if not hit:
        _copy_table(spark, [f for f, _ in files], copy, options)
    found = spark.read.json(f"{copy}/counts", schema="rows bigint, bad bigint, missing array<string>, columns array<string>").first()
    # the schema is stated, so that a copy of no rows is a table too
    schema = T.StructType([T.StructField(c, T.StringType()) for c in found["columns"]])
    good = spark.read.schema(schema).parquet(f"{copy}/rows/_bad=false")
    broken = spark.read.schema("_file string, _corrupt_record string").parquet(f"{copy}/rows/_bad=true") if found["bad"] else None
    if broken is not None:
        broken = broken.select(F.col("_file").alias("file"), F.col(BAD).alias("record"))
    return good, broken, _Counts(found["rows"], found["bad"], list(found["missing"])), hit


def _copy_table(spark, files: list[str], copy: str, options: dict) -> None:
    """One pass over the files of a table: good rows, bad rows and the counts of both."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in files:
        header = _header(spark, file)
        if header:
            groups.setdefault(header, []).append(file)
    if not groups:
        raise ValueError("no columns")
    columns = list(dict.fromkeys(c for header in groups for c in header))
    missing = sorted(c for c in columns if any(c not in header for header in groups))
    rows = None
    for header, own in groups.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, BAD]])
        one = spark.read.options(header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, **options).schema(schema).csv(own)
        one = one.withColumn("_file", F.col("_metadata.file_path"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    good = F.col(BAD).isNull()
    cell = lambda c: F.when(good & ~F.col(src._name(c)).isin(src.NULL_CELLS), F.col(src._name(c))).alias(c)
    rows = rows.select(*[cell(c) for c in columns], "_file", BAD, (~good).alias("_bad"))
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad")).write.mode("overwrite").partitionBy("_bad").parquet(f"{copy}/rows")
    found = seen.get
    src.make_folder(spark, f"{copy}/rows/_bad=false")
    counts = [(found["rows"] - found["bad"], found["bad"], missing, columns)]
    spark.createDataFrame(counts, "rows bigint, bad bigint, missing array<string>, columns array<string>").coalesce(1).write.mode("overwrite").json(f"{copy}/counts")


def _header(spark, file: str) -> tuple[str, ...]:
    """The column names in a file's first record; blank and repeated ones get their position."""
    with src.opened(spark, file) as lines:
        text = ""
        for line in lines:
            text += line + "\n"
            if text.count('"') % 2 == 0:
                break
    cells = next(csv.reader(io.StringIO(text.lstrip("﻿"))), [])
    names, used = [], set()
    for i, cell in enumerate(cells):
        name = cell.strip() or f"_c{i}"
        names.append(name if name.lower() not in used else f"{name}{i}")
        used.add(names[-1].lower())
    return tuple(names)


def load_summary(status: DataFrame) -> DataFrame:
    """A5: tables found, loaded and failed, rows, bad rows, columns, copies reused and made, and the errors."""
    error = F.when(F.col("status") == "failed", F.concat_ws(": ", "name", "error"))
    return status.agg(
        F.count("*").alias("files_found"),
        F.count_if(F.col("status") == "loaded").alias("files_loaded"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("n_bad"), F.lit(0)).alias("bad_rows"),
        F.coalesce(F.sum("n_columns"), F.lit(0)).alias("total_columns"),
        F.count_if(F.col("cache") == "hit").alias("cache_hits"),
        F.count_if(F.col("cache") == "miss").alias("cache_misses"),
        F.array_join(F.array_sort(F.collect_list(error)), "; ").alias("errors"),
    )
