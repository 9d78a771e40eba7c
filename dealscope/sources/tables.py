"""Files in and out: CSV, folders, Parquet copies, JSON lines, text, snapshots."""

from __future__ import annotations

import contextlib
import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.operators.profiling import _name, _text

NULL_CELLS = list(fv.NA_TOKENS)
VERSION_FORMAT = "%Y%m%dT%H%M%S_%fZ"


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """A1: every column as text, NA tokens as null; types are inferred afterwards.

    Quoted cells may hold line breaks, so files are split at record level only
    when ``multiLine`` is left off (the default, which keeps large files splittable).
    """
    raw = spark.read.options(header=True, inferSchema=False, escape='"', **options).csv(path)
    return blanks_to_null(raw)


def blanks_to_null(df: DataFrame, tokens=fv.NA_TOKENS) -> DataFrame:
    listed = ", ".join(_text(t) for t in tokens)
    return df.selectExpr(*[f"if({_name(c)} IN ({listed}), NULL, {_name(c)}) AS {_name(c)}" for c in df.columns])


def write_csv(df: DataFrame, path: str) -> str:
    """A CSV folder with a header per part; nothing is squeezed through one task."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def _located(spark: SparkSession, path: str):
    """A path and its file system: the one place that goes to Hadoop's classes (not there in Spark Connect)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _located(spark, path)
    fs.mkdirs(p)


def list_folder(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Names of the tables in a folder (not recursive): metadata, read through Hadoop's FS."""
    root, fs = _located(spark, folder)
    if not fs.exists(root):
        raise FileNotFoundError(f"no folder at {folder}")
    found = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(n for n in found if n.lower().endswith(suffix))


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and modification time of a file, or of the files in a folder that Spark would read; empty ones left out."""
    root, fs = _located(spark, path)
    if not fs.exists(root):
        raise FileNotFoundError(f"no file or folder at {path}")
    found = [s for s in fs.listStatus(root) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "._"]
    return [(s.getPath().toString(), s.getModificationTime()) for s in found]


@contextlib.contextmanager
def opened(spark: SparkSession, path: str):
    """The lines of a text file, read one by one as they are asked for (for headers)."""
    p, fs = _located(spark, path)
    java = spark._jvm.java.io
    reader = java.BufferedReader(java.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        yield iter(reader.readLine, None)
    finally:
        reader.close()


def create_empty(spark: SparkSession, path: str) -> bool:
    """Create an empty file in one step; False if it is there already."""
    p, fs = _located(spark, path)
    if fs.exists(p):
        return False
    try:
        fs.create(p, False).close()
    except Py4JJavaError:
        if fs.exists(p):  # another writer was faster
            return False
        raise
    return True


def source_keys(df: DataFrame) -> DataFrame:
    """Cache key of each source file, from its path and modification time."""
    path, changed = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
    files = df.select(path.alias("path"), F.unix_micros(changed).alias("changed"))
    key = F.substring(F.sha1(F.concat_ws("::", "path", F.col("changed").cast("string"))), 1, 16)
    return files.groupBy("path", "changed").agg(F.count("*").alias("n_rows")).select("path", key.alias("cache_key"), "n_rows")


def table_key(df: DataFrame) -> str:
    """One key for all source files of a table, whatever their order; any file's change changes it."""
    files = source_keys(df)
    summed = files.agg(
        F.count("*").alias("n"),
        F.sum(F.conv("cache_key", 16, 10).cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64("path", "cache_key")).alias("x"),
    )
    return summed.select(F.substring(F.sha1(F.concat_ws(":", "n", "s", "x")), 1, 16)).first()[0]


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The Parquet copy under ``key``; built and written once, then read. A broken write is written anew."""
    path = f"{folder}/{key}.parquet"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _located(spark, path)
    return fs.exists(p)


def invalidate(spark: SparkSession, folder: str, key: str) -> bool:
    p, fs = _located(spark, f"{folder}/{key}.parquet")
    return fs.delete(p, True)


def cached_keys(spark: SparkSession, folder: str) -> list[str]:
    return [n.removesuffix(".parquet") for n in list_folder(spark, folder, ".parquet")]


# --- snapshots -----------------------------------------------------------------


def version_path(base: str, table: str, version: str) -> str:
    safe = table.replace("/", "_").replace("\\", "_")
    return f"{base}/table={safe}/version={version}"


def save_version(df: DataFrame, base: str, table: str, at: dt.datetime) -> str:
    """A new immutable snapshot folder named by the given time; returns its version."""
    version = at.strftime(VERSION_FORMAT)
    df.write.mode("error").parquet(version_path(base, table, version))
    return version


def load_version(spark: SparkSession, base: str, table: str, version: str) -> DataFrame:
    """Read one snapshot (rollback)."""
    return spark.read.parquet(version_path(base, table, version))


def list_versions(spark: SparkSession, base: str, table: str) -> DataFrame:
    """Versions newest first with row counts; a Parquet count reads footers only."""
    safe = table.replace("/", "_").replace("\\", "_")
    return (
        spark.read.option("mergeSchema", False)
        .parquet(f"{base}/table={safe}")
        .groupBy(F.col("version").cast("string").alias("version"))
        .agg(F.count("*").alias("row_count"))
        .orderBy(F.col("version").desc())
    )


# --- JSON lines ------------------------------------------------------------------


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A10: JSON lines with an explicit schema; malformed and blank lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> str:
    """JSON lines, one file per task."""
    df.write.mode("append" if append else "error").json(path)
    return path


# --- text ------------------------------------------------------------------------


def write_lines(df: DataFrame, path: str, order: list[str], line: str = "line") -> str:
    """A text report; parts in range order, so their names give the line order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("error").text(path)
    return path


def read_text_tree(spark: SparkSession, base: str) -> DataFrame:
    """Whole text files below ``base`` with source type and date from their paths.

    ``base/*.txt`` is reference text, ``scraped/**/*.txt`` takes its folder name as
    source type and ``meeting_notes/notes_YYYYMMDD.txt`` its date from the file name.
    """
    files = (
        spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    folder = F.regexp_extract("path", "([^/]+)/[^/]+$", 1)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.txt$", "")
    date = F.regexp_extract(name, r"^notes_(.+)\.txt$", 1)
    is_note = folder == "meeting_notes"
    keep = F.when(is_note, date != "").otherwise(
        (folder == "base") | F.col("path").contains("/scraped/")
    )
    prefix = (
        F.when(folder == "base", F.concat(F.lit("base_"), stem))
        .when(is_note, F.concat(F.lit("note_"), date))
        .otherwise(F.concat(F.lit("scraped_"), folder, F.lit("_"), stem))
    )
    return files.filter(keep).select(
        prefix.alias("prefix"),
        folder.alias("source_type"),
        name.alias("source_file"),
        F.when(is_note, date).alias("date"),
        F.col("value").alias("text"),
    )
