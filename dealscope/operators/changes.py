"""Table changes: fingerprints, classification, diffs, merges, stale answers.

Every comparison aligns rows by column name and explicit keys; row order plays no
part. Row sets are compared by grouping the digests of rows once (combined on the map
side), which yields added and removed rows in one narrow shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.functions.numbers import fraction_form_sql, ratio, whole_form_sql
from dealscope.functions.ordering import first_per_group
from dealscope.operators.profiling import _name, _text, _value, digest_sql, kind_of
from dealscope.session import scratch_path
from dealscope.sources import tables as src

CLASSES = ("NEW_TABLE", "UPDATED_VERSION", "CORRECTED_DATA", "DUPLICATE")


def fingerprint(df: DataFrame, table: str, registered_at: str, file_hash: str = "") -> DataFrame:
    """Row count, columns, column hash and an order-free row hash, in one scan.

    The row hash covers every row: count, sum and xor of a 64-bit hash over
    (is-null, value) pairs of the columns in name order.
    """
    names = sorted(df.columns)
    marked = ", ".join(f"{_name(c)} IS NULL, {_name(c)}" for c in names)
    listed = ", ".join(_text(c) for c in names)
    given = ", ".join(_text(c) for c in df.columns)
    return df.selectExpr(f"xxhash64({marked}) AS h").selectExpr(
        f"{_text(table)} AS `table`",
        "count(*) AS row_count",
        f"array({given}) AS columns",
        f"md5(array_join(array_sort(array({listed})), '|')) AS col_hash",
        "md5(concat_ws(':', count(*), coalesce(sum(CAST(h AS DECIMAL(38,0))), 0), coalesce(bit_xor(h), 0))) AS row_hash",
        f"{_text(registered_at)} AS registered_at",
        f"{_text(file_hash)} AS file_hash",
    )


def classify(new: DataFrame, registry: DataFrame) -> DataFrame:
    """Class of each fingerprint against the registry (one row per table on both sides)."""
    old = registry.select(
        "table",
        F.col("col_hash").alias("old_col_hash"),
        F.col("row_hash").alias("old_row_hash"),
        F.col("row_count").alias("old_row_count"),
    )
    same_columns = F.col("col_hash") == F.col("old_col_hash")
    return new.join(old, "table", "left").withColumn(
        "class",
        F.when(F.col("old_col_hash").isNull(), "NEW_TABLE")
        .when(same_columns & (F.col("row_hash") == F.col("old_row_hash")), "DUPLICATE")
        .when(same_columns & (F.col("row_count") == F.col("old_row_count")), "CORRECTED_DATA")
        .otherwise("UPDATED_VERSION"),
    )


def register(registry: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The registry with the given fingerprints replacing those of the same table."""
    return registry.join(fingerprints.select("table"), "table", "left_anti").unionByName(
        fingerprints.select(*registry.columns)
    )


def _row_cells(df: DataFrame, other: DataFrame) -> list[str]:
    """Cells in column order of name: as they are where both tables have one type, else in the form both share."""
    theirs = {f.name: f.dataType for f in other.schema.fields}
    cells = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        v, kind = _value(f), kind_of(f.dataType)
        twin = theirs.get(f.name)
        if twin is None or twin == f.dataType:
            cells.append(v)
        elif kind == kind_of(twin) == "number":
            whole = f.dataType.typeName() in ("byte", "short", "integer", "long")
            cells.append(whole_form_sql(v) if whole else fraction_form_sql(v, f.dataType.typeName() == "decimal"))
        elif kind == kind_of(twin) == "date":
            cells.append(f"CAST({v} AS TIMESTAMP_NTZ)")
        else:
            cells.append(f"CAST({v} AS STRING)")
    return cells


def row_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows only in new and only in old; tables of other columns share no row.

    Digests of rows are compared. A column whose type differs compares by value (1 is 1.0, a date its midnight).
    """
    sides = [df.selectExpr(*digest_sql(_row_cells(df, other)), f"{n} AS _new") for n, (df, other) in enumerate(((old, new), (new, old)))]
    if set(old.columns) != set(new.columns):
        added, removed = (
            side.select("h1", "h2").distinct().agg(F.count("*").alias(name))
            for side, name in ((sides[1], "rows_added"), (sides[0], "rows_removed"))
        )
        return added.withColumn("rows_removed", removed.scalar())
    both = sides[0].unionByName(sides[1]).groupBy("h1", "h2").agg(F.max("_new").alias("_hi"), F.min("_new").alias("_lo"))
    return both.agg(
        F.count_if(F.col("_lo") == 1).alias("rows_added"),
        F.count_if(F.col("_hi") == 0).alias("rows_removed"),
    )


def column_changes(old: DataFrame, new: DataFrame) -> dict[str, list[str]]:
    return {
        "new_columns": sorted(set(new.columns) - set(old.columns)),
        "removed_columns": sorted(set(old.columns) - set(new.columns)),
    }


def _aligned(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    shared = [c for c in sorted(set(old.columns) & set(new.columns)) if c not in keys]
    types = [dict((f.name, f.dataType) for f in df.schema.fields) for df in (old, new)]

    def cell(column: str):
        """The cell itself, or its text where the column's type has changed."""
        value = F.col(_name(column))
        return value if types[0][column] == types[1][column] else value.cast("string")

    left = old.select(*[_name(k) for k in keys], *[cell(c).alias(f"o_{c}") for c in shared])
    right = new.select(*[_name(k) for k in keys], *[cell(c).alias(f"n_{c}") for c in shared])
    return left.join(right, keys, "inner"), shared


def cell_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changed cells per shared column over rows aligned by key."""
    joined, shared = _aligned(old, new, keys)
    aggs = [f"count_if(NOT ({_name('o_' + c)} <=> {_name('n_' + c)})) AS c{i}" for i, c in enumerate(shared)]
    rows = [f"struct({_text(c)} AS `column`, c{i} AS changed_cells)" for i, c in enumerate(shared)]
    return joined.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))").filter("changed_cells > 0")


def change_samples(old: DataFrame, new: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` changed cells per column in key order (``n`` rows leave each task)."""
    joined, shared = _aligned(old, new, keys)
    cells = [
        f"struct({_text(c)} AS `column`, CAST({_name('o_' + c)} AS STRING) AS old_value, "
        f"CAST({_name('n_' + c)} AS STRING) AS new_value, NOT ({_name('o_' + c)} <=> {_name('n_' + c)}) AS changed)"
        for c in shared
    ]
    keyed = [_name(k) for k in keys]
    changed = joined.selectExpr(*keyed, f"inline(array({', '.join(cells)}))").filter("changed")
    return first_per_group(changed.drop("changed"), ["column"], [F.col(k) for k in keyed], n)


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row with row, column and cell changes and the summary sentence.

    Rows are aligned by key, so cell changes count whatever the two sizes are; all
    changed columns are named.
    """
    columns = column_changes(old, new)
    cells = cell_changes(old, new, keys).agg(
        F.coalesce(F.sum("changed_cells"), F.lit(0)).alias("n"),
        F.sort_array(F.collect_list("column")).alias("c"),
    )
    base = row_changes(old, new).withColumn("_c", cells.select(F.struct("n", "c")).scalar())
    base = base.select(
        "rows_added",
        "rows_removed",
        F.lit(len(columns["new_columns"])).cast("bigint").alias("columns_added"),
        F.lit(len(columns["removed_columns"])).cast("bigint").alias("columns_removed"),
        F.col("_c.n").cast("bigint").alias("changed_cells"),
        F.array_join("_c.c", ", ").alias("changed_columns"),
    )
    return base.withColumn("summary", summary_text())


def summary_text():
    """U4: the changes as one sentence."""

    def part(count: str, one: str, many: str):
        c = F.col(count)
        return F.when(c == 1, F.lit("1 " + one)).when(c > 1, F.concat(c.cast("string"), F.lit(" " + many)))

    corrected = F.when(
        F.col("changed_cells") > 0,
        F.concat(
            F.col("changed_cells").cast("string"),
            F.when(F.col("changed_cells") == 1, " value").otherwise(" values"),
            F.lit(" corrected in "),
            F.col("changed_columns"),
        ),
    )
    text = F.concat_ws(
        ", ",
        part("rows_added", "new row", "new rows"),
        part("rows_removed", "row removed", "rows removed"),
        part("columns_added", "new column", "new columns"),
        part("columns_removed", "column removed", "columns removed"),
        corrected,
    )
    return F.when(text == "", "No changes detected").otherwise(text)


def merge_latest(
    old: DataFrame, new: DataFrame, key: str, sequence: str | None = None
) -> DataFrame:
    """Rows of both tables, the newest per key; missing columns become null.

    ``sequence`` orders rows of one side that share a key; without it such ties fall
    to the remaining column values, so the result does not depend on task order.
    """
    for name, df in (("old", old), ("new", new)):
        if key not in df.columns:
            raise ValueError(f"key column '{key}' is not in the {name} table: {df.columns}")
    both = old.withColumn("_side", F.lit(0)).unionByName(
        new.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    rest = [F.col(_name(c)).desc() for c in both.columns if c not in (key, "_side", sequence)]
    order = [F.col("_side").desc()]
    if sequence:
        order.append(F.col(_name(sequence)).desc())
    return first_per_group(both, [_name(key)], order + rest).drop("_side")


def stale_answers(answers: DataFrame, updates: DataFrame, threshold: float = 0.10) -> DataFrame:
    """U8: answers on tables whose row count moved by more than ``threshold``.

    An unknown or empty old table makes its answers stale too.
    """
    change = ratio(F.abs(F.col("row_count") - F.col("old_row_count")), F.col("old_row_count"))
    moved = updates.select("table", (change.isNull() | (change > threshold)).alias("moved"))
    return answers.join(F.broadcast(moved), "table", "left").withColumn(
        "stale", F.coalesce(F.col("moved"), F.lit(False))
    ).drop("moved")


def process_update(
    name: str, df: DataFrame, registry: DataFrame, old: DataFrame | None, keys: list[str], at: str
) -> tuple[DataFrame, DataFrame | None]:
    """The classified fingerprint and, unless a duplicate or new, the diff."""
    classified = classify(fingerprint(df, name, at), registry)
    found = classified.collect()  # one row: what the scan found is returned, not scanned for again
    classified = df.sparkSession.createDataFrame(found, classified.schema)
    if found[0]["class"] == "DUPLICATE" or old is None:
        return classified, None
    return classified, diff(old, df, keys)


def load_update(
    spark: SparkSession,
    name: str,
    df: DataFrame,
    registry: DataFrame,
    base: str,
    at: dt.datetime,
    current: str | None = None,
) -> tuple[str, str | None, DataFrame]:
    """Classify, write the new version unless duplicate, and return the new registry.

    Versions are immutable folders; the caller keeps the returned version as the
    current one, so a folder that is being read is never overwritten.
    """
    prints = fingerprint(df, name, at.strftime("%Y-%m-%dT%H:%M:%S"))
    path = scratch_path(spark, "fingerprint")
    classify(prints, registry).write.parquet(path)
    classified = spark.read.parquet(path)
    label = classified.select("class").first()[0]
    if label == "DUPLICATE":
        return label, current, registry
    version = src.save_version(df, base, name, at)
    return label, version, register(registry, classified)


