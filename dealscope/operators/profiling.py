"""Table profiles.

Per table: one wide aggregate (a single scan, one row per task into the final
step) gives null counts, moments and quantile sketches for every column. Exact
distinct counts, medians and top values come from value counts per column, which
are combined on the map side, so a value held by a third of the rows is one row
per task. No exact median buffer and no per-column window over raw rows exists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscope import fixed_values as fv
from dealscope.functions.names import profile_type
from dealscope.functions.numbers import ratio
from dealscope.functions.ordering import first_per_group
from dealscope.functions.selection import medians
from dealscope.session import delete_path, scratch_path

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, _INTEGRAL + _FLOATING):
        return "number"
    return "date" if isinstance(data_type, _DATES) else "text"


# Generated per-column expressions are SQL text: one parse in the JVM per column
# instead of dozens of small calls from Python.


def _name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _value(field: T.StructField) -> str:
    """The column with NaN as null."""
    c = _name(field.name)
    floating = isinstance(field.dataType, (T.FloatType, T.DoubleType))
    return f"nullif({c}, double('NaN'))" if floating else c


def _missing(field: T.StructField) -> str:
    return f"{_value(field)} IS NULL"


def _cell(field: T.StructField) -> tuple[str, str]:
    """Physical family of a column and its cell in that family.

    Whole numbers keep all 64 bits in ``l``, decimals all digits in one family per
    scale (``m2``, ...), floating numbers are in ``d``, dates as
    microseconds in ``t`` (no session time zone involved) and the rest in ``s``.
    """
    v = _value(field)
    if isinstance(field.dataType, T.TimestampType):
        return "t", f"unix_micros({v})"
    if isinstance(field.dataType, _DATES):
        return "t", f"timestampdiff(MICROSECOND, {_EPOCH}, CAST({v} AS TIMESTAMP_NTZ))"
    if isinstance(field.dataType, _INTEGRAL):
        return "l", f"CAST({v} AS BIGINT)"
    if isinstance(field.dataType, T.DecimalType):
        return f"m{field.dataType.scale}", f"CAST({v} AS DECIMAL(38,{field.dataType.scale}))"
    if isinstance(field.dataType, _FLOATING):
        return "d", f"CAST({v} AS DOUBLE)"
    return "s", f"CAST({v} AS STRING)"


def value_counts(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Counts per (ordinal, value), one narrow frame per physical family.

    Ordinals number the columns of all tables in turn. Each family reads its own
    columns only and counts on the map side, so a hot value is one row per task.
    """
    rows, offsets = {}, _offsets(tables)
    for name, df in tables.items():
        families = {}
        for i, field in enumerate(df.schema.fields):
            family, cell = _cell(field)
            families.setdefault(family, []).append(
                f"struct({offsets[name] + i} AS ordinal, {cell} AS value)"
            )
        for family, cells in families.items():
            long = df.selectExpr(f"inline(array({', '.join(cells)}))").filter("value IS NOT NULL")
            rows.setdefault(family, []).append(long)
    return {
        family: _union(parts).groupBy("ordinal", "value").agg(F.count("*").alias("n"))
        for family, parts in rows.items()
    }


def distinct_counts(counts: dict[str, DataFrame], name: str = "distinct_count") -> DataFrame:
    """(ordinal, distinct count): one row per column that has any value.

    Counting by ``n`` keeps the counts in the plan, so this and the medians read
    the same exchange.
    """
    sized = [c.groupBy("ordinal").agg(F.count_if(F.col("n") > 0).alias(name)) for c in counts.values()]
    return _union(sized)


def _facts(df: DataFrame, table: str, as_of: str, offset: int = 0) -> DataFrame:
    """One row per column from a single wide aggregate."""
    aggs, rows = ["count(*) AS rows"], []
    for i, f in enumerate(df.schema.fields):
        v, kind = _value(f), kind_of(f.dataType)
        name_type = profile_type(f.name, kind)
        fact = {
            "ordinal": str(offset + i),
            "table": _text(table),
            "column": _text(f.name),
            "dtype": _text(f.dataType.simpleString()),
            "kind": _text(kind),
            "name_type": f"CAST({_text(name_type) if name_type else 'NULL'} AS STRING)",
            "row_count": "rows",
            "null_count": f"null{i}",
            "min_num": "CAST(NULL AS DOUBLE)",
            "max_num": "CAST(NULL AS DOUBLE)",
            "mean": "CAST(NULL AS DOUBLE)",
            "std": "CAST(NULL AS DOUBLE)",
            "zero_count": "0L",
            "negative_count": "0L",
            "min_date": "CAST(NULL AS STRING)",
            "max_date": "CAST(NULL AS STRING)",
            "future_count": "0L",
        }
        aggs.append(f"count_if({_missing(f)}) AS null{i}")
        if kind == "number":
            x = f"CAST({v} AS DOUBLE)"
            aggs += [f"count_if({x} = 0) AS zero{i}", f"count_if({x} < 0) AS neg{i}"]
            fact |= {"zero_count": f"zero{i}", "negative_count": f"neg{i}"}
            aggs += [
                f"round(min({x}), 4) AS min{i}",
                f"round(max({x}), 4) AS max{i}",
                f"round(avg({x}), 4) AS avg{i}",
                f"if(count({x}) > 0, round(coalesce(stddev_samp({x}), 0D), 4), NULL) AS std{i}",
            ]
            fact |= {"min_num": f"min{i}", "max_num": f"max{i}", "mean": f"avg{i}", "std": f"std{i}"}
        elif kind == "date":
            today = f"CAST({_text(as_of)} AS {f.dataType.simpleString()})"
            aggs += [
                f"CAST(min(CAST({v} AS DATE)) AS STRING) AS dmin{i}",
                f"CAST(max(CAST({v} AS DATE)) AS STRING) AS dmax{i}",
                f"count_if({v} > {today}) AS fut{i}",
            ]
            fact |= {"min_date": f"dmin{i}", "max_date": f"dmax{i}", "future_count": f"fut{i}"}
        rows.append("struct(" + ", ".join(f"{e} AS `{n}`" for n, e in fact.items()) + ")")
    return df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(rows)}))")


def _number_facts(counts: dict[str, DataFrame]) -> DataFrame:
    """ordinal, distinct_count, median of every number column: one row each, worked out by repeated selection.

    The value counts are stored for the passes over them and deleted behind them.
    """
    families = [c for family, c in counts.items() if family[0] in "ldm"]
    spark = families[0].sparkSession
    path = scratch_path(spark, "value-counts")
    # one row per exact value, so counting rows counts distinct values although they are compared as doubles
    rows = _union([c.select(F.col("ordinal").cast("int").alias("ordinal"), F.col("value").cast("double").alias("value"), "n") for c in families])
    rows.write.parquet(path)
    found = medians(spark.read.parquet(path))
    delete_path(spark, path)
    listed = [(ordinal, f.distinct, f.median) for ordinal, f in found.items()]
    facts = spark.createDataFrame(listed, "ordinal int, distinct_count bigint, middle double")
    return facts.select("ordinal", "distinct_count", F.round("middle", 4).alias("median"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _offsets(tables: dict[str, DataFrame]) -> dict[str, int]:
    offsets, total = {}, 0
    for name, df in tables.items():
        offsets[name], total = total, total + len(df.columns)
    return offsets


def _null_pct(digits: int = 2) -> Column:
    rate = F.coalesce(ratio(F.col("null_count"), F.col("row_count")), F.lit(0.0))
    return F.round(rate * 100, digits).alias("null_pct")


def profile_all(
    tables: dict[str, DataFrame],
    as_of: str,
    types: dict[str, str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """One row per column of every table.

    The cells of all tables go through one value-count shuffle. ``types`` overrides
    the name heuristic with inferred semantic types. ``exact=False`` replaces
    distinct counts by sketches and medians by the approximate quantile, which
    shuffles no values at all.
    """
    offsets = _offsets(tables)
    facts = _union([_facts(df, t, as_of, offsets[t]) for t, df in tables.items()])
    if exact:
        counts = value_counts(tables)
        numbers = {family: c for family, c in counts.items() if family[0] in "ldm"}
        others = {family: c for family, c in counts.items() if family not in numbers}
        parts = [distinct_counts(others).withColumn("median", F.lit(None).cast("double"))] if others else []
        if numbers:
            parts.append(_number_facts(numbers))
        out = facts.join(F.broadcast(_union(parts)), "ordinal", "left")
    else:
        out = facts.join(
            F.broadcast(_union([_sketched(df, offsets[t]) for t, df in tables.items()])), "ordinal"
        )
    guess = F.coalesce(
        F.col("name_type"),
        F.when(F.col("distinct_count") <= fv.MAX_CATEGORIES, "categorical").otherwise("text"),
    )
    if types:
        given = F.create_map(*[x for k, v in types.items() for x in (F.lit(k), F.lit(v))])
        guess = F.coalesce(given[F.col("column")], guess)
    distinct_count = F.coalesce(F.col("distinct_count"), F.lit(0).cast("bigint"))
    out = out.withColumn("distinct_count", distinct_count)
    return out.select(
        "table",
        "column",
        "dtype",
        guess.alias("semantic"),
        "row_count",
        "null_count",
        _null_pct(),
        "distinct_count",
        "min_num",
        "max_num",
        "mean",
        "std",
        "median",
        "zero_count",
        "negative_count",
        "min_date",
        "max_date",
        "future_count",
    )


def profile_columns(df: DataFrame, table: str, as_of: str, **options) -> DataFrame:
    """The column profile of one table."""
    return profile_all({table: df}, as_of, **options)


def _sketched(df: DataFrame, offset: int) -> DataFrame:
    rows = []
    for i, f in enumerate(df.schema.fields):
        middle = "CAST(NULL AS DOUBLE)"
        if kind_of(f.dataType) == "number":
            middle = f"percentile_approx(CAST({_value(f)} AS DOUBLE), 0.5D)"
        rows.append(
            f"struct({offset + i} AS ordinal, approx_count_distinct({_value(f)}) AS distinct_count, "
            f"{middle} AS median)"
        )
    return df.selectExpr(f"array({', '.join(rows)}) AS s").selectExpr("inline(s)")


def null_rates(df: DataFrame, table: str) -> DataFrame:
    """E3/S8 without distinct counts: one scan, one row per task shuffled."""
    fields = df.schema.fields
    one = df.selectExpr(
        "count(*) AS rows", *[f"count_if({_missing(f)}) AS n{i}" for i, f in enumerate(fields)]
    )
    rows = [
        f"struct({_text(table)} AS `table`, {_text(f.name)} AS `column`, "
        f"{_text(f.dataType.simpleString())} AS dtype, rows AS row_count, n{i} AS null_count)"
        for i, f in enumerate(fields)
    ]
    return one.selectExpr(f"inline(array({', '.join(rows)}))").select("*", _null_pct())


def all_null_rates(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([null_rates(df, name) for name, df in tables.items()])


def top_values(df: DataFrame, table: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each text column, ties by value."""
    texts = [f.name for f in df.schema.fields if kind_of(f.dataType) in ("text", "boolean")]
    label = F.array(*[F.lit(x) for x in texts])
    counts = value_counts({table: df.select(*texts)})["s"]
    order = [F.col("n").desc(), F.col("value")]
    rank = F.row_number().over(Window.partitionBy("ordinal").orderBy(*order))
    return first_per_group(counts, ["ordinal"], order, n).select(
        F.lit(table).alias("table"),
        F.get(label, F.col("ordinal")).alias("column"),
        rank.cast("bigint").alias("rank"),
        "value",
        F.col("n").alias("value_count"),
    )


def sample_values(df: DataFrame, table: str, n: int = 10) -> DataFrame:
    """The first ``n`` distinct values (in value order) and the distinct count per column.

    Both start from the value counts; per column only ``n`` values leave each task.
    """
    label = F.array(*[F.lit(x) for x in df.columns])
    counts = value_counts({table: df})
    shown = {f: F.col("v").cast("string") for f in counts}
    shown["t"] = F.expr(f"CAST(timestampadd(MICROSECOND, v, {_EPOCH}) AS STRING)")
    firsts = []
    for family, c in counts.items():
        top = first_per_group(c.withColumnRenamed("value", "v"), ["ordinal"], [F.col("v")], n)
        pairs = F.array_sort(F.collect_list(F.struct("v", shown[family].alias("shown"))))
        listed = top.groupBy("ordinal").agg(F.array_join(F.transform(pairs, lambda p: p["shown"]), "|").alias("samples"))
        firsts.append(listed)
    return _union(firsts).join(F.broadcast(distinct_counts(counts)), "ordinal").select(
        F.lit(table).alias("table"),
        F.get(label, F.col("ordinal")).alias("column"),
        "samples",
        "distinct_count",
    )


def digest_sql(cells: list[str]) -> list[str]:
    """A row's 128-bit digest as two 64-bit hashes of its cells, null marks among them."""
    marked = ", ".join(f"{c} IS NULL, {c}" for c in cells)
    return [f"xxhash64({marked}) AS h1", f"xxhash64('', {marked}) AS h2"]


def _cells(df: DataFrame) -> list[str]:
    return [_value(f) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else _name(f.name) for f in df.schema.fields]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each distinct row; digests are grouped, so no row crosses the network."""
    counted = df.selectExpr(*digest_sql(_cells(df))).groupBy("h1", "h2").agg(F.count("*").alias("_n"))
    return counted.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


#: marks of a cell, and columns whose marks fit one 64-bit word
_MARKS, _PER_WORD = ("null", "zero", "negative", "future"), 15


def _row_groups(df: DataFrame, as_of: str | None) -> tuple[DataFrame, dict[tuple[int, str], str]]:
    """Equal rows grouped by digest with the marks of their cells, and how often (column, mark) was set as SQL.

    One scan and one shuffle of a few numbers a row give duplicates and all counters of the column rules: equal
    rows have equal marks, so a mark counts as often as its row. Without ``as_of`` only nulls are marked.
    """
    words: dict[int, list[str]] = {}
    counters = {}
    for i, f in enumerate(df.schema.fields):
        v, kind = _value(f), kind_of(f.dataType)
        marks = {"null": _missing(f)}
        if as_of is not None and kind == "number":
            marks |= {"zero": f"CAST({v} AS DOUBLE) = 0", "negative": f"CAST({v} AS DOUBLE) < 0"}
        elif as_of is not None and kind == "date":
            marks["future"] = f"{v} > CAST({_text(as_of)} AS {f.dataType.simpleString()})"
        word, at = f"w{i // _PER_WORD}", i % _PER_WORD * len(_MARKS)
        for mark, test in marks.items():
            bit = 1 << at + _MARKS.index(mark)
            words.setdefault(i // _PER_WORD, []).append(f"if(coalesce({test}, false), {bit}L, 0L)")
            counters[i, mark] = f"coalesce(sum(if({word} & {bit}L != 0, _n, 0L)), 0L)"
    packed = [f"{' | '.join(parts)} AS w{w}" for w, parts in words.items()]
    rows = df.selectExpr(*digest_sql(_cells(df)), *packed)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")), counters


def quality_facts(df: DataFrame, table: str, as_of: str | None = None) -> DataFrame:
    """Facts for the table rules (one row, ``column`` null) and, given ``as_of``, for the column rules (a row each).

    Everything comes from one grouped pass over the table.
    """
    fields = df.schema.fields
    counted, counters = _row_groups(df, as_of)
    one = counted.selectExpr(
        "coalesce(sum(_n), 0L) AS row_count",
        "coalesce(sum(_n - 1), 0L) AS duplicate_rows",
        *[f"{sql} AS {mark}{i}" for (i, mark), sql in counters.items()],
    )
    nulls = " + ".join(f"null{i}" for i in range(len(fields)))
    by_name = sorted(range(len(fields)), key=lambda i: fields[i].name)
    empty = ", ".join(f"if(null{i} = row_count AND row_count > 0, {_text(fields[i].name)}, NULL)" for i in by_name)
    dup = "coalesce(try_divide(CAST(duplicate_rows AS DOUBLE), CAST(row_count AS DOUBLE)), 0D)"
    rate = f"coalesce(try_divide(CAST({nulls} AS DOUBLE), CAST(row_count * {len(fields)} AS DOUBLE)), 0D)"
    none = {"column": "CAST(NULL AS STRING)", "semantic": "CAST(NULL AS STRING)"} | dict.fromkeys(
        ("null_count", "zero_count", "negative_count", "future_count"), "0L"
    )
    rows = [
        {
            **none, "null_pct": "0D", "duplicate_rows": "duplicate_rows", "duplicate_pct": f"round({dup} * 100, 2)",
            "overall_null_pct": f"round({rate} * 100, 2)", "empty_columns": f"concat_ws(',', {empty})",
        }
    ]
    for i, f in enumerate(fields if as_of is not None else []):
        semantic = profile_type(f.name, kind_of(f.dataType)) or "text"
        count = lambda mark, i=i: f"{mark}{i}" if (i, mark) in counters else "0L"
        pct = f"round(coalesce(try_divide(CAST(null{i} AS DOUBLE), CAST(row_count AS DOUBLE)), 0D) * 100, 2)"
        rows.append(
            {
                "column": _text(f.name), "semantic": _text(semantic), "null_count": count("null"), "zero_count": count("zero"),
                "negative_count": count("negative"), "future_count": count("future"), "null_pct": pct, "duplicate_rows": "0L",
                "duplicate_pct": "0D", "overall_null_pct": "0D", "empty_columns": "''",
            }
        )
    listed = [
        "struct(" + ", ".join(f"{sql} AS `{name}`" for name, sql in row.items()) + f", row_count, {len(fields)}L AS col_count)" for row in rows
    ]
    return one.selectExpr(f"inline(array({', '.join(listed)}))").withColumn("table", F.lit(table))


def all_quality_facts(tables: dict[str, DataFrame], as_of: str) -> DataFrame:
    return _union([quality_facts(df, name, as_of) for name, df in tables.items()])


def table_rows(facts: DataFrame) -> DataFrame:
    """The table profile among the facts."""
    return facts.where(F.col("column").isNull()).select(
        "table", "row_count", "col_count", "duplicate_rows", "duplicate_pct", "overall_null_pct", "empty_columns"
    )


def profile_table(df: DataFrame, table: str) -> DataFrame:
    """Rows, columns, duplicates, overall null rate and empty columns."""
    return table_rows(quality_facts(df, table))


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([profile_table(df, name) for name, df in tables.items()])


def schema_table(df: DataFrame, table: str) -> DataFrame:
    """Column, type, non-null count, null % to one place and distinct count."""
    facts = null_rates(df, table).drop("null_pct")
    names = F.array(*[F.lit(c) for c in df.columns])
    sizes = distinct_counts(value_counts({table: df})).select(
        F.get(names, F.col("ordinal")).alias("column"), "distinct_count"
    )
    return facts.join(F.broadcast(sizes), "column", "left").select(
        "column",
        "dtype",
        (F.col("row_count") - F.col("null_count")).alias("non_null"),
        _null_pct(1),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
    )


def column_statistics(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """The profile row of one column; only that column is read."""
    return profile_columns(df.select(column), "t", as_of).drop("table", "dtype", "semantic")
