"""Semantic type inference and casts.

One aggregate over the table gathers the evidence for all text columns, the driver
decides per column from its row of counters, and one projection casts. Only columns
that neither name nor evidence decides get a distinct-value sketch, and a sketch
near a threshold an exact count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscope import fixed_values as fv
from dealscope.functions import names
from dealscope.functions.ordering import first_per_group
from dealscope.operators.profiling import (
    _name,
    _text,
    _value,
    distinct_counts,
    kind_of,
    null_rates,
    value_counts,
)

NUMBER = r"^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$"
SKETCH_ERROR = 0.05
DATE_LIKE = "^[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}"


def _pattern(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\") + "'"


def number_sql(text: str) -> str:
    """Number parse that accepts plain numbers only."""
    return f"if(trim({text}) RLIKE '{NUMBER}', try_cast(trim({text}) AS DOUBLE), NULL)"


def _money_text(column: str) -> str:
    return f"translate(CAST({column} AS STRING), '£$€¥₹, \\t\\n\\r\\f', '')"


def currency_sql(column: str) -> str:
    """Symbols, commas and blanks removed, then a tolerant parse."""
    return number_sql(_money_text(column))


def percentage_sql(column: str) -> str:
    """Trailing percent signs and commas removed; the scale is kept (75% is 75.0)."""
    return number_sql(_percent_text(column))


def _percent_text(column: str) -> str:
    return f"replace(rtrim('%', trim(CAST({column} AS STRING))), ',', '')"


_PARTS = (
    ("'T'", "T"), ("yyyy", "[0-9]{4}"), ("M", "(0?[1-9]|1[0-2])"), ("d", "(0?[1-9]|[12][0-9]|3[01])"),
    ("H", "([01]?[0-9]|2[0-3])"), ("m", "[0-5]?[0-9]"), ("s", "[0-5]?[0-9]"),
)


def date_shape(pattern: str) -> str:
    """Regex of the cells a date pattern can parse."""
    out, rest = "", pattern
    while rest:
        token, regex = next(((t, r) for t, r in _PARTS if rest.startswith(t)), (rest[0], rest[0]))
        out, rest = out + regex, rest[len(token):]
    return f"^{out}$"


def date_sql(column: str, pattern: str) -> str:
    """One date pattern; the shape test keeps cells that cannot parse off the slow path."""
    escaped = pattern.replace("'", "\\'")
    parsed = f"CAST(try_to_timestamp({column}, '{escaped}') AS TIMESTAMP_NTZ)"
    return f"if({column} RLIKE '{date_shape(pattern)}', {parsed}, NULL)"


def evidence(df: DataFrame) -> DataFrame:
    """One row per text column with its match counters.

    The cells of all text columns go through the same few counters, so the generated
    code stays small enough to be compiled however wide the table is; per task one
    row per column reaches the shuffle.
    """
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cells = ", ".join(f"struct({i} AS ordinal, {_name(f.name)} AS cell)" for i, f in enumerate(fields))
    names_sql = ", ".join(_text(f.name) for f in fields)
    symbols = " OR ".join(f"contains(cell, '{c}')" for c in fv.CURRENCY_SYMBOLS.strip("[]"))
    counters = {
        "rows": "count(*)",
        "non_null": "count(cell)",
        "currency_symbol": f"count_if({symbols})",
        "currency_match": f"count_if(bare RLIKE {_pattern(fv.CURRENCY_VALUE)})",
        "currency_cast": f"count({number_sql('money')})",
        "percentage_match": f"count_if(contains(cell, '%') AND bare RLIKE {_pattern(fv.PERCENTAGE_VALUE)})",
        "percentage_cast": f"count({number_sql('percent')})",
        "numeric_cast": f"count(if(digit, {number_sql('bare')}, NULL))",
    }
    for j, pattern in enumerate(fv.DATE_PATTERNS):
        counters[f"date{j}"] = f"count(if(dated, {date_sql('cell', pattern)}, NULL))"
    aggs = [F.expr(e).alias(n) for n, e in counters.items()]
    # first tests, made once per cell, keep most cells off the costlier ones
    tested = df.selectExpr(f"inline(array({cells}))").selectExpr(
        "*", "trim(cell) AS bare", "cell RLIKE '[0-9]' AS digit", f"cell RLIKE '{DATE_LIKE}' AS dated"
    )
    tested = tested.selectExpr(
        "*",
        f"if(digit, {_money_text('cell')}, NULL) AS money",
        f"if(digit, {_percent_text('cell')}, NULL) AS percent",
    )
    counted = tested.groupBy("ordinal").agg(*aggs)
    return counted.selectExpr(f"get(array({names_sql}), ordinal) AS `column`", *counters)


@dataclass(frozen=True)
class Inferred:
    column: str
    raw_type: str
    semantic: str
    cast: str | None = None


def _decide_text(name: str, e, strict: bool) -> tuple[str, str | None] | None:
    """The type of a text column by its counters; None when distinct values decide."""
    c, n = _name(name), max(e["non_null"], 1)
    by_value = e["currency_symbol"] > 0 and e["currency_match"] / n >= fv.MIN_CURRENCY_MATCH
    if (names.is_currency_name(name, strict) or by_value) and e["currency_cast"]:
        return "currency", currency_sql(c)
    by_value = e["non_null"] > 0 and e["percentage_match"] / n >= fv.MIN_PERCENTAGE_MATCH
    if (names.is_percentage_name(name, strict) or by_value) and e["percentage_cast"]:
        return "percentage", percentage_sql(c)
    for j, pattern in enumerate(fv.DATE_PATTERNS):
        if e["non_null"] and e[f"date{j}"] / n >= fv.MIN_DATE_PARSE:
            return "date", date_sql(c, pattern)
    if names.is_email_name(name, strict):
        return "email", None
    if names.is_phone_name(name, strict):
        return "phone", None
    if e["numeric_cast"] / n > fv.MIN_NUMERIC_PARSE:
        return "numeric", number_sql(c)
    return None


def _decide_number(name: str, strict: bool) -> str | None:
    """The type of a number column by name; None when distinct values decide."""
    if names.is_currency_name(name, strict):
        return "currency"
    if names.is_percentage_name(name, strict):
        return "percentage"
    return None if names.is_id_name(name) else "numeric"


def _decide_distinct(name: str, number: bool, rows: int, non_null: int, distinct: int) -> str:
    """Identifier by name and distinct values, else by category count."""
    if names.is_id_name(name) and distinct > fv.MIN_ID_DISTINCT * max(non_null, 1):
        return "identifier"
    if number:
        return "numeric"
    limit = max(fv.MAX_CATEGORIES, fv.MAX_CATEGORY_RATIO * max(rows, 1))
    return "text" if distinct > limit else "categorical"


def infer_types(df: DataFrame, strict_names: bool = False, exact: bool = True) -> dict[str, Inferred]:
    """The decision per column.

    One job counts the evidence of the text columns, a second one the distinct values
    of all columns that neither name nor evidence decides. ``exact=False`` takes a
    sketch instead, off by about ``SKETCH_ERROR``, and shuffles no values. The driver
    sees one row of counters per column.
    """
    fields = df.schema.fields
    counters = {}
    if any(isinstance(f.dataType, T.StringType) for f in fields):
        counters = {row["column"]: row for row in evidence(df).collect()}
    decided: dict[str, tuple[str, str | None] | None] = {}
    for f in fields:
        kind = kind_of(f.dataType)
        if kind == "date":
            decided[f.name] = ("date", None)
        elif kind == "boolean":
            decided[f.name] = ("categorical", None)
        elif kind == "number":
            semantic = _decide_number(f.name, strict_names)
            decided[f.name] = (semantic, None) if semantic else None
        else:
            # an empty table has no evidence rows
            e = counters.get(f.name)
            decided[f.name] = _decide_text(f.name, e, strict_names) if e else ("categorical", None)
    open_columns = [f for f in fields if decided[f.name] is None]
    if open_columns:
        aggs = ["count(*) AS rows"]
        for i, f in enumerate(open_columns):
            v = _value(f)
            aggs.append(f"count({v}) AS n{i}")
            if not exact:
                aggs.append(f"approx_count_distinct({v}, {SKETCH_ERROR}D) AS d{i}")
        row = df.selectExpr(*aggs).first()
        if exact:
            counts = value_counts({"open": df.select(*[_name(f.name) for f in open_columns])})
            distinct = {r["ordinal"]: r["distinct_count"] for r in distinct_counts(counts).collect()}
        else:
            distinct = {i: row[f"d{i}"] for i in range(len(open_columns))}
        for i, f in enumerate(open_columns):
            number = kind_of(f.dataType) == "number"
            decided[f.name] = (
                _decide_distinct(f.name, number, row["rows"], row[f"n{i}"], distinct.get(i, 0)), None,
            )
    return {
        f.name: Inferred(f.name, f.dataType.simpleString(), *decided[f.name]) for f in fields
    }


def apply_types(df: DataFrame, types: dict[str, Inferred]) -> DataFrame:
    """One projection that casts every column and notes the type in its metadata."""
    columns = []
    for name in df.columns:
        t = types[name]
        c = F.expr(t.cast or _name(name))
        columns.append(c.alias(name, metadata={"semantic": t.semantic}))
    return df.select(*columns)


def infer_and_cast(df: DataFrame, strict_names: bool = False) -> tuple[DataFrame, dict[str, Inferred]]:
    """B1: infer every column, cast in one projection."""
    types = infer_types(df, strict_names)
    return apply_types(df, types), types


def column_schema(df: DataFrame, types: dict[str, Inferred], table: str = "") -> DataFrame:
    """Raw and inferred type, nulls and distinct values per column of the cast table."""
    facts = null_rates(df, table)
    label = F.array(*[F.lit(c) for c in df.columns])
    sizes = distinct_counts(value_counts({table: df}), "unique_count").select(
        F.get(label, F.col("ordinal")).alias("column"), "unique_count"
    )
    raw = F.create_map(*[x for t in types.values() for x in (F.lit(t.column), F.lit(t.raw_type))])
    kind = F.create_map(*[x for t in types.values() for x in (F.lit(t.column), F.lit(t.semantic))])
    return facts.join(F.broadcast(sizes), "column", "left").select(
        "column",
        raw[F.col("column")].alias("raw_dtype"),
        kind[F.col("column")].alias("inferred_type"),
        "null_count",
        "null_pct",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


SAMPLES = 3


def first_values(df: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first ``n`` non-null values of every column of a file table, in file order; dates and times in ISO form.

    A task holds ``n`` values per column, and as many leave it for each file block; order is file, place in the file.
    """
    columns = df.columns
    shown = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[list[str]]] = {}
        for batch in batches:
            files, starts = batch.column("_file"), batch.column("_at").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(starts) != 0) + 1).tolist(), batch.num_rows]
            if batch.num_rows and pc.count_distinct(files).as_py() > 1:  # blocks of several files may begin alike
                turns = pc.indices_nonzero(pc.not_equal(files[1:], files[:-1])).to_numpy() + 1
                cuts = sorted({*cuts, *turns.tolist()})
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = held.setdefault((files[a].as_py(), int(starts[a])), [[] for _ in columns])
                for i, values in enumerate(own):
                    if len(values) < n:
                        found = batch.column(i).slice(a, b - a).drop_null()[: n - len(values)]
                        values += [iso_text(v) for v in found.to_pylist()]
        rows = [(i, file, at, k, v) for (file, at), own in held.items() for i, values in enumerate(own) for k, v in enumerate(values)]
        types = pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string()
        made = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(made, names=["ordinal", "file", "at", "k", "value"])

    found = df.select("*", *shown).mapInArrow(run, "ordinal int, file string, at bigint, k int, value string")
    place = F.struct("file", "at", "k").alias("place")
    first = first_per_group(found.select("ordinal", "value", place), ["ordinal"], [F.col("place")], n)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"])
    label = F.array(*[F.lit(c) for c in columns])
    return first.groupBy("ordinal").agg(listed.alias("samples")).select(F.get(label, F.col("ordinal")).alias("column"), "samples")


def iso_text(value) -> str:
    """A sample as text."""
    if isinstance(value, bool):
        return str(value).lower()
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def detect_schema(df: DataFrame, table: str = "") -> DataFrame:
    """The schema rows of an existing table, without applying the casts."""
    cast, types = infer_and_cast(df)
    return column_schema(cast, types, table)


def columns_of_type(schema: DataFrame, semantic: str) -> DataFrame:
    return schema.filter(F.col("inferred_type") == semantic)
