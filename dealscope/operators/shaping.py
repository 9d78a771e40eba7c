"""Result shaping: search, preview, pivot, what-if, confidence."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions.numbers import ratio
from dealscope.operators.profiling import _name, null_rates


def search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows where any column's text matches the pattern in any case.

    A pattern that is no valid regular expression leaves the rows unfiltered.
    """
    spark = df.sparkSession
    try:
        spark.range(1).select(F.lit("").rlike("(?i)" + pattern)).collect()
    except Exception:  # the regex engine of the JVM decides what is valid
        return df
    hits = [F.coalesce(F.col(_name(c)).cast("string").rlike("(?i)" + pattern), F.lit(False)) for c in df.columns]
    return df.filter(reduce(Column.__or__, hits))


def preview_counts(df: DataFrame, filtered: DataFrame, max_rows: int) -> DataFrame:
    """Rows shown, left after filtering, and in total."""
    return filtered.agg(F.count("*").alias("filtered")).select(
        F.least(F.col("filtered"), F.lit(max_rows)).cast("bigint").alias("shown"),
        "filtered",
        df.agg(F.count("*")).scalar().alias("total"),
    )


def preview(df: DataFrame, order: list[str], max_rows: int = 100) -> DataFrame:
    """The first rows in a total order, as a top-k."""
    return df.orderBy(*order).limit(max_rows)


def pivot(
    df: DataFrame, row: str, column: str, values: list[str] | None, measures: dict[str, Column]
) -> DataFrame:
    """M2: cross-tab; two header levels are joined with " | ".

    ``values`` come first in the order given; values of the data that are not among
    them follow, so no row is left out (nulls are headed "null").
    """
    seen = [r[0] for r in df.select(column).distinct().collect()]  # one name per column of the result
    shown = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    df = df.withColumn(column, shown)
    named = sorted({"null" if v is None else str(v) for v in seen} - set(values or []))
    values = [*(values or []), *named]
    wide = df.groupBy(row).pivot(column, values).agg(*[m.alias(n) for n, m in measures.items()])
    if len(measures) == 1:
        return wide
    names = {f"{v}_{m}": f"{v} | {m}" for v in values for m in measures}
    return wide.withColumnsRenamed(names)


def what_if(baseline: DataFrame, scenario: DataFrame) -> DataFrame:
    """Baseline against scenario per metric; change and signed percent.

    Both inputs are (metric, value) with one row per metric.
    """
    both = baseline.withColumnRenamed("value", "baseline").join(
        scenario.withColumnRenamed("value", "scenario"), "metric", "full_outer"
    )
    change = F.col("scenario") - F.col("baseline")
    share = F.round(ratio(change, F.col("baseline")) * 100, 1)
    shown = F.concat(
        F.when(share >= 0, "+").otherwise(""), share.cast("decimal(18,1)").cast("string"), F.lit("%")
    )
    return both.select(
        "metric", "baseline", "scenario", F.round(change, 2).alias("change"),
        F.when(F.col("baseline") != 0, F.coalesce(shown, F.lit(""))).otherwise("").alias("pct_change"),
    )


def metrics(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """The named aggregates of a table as (metric, value) rows, in one pass."""
    one = df.agg(*[m.cast("double").alias(n) for n, m in named.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in named])
    return one.select(F.inline(rows))


def scenario(df: DataFrame, factors: dict[str, str], named: dict[str, Column]) -> DataFrame:
    """M4: the same aggregates recomputed with scaled inputs, compared with the baseline.

    Factors are decimal texts such as "1.1"; the scaling is exact.
    """
    scaled = df.withColumns(
        {c: F.col(c).cast("decimal(18,4)") * F.lit(Decimal(f)) for c, f in factors.items()}
    )
    return what_if(metrics(df, named), metrics(scaled, named))


def null_ratio(df: DataFrame) -> DataFrame:
    """Mean null rate over the columns and the row count."""
    rates = null_rates(df, "result")
    return rates.agg(
        F.max("row_count").alias("n_rows"),
        F.coalesce(ratio(F.sum("null_count"), F.sum("row_count")), F.lit(0.0)).alias("null_ratio"),
    )


def confidence(n_rows: Column, nulls: Column, retries: Column, assumptions: Column, cannot_answer: Column) -> Column:
    """M7: 0-100 score from retries, emptiness, nulls, a single row and assumptions."""
    start = F.lit(100) - retries * fv.RETRY_PENALTY
    filled = start - F.floor(nulls * fv.NULL_PENALTY) - F.when(n_rows == 1, fv.SINGLE_ROW_PENALTY).otherwise(0)
    s = F.when(n_rows == 0, F.least(start, F.lit(fv.EMPTY_RESULT_CAP))).otherwise(filled)
    s = s - F.when(assumptions, fv.ASSUMPTION_PENALTY).otherwise(0)
    return F.when(cannot_answer, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), s))).cast("int")


def confidence_label(score: Column) -> Column:
    """M8: the label of a confidence score."""
    return (
        F.when(score >= 85, "High confidence")
        .when(score >= 60, "Review recommended")
        .otherwise("Low confidence — verify manually")
    )


