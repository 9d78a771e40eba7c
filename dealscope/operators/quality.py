"""Quality rules over column and table profiles.

Profiles hold one row per column or table, so everything here is small and the
un-partitioned windows are bounded by the number of columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions.numbers import count_if, ratio


def _share(count: Column) -> Column:
    return F.round(F.coalesce(ratio(count, F.col("row_count")), F.lit(0.0)) * 100, 2)


def _shown(pct: Column) -> Column:
    return pct.cast("decimal(7,2)").cast("string")


def _issue(severity, rule: str, text: Column, rows: Column, pct: Column, column: Column) -> Column:
    return F.struct(
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.col("table").alias("table"),
        column.cast("string").alias("column"),
        F.lit(rule).alias("rule"),
        text.alias("description"),
        rows.cast("bigint").alias("affected_rows"),
        pct.cast("double").alias("affected_pct"),
    )


def _column_rules() -> Column:
    """Empty and null-heavy columns, zero and negative money, future dates."""
    name, nulls = F.col("column"), F.col("null_pct")
    money = F.col("semantic") == "currency"

    def counted(rule: str, count: str, what: str, applies: Column) -> Column:
        share = _share(F.col(count))
        text = F.concat(
            F.lit("Column '"), name, F.lit("' has "), F.col(count).cast("string"),
            F.lit(f" {what} ("), _shown(share), F.lit("%)"),
        )
        return F.when(
            applies & (F.col(count) > 0), _issue("warning", rule, text, F.col(count), share, name)
        )

    empty = F.concat(F.lit("Column '"), name, F.lit("' is completely empty (100% null)"))
    heavy = F.concat(
        F.lit("Column '"), name, F.lit("' is "), _shown(nulls), F.lit("% null (threshold: 30%)")
    )
    return F.array(
        F.when(
            nulls == fv.NULL_ERROR_PCT,
            _issue("error", "FULLY_EMPTY", empty, F.col("row_count"), nulls, name),
        ).when(
            nulls > fv.NULL_WARN_PCT,
            _issue("warning", "HIGH_NULLS", heavy, F.col("null_count"), nulls, name),
        ),
        counted("ZERO_REVENUE", "zero_count", "zero values", money),
        counted("NEGATIVE_REVENUE", "negative_count", "negative values", money),
        counted("FUTURE_DATES", "future_count", "dates beyond today", F.lit(True)),
    )


def _table_rules() -> Column:
    """Duplicate rows and a high overall null rate."""
    dup, nulls = F.col("duplicate_pct"), F.col("overall_null_pct")
    severity = F.when(dup >= fv.DUPLICATE_ERROR_PCT, "error").otherwise("warning")
    dup_text = F.concat(
        F.col("duplicate_rows").cast("string"), F.lit(" duplicate rows found ("), _shown(dup), F.lit("%)")
    )
    null_text = F.concat(F.lit("Table-wide null rate is "), _shown(nulls), F.lit("%"))
    return F.array(
        F.when(
            F.col("duplicate_rows") > 0,
            _issue(severity, "DUPLICATE_ROWS", dup_text, F.col("duplicate_rows"), dup, F.lit(None)),
        ),
        F.when(
            nulls > fv.OVERALL_NULL_WARN_PCT,
            _issue("warning", "HIGH_OVERALL_NULL", null_text, F.lit(0), nulls, F.lit(None)),
        ),
    )


def column_issues(facts: DataFrame) -> DataFrame:
    """The issues of columns, from column facts."""
    return facts.where(F.col("column").isNotNull()).select(F.inline(F.array_compact(_column_rules())))


def table_issues(tables: DataFrame) -> DataFrame:
    """The issues of tables, from table profiles."""
    return tables.select(F.inline(F.array_compact(_table_rules())))


def severity_rank(col: Column | str = "severity") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), c).cast("bigint")


def all_issues(facts: DataFrame) -> DataFrame:
    """Table and column issues together, errors first; the facts are gone through once."""
    found = F.when(F.col("column").isNull(), _table_rules()).otherwise(_column_rules())
    return facts.select(F.inline(F.array_compact(found))).withColumn("severity_rank", severity_rank()).orderBy(
        "severity_rank", F.col("affected_pct").desc(), "table", "column", "rule"
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("issues"))


def report_totals(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """Totals over all tables."""
    per = issues.agg(
        F.count("*").alias("total_issues"),
        *[count_if(F.col("severity") == s).alias(s + "s") for s in fv.SEVERITIES],
    )
    totals = tables.agg(F.count("*").alias("total_tables"), F.sum("row_count").alias("total_rows"))
    counts = per.select(F.struct(*per.columns)).scalar()
    return totals.withColumn("_c", counts).select("total_tables", "total_rows", "_c.*")


def nested_report(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """One JSON document per table with its issues (at most rules x columns each)."""
    listed = issues.groupBy("table").agg(
        F.sort_array(
            F.collect_list(
                F.struct("severity", "column", "rule", "affected_rows", "affected_pct")
            )
        ).alias("issues")
    )
    return tables.join(F.broadcast(listed), "table", "left").select(
        "table", F.to_json(F.struct(*[c for c in tables.columns if c != "table"], "issues")).alias("report")
    )


def summary(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per table with its issue counts and traffic light."""
    per = issues.groupBy("table").agg(
        F.count("*").alias("issues"), count_if(F.col("severity") == "error").alias("errors")
    )
    nulls = F.col("overall_null_pct")
    light = (
        F.when((F.col("errors") > 0) | (nulls >= fv.RED_NULL_PCT), "red")
        .when(nulls >= fv.AMBER_NULL_PCT, "amber")
        .otherwise("green")
    )
    return (
        tables.join(F.broadcast(per), "table", "left")
        .fillna({"issues": 0, "errors": 0})
        .select("table", "row_count", "col_count", nulls, "duplicate_rows", "issues", light.alias("light"))
    )


def catalog(summary_rows: DataFrame, joined: list[str]) -> DataFrame:
    """Table, rows, whether it takes part in a confirmed join, traffic light."""
    return summary_rows.select(
        "table", "row_count", F.col("table").isin(*joined).alias("joined"), "light"
    )


def flagged_columns(issues: DataFrame) -> DataFrame:
    """Columns with issues, per table."""
    return (
        issues.filter(F.col("column").isNotNull())
        .groupBy("table")
        .agg(F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns"))
    )


def quality_score(tables: DataFrame) -> DataFrame:
    """Q13: completeness score per table: 100 minus null rate minus duplicate rate."""
    return tables.select(
        "table",
        "overall_null_pct",
        "duplicate_pct",
        F.round(F.greatest(F.lit(0.0), 100 - F.col("overall_null_pct") - F.col("duplicate_pct")), 2).alias("score"),
    )


def action_list(issues: DataFrame) -> DataFrame:
    """Q22: issues numbered by severity, then share of affected rows."""
    w = Window.orderBy(
        "severity_rank", F.col("affected_pct").desc(), "table", F.col("column").asc_nulls_first(), "rule"
    )
    return issues.select(
        F.row_number().over(w).cast("bigint").alias("priority"),
        "severity", "table", "column", "rule", "affected_rows", "affected_pct",
    )


def fix_list(actions: DataFrame) -> DataFrame:
    """Q23: agreed fixes with an open owner field."""
    return actions.select(
        "priority",
        F.concat_ws(" ", F.lower(F.regexp_replace("rule", "_", " ")), F.lit("in"), "table").alias("fix"),
        "table",
        "column",
        F.lit(None).cast("string").alias("owner"),
    )


def _line(seq: int, text: Column) -> Column:
    return F.struct(F.lit(seq).alias("seq"), text.alias("line"))


def report_lines(tables: DataFrame, issues: DataFrame) -> DataFrame:
    """The quality report as text lines with a sort key (table, seq)."""
    head = F.array(
        _line(1, F.concat(F.lit("TABLE: "), F.col("table"))),
        _line(2, F.concat(F.lit("  Rows          : "), F.col("row_count").cast("string"))),
        _line(3, F.concat(F.lit("  Columns       : "), F.col("col_count").cast("string"))),
        _line(
            4,
            F.concat(
                F.lit("  Duplicate rows: "), F.col("duplicate_rows").cast("string"),
                F.lit(" ("), _shown(F.col("duplicate_pct")), F.lit("%)"),
            ),
        ),
        _line(
            5, F.concat(F.lit("  Overall nulls : "), _shown(F.col("overall_null_pct")), F.lit("%"))
        ),
        _line(
            6,
            F.concat(
                F.lit("  Fully empty   : "),
                F.when(F.col("empty_columns") == "", "none").otherwise(F.col("empty_columns")),
            ),
        ),
    )
    w = Window.partitionBy("table").orderBy("severity_rank", F.col("column").asc_nulls_first(), "rule")
    body = issues.select(
        "table",
        (F.row_number().over(w) + 6).alias("seq"),
        F.concat(
            F.lit("    ["), F.upper("severity"), F.lit("] "), F.coalesce("column", F.lit("table")),
            F.lit(" "), F.col("rule"), F.lit(" — "), F.col("description"),
        ).alias("line"),
    )
    return tables.select("table", F.inline(head)).unionByName(body)
