"""The benchmark tree as a long table (fixed size, a few dozen rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dealscope.fixed_values import BENCHMARKS

SCHEMA = "category string, metric string, stat string, value_num double, value_txt string, seq int"


def benchmark_rows(tree: dict = BENCHMARKS) -> list[tuple]:
    rows = []
    for category, metrics in tree.items():
        for metric, stats in metrics.items():
            for stat, value in (stats if isinstance(stats, dict) else {"value": stats}).items():
                number = float(value) if isinstance(value, (int, float)) else None
                rows.append((category, metric, stat, number, str(value), len(rows)))
    return rows


def benchmark_table(spark: SparkSession, tree: dict = BENCHMARKS) -> DataFrame:
    return spark.createDataFrame(benchmark_rows(tree), SCHEMA)
