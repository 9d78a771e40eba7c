"""Exact order statistics of weighted values by repeated selection.

The values of each group lie in a stored table with their counts. A group's wanted ranks start with the whole
range; as long as a range holds more than ``SLOT_ROWS`` distinct values, one pass cuts it at quantiles, counts
what falls between, and keeps the slot the rank is in; ranks in one range share the pass. What is sorted in the end, a task per rank, has a stated
size however many values a group has, and the ranges (two a group) are all the driver sees.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope.functions.ordering import quantile_bounds

#: distinct values that one task sorts at most, and cuts of a range in one pass
SLOT_ROWS, CUTS = 100_000, 64
_RANGES = "ordinal int, rank bigint, low double, high double, before bigint"


class Range(NamedTuple):
    """The value of ``rank`` lies in [low, high]; ``before`` rows lie below, ``rows`` distinct values inside."""

    ordinal: int
    rank: int
    low: float
    high: float
    before: int
    rows: int


def _inside(values: DataFrame, ranges: list[Range]) -> DataFrame:
    """The values of every range, with its rank: a broadcast of two short rows a group."""
    wanted = values.sparkSession.createDataFrame([r[:5] for r in ranges], _RANGES)
    joined = values.join(F.broadcast(wanted), "ordinal")
    return joined.where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))


def _slot(value: Column, bounds: Column) -> Column:
    """``slot_of`` for less than ``CUTS`` bounds in two steps of comparisons that are compiled, not a lambda a bound."""
    below = lambda i: F.when(F.get(bounds, i) < value, 1).otherwise(0)
    step = int(CUTS**0.5)
    coarse = sum((below(F.lit(i)) for i in range(step - 1, CUTS, step)), F.lit(0)) * step
    before = coarse + sum((below(coarse + i) for i in range(step - 1)), F.lit(0))
    return before * 2 + F.when(F.get(bounds, before) == value, 1).otherwise(0)


def _narrowed(values: DataFrame, ranges: list[Range]) -> list[Range]:
    spark = values.sparkSession
    # ranks that lie in one range, as the two of a median do, are looked for in one pass over it
    parts = {key: i for i, key in enumerate(dict.fromkeys((r.ordinal, r.low, r.high, r.before) for r in ranges))}
    wanted = spark.createDataFrame([(i, *key) for key, i in parts.items()], "part int, ordinal int, low double, high double, before bigint")
    ranks = spark.createDataFrame([(parts[r.ordinal, r.low, r.high, r.before], r.rank) for r in ranges], "part int, rank bigint")
    inside = values.join(F.broadcast(wanted), "ordinal").where((F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")))
    bounds = inside.groupBy("part").agg(quantile_bounds("value", CUTS).alias("bounds"))
    slots = inside.join(F.broadcast(bounds), "part").withColumn("slot", _slot(F.col("value"), F.col("bounds")))
    sized = slots.groupBy("part", "ordinal", "slot").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.first("before").alias("before"),
    )
    order = Window.partitionBy("part").orderBy("slot")
    ended = sized.withColumn("end", F.col("before") + F.sum("n").over(order)).join(F.broadcast(ranks), "part")
    own = ended.where((F.col("end") >= F.col("rank")) & (F.col("end") - F.col("n") < F.col("rank")))
    return [Range(r["ordinal"], r["rank"], r["low"], r["high"], r["end"] - r["n"], r["rows"]) for r in own.collect()]


def at_ranks(values: DataFrame, ranges: list[Range], slot_rows: int = SLOT_ROWS) -> dict[tuple[int, int], float]:
    """(ordinal, rank) -> value. ``values``: ordinal, value, n; not null, one row per distinct value, stored."""
    ready = [r for r in ranges if r.rows <= slot_rows]
    large = [r for r in ranges if r.rows > slot_rows]
    while large:
        large = _narrowed(values, large)
        ready += [r for r in large if r.rows <= slot_rows]
        large = [r for r in large if r.rows > slot_rows]
    if not ready:
        return {}
    order = Window.partitionBy("ordinal", "rank").orderBy("value")
    ended = _inside(values, ready).withColumn("end", F.col("before") + F.sum("n").over(order))
    own = ended.where((F.col("end") >= F.col("rank")) & (F.col("end") - F.col("n") < F.col("rank")))
    return {(r["ordinal"], r["rank"]): r["value"] for r in own.select("ordinal", "rank", "value").collect()}


class Summary(NamedTuple):
    distinct: int
    median: float


def medians(values: DataFrame, slot_rows: int = SLOT_ROWS) -> dict[int, Summary]:
    """Per ordinal the number of distinct values and the exact median; ``values`` as for ``at_ranks``."""
    totals = values.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    ).collect()  # one row per column
    middle = {r["ordinal"]: ((r["n"] + 1) // 2, r["n"] // 2 + 1) for r in totals}
    ranges = [Range(r["ordinal"], k, r["low"], r["high"], 0, r["rows"]) for r in totals for k in sorted({*middle[r["ordinal"]]})]
    found = at_ranks(values, ranges, slot_rows)
    out = {}
    for r in totals:
        a, b = (found[r["ordinal"], k] for k in middle[r["ordinal"]])
        out[r["ordinal"]] = Summary(r["rows"], a if a == b else (a + b) / 2)
    return out
