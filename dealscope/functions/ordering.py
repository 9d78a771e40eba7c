"""Global order without a one-task window.

A window with no partition key sorts every row in one task. Here the order is cut
into slots at quantiles of the sort value; each slot is its own window partition
and starts from the totals of the slots before it. A value that fills a whole
quantile gets a slot of its own, and that slot is cut again at quantiles of the
key, so neither a tie held by a third of the rows nor a narrow value range ends
up in one task. The slot totals are at most ``(2 * slots + 1) * (slots + 1)``
rows whatever the data size, which is the bound behind their broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOTS = 48
MOST_SLOTS = 400
SKETCH_ACCURACY = 1000


def slot_number(df: DataFrame) -> int:
    """Slots for a table: as many as a shuffle has partitions, between ``SLOTS`` and ``MOST_SLOTS``."""
    return max(SLOTS, min(MOST_SLOTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def cut_value(df: DataFrame, key: str) -> Column:
    """A number that never decreases along the order of ``key``: itself, or a text's first seven bytes."""
    if not isinstance(df.schema[key].dataType, T.StringType):
        return F.col(key)
    digits = F.rpad(F.hex(F.substring(F.encode(F.col(key), "utf-8"), 1, 7)), 14, "0")
    return F.conv(digits, 16, 10).cast("bigint")


def quantile_points(slots: int = SLOTS) -> list[float]:
    return [i / slots for i in range(1, slots)]


def quantile_bounds(col: Column | str, slots: int = SLOTS) -> Column:
    """Distinct approximate quantiles, ascending; exactness is not relied on."""
    return F.sort_array(
        F.array_distinct(F.percentile_approx(col, quantile_points(slots), SKETCH_ACCURACY))
    )


def slot_of(value: Column, bounds: Column, descending: bool = False) -> Column:
    """Slot number that never decreases along the order; odd slots hold one value."""
    if descending:
        before = F.size(F.filter(bounds, lambda b: b > value))
    else:
        before = F.size(F.filter(bounds, lambda b: b < value))
    return before * 2 + F.when(F.array_contains(bounds, value), 1).otherwise(0)


def _bounds(df: DataFrame, values: list[str], key: str, slots: int) -> Column:
    """One-row subquery with the quantile bounds of every sort value and of the key."""
    named = [quantile_bounds(v, slots).alias(f"v{i}") for i, v in enumerate(values)]
    return df.agg(F.struct(*named, quantile_bounds(cut_value(df, key), slots).alias("k"))).scalar()


def _placed(df: DataFrame, orders: list[tuple[str, bool]], key: str, slots: int) -> DataFrame:
    """Add ``_o_slot{i}`` and ``_o_part{i}`` for each (value, descending) order."""
    out = df.withColumn("_o_bounds", _bounds(df, [v for v, _ in orders], key, slots))
    for i, (value, descending) in enumerate(orders):
        slot = slot_of(F.col(value), F.col(f"_o_bounds.v{i}"), descending)
        out = out.withColumn(f"_o_slot{i}", F.coalesce(slot, F.lit(0)))
        inside_tie = F.size(F.filter(F.col("_o_bounds.k"), lambda b: b < cut_value(df, key)))
        part = F.when(F.col(f"_o_slot{i}") % 2 == 1, inside_tie)
        out = out.withColumn(f"_o_part{i}", F.coalesce(part, F.lit(0)))
    return out.drop("_o_bounds")


def with_global_order(
    df: DataFrame,
    value: str,
    key: str,
    descending: bool = True,
    slots: int | None = None,
    position: str = "row_num",
    running: str | None = None,
    rows: str | None = None,
    total: str | None = None,
    sums: tuple[str, ...] = (),
) -> DataFrame:
    """Row number by ``value`` then ``key`` ascending, and the running sum of ``value``.

    Each column of ``sums`` gets its running sum as ``<name>_run`` and its total as ``<name>_all``.

    ``value`` must be numeric and not null; ``key`` unique, a number, date or text. With a
    decimal ``value`` the running sums are exact and independent of task order.
    """
    v, k = F.col(value), F.col(key)
    placed = _placed(df, [(value, descending)], key, slots or slot_number(df))
    place = ["_o_slot0", "_o_part0"]
    before = Window.orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*place).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    starts = (
        placed.groupBy(*place)
        .agg(F.count("*").alias("_o_n"), F.sum(v).alias("_o_s"), *[F.sum(c).alias(f"_o_{c}") for c in sums])
        .select(
            *place,
            F.coalesce(F.sum("_o_n").over(before), F.lit(0)).alias("_o_n0"),
            F.sum("_o_s").over(before).alias("_o_s0"),
            F.sum("_o_n").over(whole).alias("_o_rows"),
            F.sum("_o_s").over(whole).alias("_o_total"),
            *[F.sum(f"_o_{c}").over(before).alias(f"_o0_{c}") for c in sums],
            *[F.sum(f"_o_{c}").over(whole).alias(f"{c}_all") for c in sums],
        )
    )
    inside = Window.partitionBy(*place).orderBy(v.desc() if descending else v.asc(), k)
    out = placed.join(F.broadcast(starts), place)
    out = out.withColumn(position, F.row_number().over(inside) + F.col("_o_n0"))
    if running:
        within = F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(running, within + F.coalesce(F.col("_o_s0"), F.lit(0)))
    for c in sums:
        kind = df.schema[c].dataType
        # one digit below the widest decimal, so that adding two keeps all decimals
        wide = T.DecimalType(37, kind.scale) if isinstance(kind, T.DecimalType) else kind
        within = F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)).cast(wide)
        out = out.withColumn(f"{c}_run", within + F.coalesce(F.col(f"_o0_{c}"), F.lit(0)).cast(wide))
    if rows:
        out = out.withColumn(rows, F.col("_o_rows"))
    if total:
        out = out.withColumn(total, F.col("_o_total"))
    return out.drop(*place, "_o_n0", "_o_s0", "_o_rows", "_o_total", *[f"_o0_{c}" for c in sums])


def with_ntiles(
    df: DataFrame, orders: list[tuple[str, str, bool]], key: str, tiles: int, slots: int | None = None
) -> DataFrame:
    """Add one ntile column per (value, name, descending) order.

    All orders share the bounds subquery and one pass for the slot counts, so the
    input is referenced three times however many orders are asked for.
    """
    placed = _placed(df, [(v, d) for v, _, d in orders], key, slots or slot_number(df))
    places = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                F.col(f"_o_slot{i}").alias("slot"),
                F.col(f"_o_part{i}").alias("part"),
            )
            for i in range(len(orders))
        ]
    )
    per_order = Window.partitionBy("i").orderBy("slot", "part")
    starts = (
        placed.select(F.inline(places))
        .groupBy("i", "slot", "part")
        .agg(F.count("*").alias("n"))
        .select(
            "i",
            "slot",
            "part",
            F.coalesce(
                F.sum("n").over(per_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_o_n0"),
            F.sum("n")
            .over(per_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            .alias("_o_rows"),
        )
    )
    out = placed
    for i, (value, name, descending) in enumerate(orders):
        place = [f"_o_slot{i}", f"_o_part{i}"]
        mine = starts.filter(F.col("i") == i).select(
            F.col("slot").alias(place[0]), F.col("part").alias(place[1]), "_o_n0", "_o_rows"
        )
        v = F.col(value)
        inside = Window.partitionBy(*place).orderBy(v.desc() if descending else v.asc(), key)
        position = F.row_number().over(inside) + F.col("_o_n0")
        out = out.join(F.broadcast(mine), place).withColumn("_o_pos", position)
        out = out.withColumn(name, ntile_of(F.col("_o_pos"), F.col("_o_rows"), tiles))
        out = out.drop(*place, "_o_pos", "_o_n0", "_o_rows")
    return out


def ntile_of(position: Column, rows: Column, tiles: int) -> Column:
    """The SQL ``ntile`` number computed from a global row number and row count."""
    size = F.floor(rows / F.lit(tiles))
    larger = rows % F.lit(tiles)
    in_larger = larger * (size + 1)
    return F.when(
        position <= in_larger, F.ceil(position / (size + 1))
    ).otherwise(larger + F.ceil((position - in_larger) / F.greatest(size, F.lit(1)))).cast("int")


def first_per_group(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """First ``n`` rows per group.

    The ``row_number() <= n`` filter becomes a rank limit on the map side of the
    shuffle, so a group holding a third of all rows sends ``n`` rows per task.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")
