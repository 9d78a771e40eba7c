"""Dashboard analytics: concentration, funnel, win rate, cycle trend, top-k, KPIs.

Group results whose size is fixed by a category (stages, months, service lines)
use plain windows; results with one row per account use ``with_global_order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions.dates import age_days, month_of, whole_days
from dealscope.functions.numbers import (
    count_if,
    joined_parts,
    money,
    money_sum,
    money_sum_double,
    number_parts,
    ratio,
    to_number,
)
from dealscope.functions.ordering import with_global_order
from dealscope.operators.profiling import kind_of


def won(stage: str = "stage") -> Column:
    """Winning-stage predicate."""
    return F.lower(stage).isin(*fv.WON_STAGES)


def group_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sum, count and mean per key; null keys are dropped, an infinite value makes its sum infinite."""
    exact, rest = number_parts(value)
    total = joined_parts(F.col("_s"), F.col("_r"))
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.sum(exact).alias("_s"),
            F.sum(rest).alias("_r"),
            F.count(F.when(~F.isnan(value), F.col(value))).alias("_n"),
            F.count("*").alias("row_count"),
        )
        .select(
            key,
            F.coalesce(total, F.lit(0.0)).alias("total"),
            "row_count",
            F.round(ratio(total, F.col("_n")), 4).alias("mean"),
        )
    )


def _summed_parts(df: DataFrame, key: str, value: str, measure: Column | None = None) -> DataFrame:
    """key, ``_value`` (double) and the two parts it was summed in; keys without a value are left out."""
    if measure is not None:
        sums = [F.sum(measure).alias("_exact"), F.lit(None).cast("double").alias("_rest")]
    else:
        exact, rest = number_parts(value)
        sums = [F.sum(exact).alias("_exact"), F.sum(rest).alias("_rest")]
    grouped = df.groupBy(key).agg(*sums)
    grouped = grouped.withColumn("_value", joined_parts(F.col("_exact"), F.col("_rest"))).filter(F.col("_value").isNotNull())
    return grouped.withColumn("_exact", F.coalesce("_exact", F.lit(0))).withColumn("_rest", F.coalesce("_rest", F.lit(0.0)))


def pareto(df: DataFrame, key: str, value: str, measure: Column | None = None) -> DataFrame:
    """Totals per key in descending order with the running share of all rows.

    Where a value is infinite it comes first; the infinite ones together are all of the total.
    """
    grouped = _summed_parts(df.filter(F.col(key).isNotNull()), key, value, measure)
    ordered = with_global_order(grouped, "_value", key, sums=("_exact", "_rest"))
    running, total = (joined_parts(F.col(f"_exact_{s}"), F.col(f"_rest_{s}")) for s in ("run", "all"))
    endless = F.abs(total) == float("inf")
    before = joined_parts(F.col("_exact_run") - F.col("_exact").cast("decimal(28,9)"), F.col("_rest_run") - F.col("_rest"))
    infinite = F.abs("_value") == float("inf")
    return ordered.select(
        key,
        F.col("_value").alias(value),
        F.col("row_num").cast("bigint").alias("rank"),
        F.when(total == 0, 0.0).when(endless, 100.0).otherwise(F.round(ratio(running, total) * 100, 6)).alias("cum_pct"),
        F.when(total == 0, 0.0)
        .when(endless, F.when(infinite, 0.0).otherwise(100.0))
        .otherwise(ratio(before, total) * 100)
        .alias("_before_pct"),
    )


def leading_accounts(df: DataFrame, key: str, value: str, share: float = 80.0, measure=None) -> DataFrame:
    """Q1/Q2: the keys that together make up ``share`` percent of the total."""
    return (
        pareto(df, key, value, measure).filter(F.col("_before_pct") < share).drop("_before_pct")
    )


def top_groups(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest groups (a top-k over partial sums, no full sort)."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(money_sum(value).alias("_value"))
        .filter(F.col("_value").isNotNull())
        .orderBy(F.col("_value").desc(), F.col(key))
        .limit(n)
    )


def concentration(df: DataFrame, key: str, value: str, n: int = 20) -> DataFrame:
    """K1: top ``n`` groups with the running share of the top-``n`` total (at most n rows)."""
    order = Window.orderBy(F.col("_value").desc(), F.col(key))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = top_groups(df, key, value, n)
    total = F.sum("_value").over(whole)
    return top.select(
        key,
        F.col("_value").cast("double").alias(value),
        F.when(total > 0, F.round(ratio(F.sum("_value").over(running), total) * 100, 6))
        .otherwise(F.lit(0.0))
        .alias("cum_pct"),
    )


def account_totals(facts: DataFrame, accounts: DataFrame, value: str) -> DataFrame:
    """Facts summed per account id before the join, so the join sees one row per account."""
    per_id = facts.groupBy("account_id").agg(money_sum(value).alias(value))
    return per_id.join(accounts.select("account_id", "account_name"), "account_id")


def moving_average(df: DataFrame, order: str, value: str, rows: int = 3) -> DataFrame:
    """Mean of the current and the ``rows - 1`` previous rows of a short series."""
    w = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(
        "moving_avg", F.round(ratio(F.sum(value).over(w), F.count(value).over(w)), 4)
    )


def monthly_totals(df: DataFrame, day: str, value: str) -> DataFrame:
    return (
        df.select(F.col(day), F.col(value))
        .dropna()
        .groupBy(month_of(F.col(day)).alias("month"))
        .agg(money_sum(value).alias(value))
    )


def percent_of_first(df: DataFrame, key: str, value: str) -> DataFrame:
    """Funnel percentages relative to the largest stage."""
    largest = df.agg(F.max(value)).scalar()
    return df.withColumn("pct_of_first", F.round(ratio(F.col(value), largest) * 100, 6))


def share_of_total(df: DataFrame, value: str) -> DataFrame:
    """Percentage of the overall total."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn("share_pct", F.round(ratio(F.col(value), total) * 100, 6))


def funnel(df: DataFrame, stage: str, value: str | None = None) -> DataFrame:
    """K2: size per stage, by summed value if there is a value column, else by count."""
    measure = money_sum(value) if value else F.count("*")
    sized = df.filter(F.col(stage).isNotNull()).groupBy(stage).agg(measure.alias("size"))
    out = percent_of_first(sized, stage, "size")
    return out.withColumn("size", F.col("size").cast("double" if value else "bigint"))


def win_rate(df: DataFrame, group: str, stage: str = "stage") -> DataFrame:
    """K3: won rows as percent of all rows per group (open rows count as not won)."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(count_if(won(stage)).alias("won"), F.count("*").alias("deals"))
        .withColumn("win_rate_pct", F.round(ratio(F.col("won"), F.col("deals")) * 100, 4))
    )


def win_rate_vs_benchmark(df: DataFrame, group: str) -> DataFrame:
    rate = F.col("win_rate_pct")
    bench = F.lit(fv.WIN_RATE_BENCHMARK).cast("double")
    return win_rate(df, group).select(
        group,
        rate,
        bench.alias("benchmark_pct"),
        F.round(rate - bench, 4).alias("gap"),
    )


def cycle_days(df: DataFrame) -> DataFrame:
    """Deals with both dates and their whole days from creation to close."""
    both = df.filter(F.col("created").isNotNull() & F.col("close_date").isNotNull())
    return both.withColumn("days", whole_days(F.col("created"), F.col("close_date")))


def cycle_trend(df: DataFrame) -> DataFrame:
    """K4: mean cycle days per close month with a three-row moving average."""
    monthly = (
        cycle_days(df)
        .groupBy(month_of(F.col("close_date")).alias("month"))
        .agg(F.round(ratio(F.sum("days"), F.count("days")), 4).alias("avg_days"))
        .withColumn("_avg", F.col("avg_days").cast("decimal(18,4)"))
    )
    return (
        moving_average(monthly, "month", "_avg")
        .drop("_avg")
        .withColumn("benchmark_days", F.lit(fv.SALES_CYCLE_BENCHMARK).cast("bigint"))
    )


def cycle_by_group(df: DataFrame, group: str) -> DataFrame:
    return (
        cycle_days(df)
        .filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.round(ratio(F.sum("days"), F.count("days")), 4).alias("avg_days"),
            F.count("*").alias("deals"),
        )
    )


def numeric_matrix(df: DataFrame, label: str, key: str, n: int = 30) -> DataFrame:
    """Numeric columns of the first ``n`` rows by key, nulls as 0."""
    numeric = [f.name for f in df.schema.fields if kind_of(f.dataType) == "number"]
    return df.select(label, *numeric).orderBy(key).limit(n).fillna(0)


def kpi_sum(df: DataFrame, column: str) -> Column:
    """Sum of a column coerced to numbers."""
    return money_sum_double(to_number(F.col(column)))


def kpis(accounts: DataFrame, deals: DataFrame) -> DataFrame:
    """Account count, open value, mean deal size and revenue in one row."""
    by_deal = deals.agg(
        money_sum_double(F.when(~won(), F.col("deal_value"))).alias("open_value"),
        money_sum("deal_value").alias("_s"),
        F.count(money("deal_value")).alias("_n"),
    ).select("open_value", F.round(ratio(F.col("_s"), F.col("_n")), 4).alias("avg_deal_size"))
    by_account = accounts.agg(
        F.count_distinct("account_id").alias("accounts"), kpi_sum(accounts, "revenue").alias("revenue")
    )
    return by_account.select(
        "accounts",
        "revenue",
        by_deal.select("open_value").scalar().alias("open_value"),
        by_deal.select("avg_deal_size").scalar().alias("avg_deal_size"),
    )


def distinct_or_rows(df: DataFrame, column: str | None) -> DataFrame:
    """Distinct count of a column, or the row count when there is no such column."""
    if column and column in df.columns:
        return df.agg(F.count_distinct(column).alias("n"))
    return df.agg(F.count("*").alias("n"))


def concentration_bands(df: DataFrame, key: str, value: str) -> DataFrame:
    """K8: revenue share of the top 10 %, top 20 % and bottom 50 % of accounts."""
    grouped = df.groupBy(key).agg(money_sum(value).alias("_value"))
    grouped = grouped.filter(F.col("_value").isNotNull())
    ordered = with_global_order(grouped, "_value", key, rows="_rows", total="_total")
    pos, rows, v = F.col("row_num"), F.col("_rows"), F.col("_value")
    sums = ordered.agg(
        F.sum(F.when(pos * 10 <= rows, v)).alias("top10"),
        F.sum(F.when(pos * 5 <= rows, v)).alias("top20"),
        F.sum(F.when(pos * 2 > rows, v)).alias("bottom50"),
        F.max("_total").alias("total"),
    )

    def band(name: str, typical: int) -> Column:
        share = F.round(ratio(F.col(name), F.col("total")) * 100, 4)
        return F.struct(
            F.lit(name).alias("band"),
            share.alias("share_pct"),
            F.lit(typical).cast("bigint").alias("typical_pct"),
            F.round(share - typical, 4).alias("gap"),
        )

    typical = fv.BENCHMARKS["revenue_concentration"]
    return sums.select(
        F.inline(
            F.array(
                band("top10", typical["top_10_pct_accounts"]["typical"]),
                band("top20", typical["top_20_pct_accounts"]["typical"]),
                band("bottom50", typical["bottom_50_pct_accounts"]["typical"]),
            )
        )
    )


def coverage(df: DataFrame, target: Column) -> DataFrame:
    """K9: open value against a target; 1.5 to 2.0 is labelled "low"."""
    levels = fv.BENCHMARKS["pipeline_health"]["coverage_ratio"]
    sums = df.agg(
        money_sum_double(F.when(~won(), F.col("deal_value"))).alias("open_value"),
        target.alias("target"),
    )
    r = F.col("coverage")
    return sums.withColumn(
        "coverage", F.round(ratio(F.col("open_value"), F.col("target")), 6)
    ).withColumn(
        "status",
        F.when(r >= levels["healthy"], "healthy")
        .when(r >= levels["warning"], "warning")
        .when(r >= levels["critical"], "low")
        .otherwise("critical"),
    )


def deal_bracket(value: Column) -> Column:
    """The four deal-size brackets."""
    sizes = fv.BENCHMARKS["deal_size_brackets"]
    return (
        F.when(value < sizes["small"]["max"], "small")
        .when(value < sizes["mid"]["max"], "mid")
        .when(value < sizes["large"]["max"], "large")
        .when(value.isNotNull(), "strategic")
    )


def bracket_mix(df: DataFrame, value: str = "deal_value") -> DataFrame:
    sized = (
        df.withColumn("bracket", deal_bracket(F.col(value)))
        .filter(F.col("bracket").isNotNull())
        .groupBy("bracket")
        .agg(F.count("*").alias("deals"), money_sum(value).alias("_v"))
    )
    return share_of_total(sized, "_v").select(
        "bracket", "deals", F.col("_v").cast("double").alias("total"), "share_pct"
    )


def activity_state(accounts: DataFrame, activity: DataFrame, when: str, as_of: str) -> DataFrame:
    """Days since the last activity and the account's state (31 to 59 is "watch")."""
    last = activity.groupBy("account_id").agg(F.max(when).alias("last_seen"))
    days = F.col("idle_days")
    return (
        accounts.select("account_id")
        .join(last, "account_id", "left")
        .withColumn("idle_days", age_days(F.col("last_seen"), as_of))
        .withColumn(
            "state",
            F.when(days.isNull() | (days >= fv.DORMANT_DAYS), "dormant")
            .when(days >= fv.AT_RISK_DAYS, "at_risk")
            .when(days <= fv.HEALTHY_DAYS, "healthy")
            .otherwise("watch"),
        )
        .drop("last_seen")
    )


def against_benchmark(measured: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Place measured values below, within or above the low-high range.

    ``benchmarks`` is the fixed long table (category, metric, stat, value), a few
    dozen rows, which is what makes the broadcast safe.
    """
    wide = (
        benchmarks.groupBy("category", "metric")
        .pivot("stat", ["low", "median", "high"])
        .agg(F.max("value_num"))
    )
    v = F.col("value")
    return measured.join(F.broadcast(wide), ["category", "metric"]).withColumn(
        "position",
        F.when(v < F.col("low"), "below").when(v > F.col("high"), "above").otherwise("within"),
    )


def compare_periods(df: DataFrame, group: str, value: str, period: Column, a: str, b: str) -> DataFrame:
    """M5: one measure per group in two periods, with difference and ratio."""
    sums = df.groupBy(group).agg(
        money_sum_double(F.when(period == a, F.col(value))).alias("first"),
        money_sum_double(F.when(period == b, F.col(value))).alias("second"),
    )
    return sums.withColumn(
        "difference", F.round(F.col("second") - F.col("first"), 2)
    ).withColumn("change_ratio", F.round(ratio(F.col("second"), F.col("first")), 6))


def period_trend(df: DataFrame, day: str, value: str) -> DataFrame:
    """M6: totals per month with the change from the month before."""
    w = Window.orderBy("month")
    monthly = monthly_totals(df, day, value)
    previous = F.lag(value).over(w)
    return monthly.select(
        "month",
        F.col(value).cast("double").alias("total"),
        (F.col(value) - previous).cast("double").alias("change"),
    )


def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    """Result rows numbered 1..n by descending value."""
    grouped = _summed_parts(df, key, value).select(key, "_value")
    return with_global_order(grouped, "_value", key, position="rank").select(
        F.col("rank").cast("bigint").alias("rank"), key, F.col("_value").alias(value)
    )


def ascending_bar(df: DataFrame, x: str, y: str) -> DataFrame:
    """Two columns without nulls, smallest first."""
    return df.select(x, y).dropna().orderBy(F.col(y).asc(), F.col(x))


