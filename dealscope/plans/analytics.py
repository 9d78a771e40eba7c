"""Windows, top-k and dashboard analytics on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope.functions.numbers import money_sum, money_sum_double
from dealscope.operators import analytics as an
from dealscope.plans import bindings as b
from dealscope.plans.bindings import with_sql
from dealscope.plans.registry import query
from dealscope.sources.benchmarks import benchmark_table

_ACCOUNT_SUM = """t AS (SELECT account_id, CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS v
    FROM deals GROUP BY 1)"""


@query("w1_pareto_accounts", "W1 E22", with_sql("deals") + f""", {_ACCOUNT_SUM}
SELECT account_id, CAST(v AS DOUBLE) AS deal_value,
       row_number() OVER (ORDER BY v DESC, account_id) AS rank,
       round(CAST(sum(v) OVER (ORDER BY v DESC, account_id ROWS UNBOUNDED PRECEDING) AS DOUBLE)
             / CAST(sum(v) OVER () AS DOUBLE) * 100, 6) AS cum_pct
FROM t""")
def pareto_accounts(spark, sf):
    return an.pareto(b.deals(spark, sf), "account_id", "deal_value").drop("_before_pct")


@query("w2_monthly_moving_average", "W2 X6", with_sql("deals") + """,
m AS (SELECT strftime(created, '%Y-%m') AS month, sum(CAST(deal_value AS DECIMAL(18,2))) AS v
      FROM deals GROUP BY 1)
SELECT month, CAST(v AS DOUBLE) AS deal_value,
       round(CAST(sum(v) OVER w AS DOUBLE) / CAST(count(v) OVER w AS DOUBLE), 4) AS moving_avg
FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def monthly_moving_average(spark, sf):
    monthly = an.monthly_totals(b.deals(spark, sf), "created", "deal_value")
    out = an.moving_average(monthly, "month", "deal_value")
    return out.withColumn("deal_value", F.col("deal_value").cast("double"))


@query("w3_ranked_accounts", "W3", with_sql("deals") + f""", {_ACCOUNT_SUM}
SELECT row_number() OVER (ORDER BY v DESC, account_id) AS rank, account_id, CAST(v AS DOUBLE) AS deal_value FROM t""")
def ranked_accounts(spark, sf):
    return an.ranked(b.deals(spark, sf), "account_id", "deal_value")


@query("w4_event_funnel", "W4", with_sql("activities") + """
, f AS (SELECT kind, count(*) AS size FROM activities GROUP BY 1)
SELECT kind, size, round(size / CAST(max(size) OVER () AS DOUBLE) * 100, 6) AS pct_of_first FROM f""")
def event_funnel(spark, sf):
    return an.funnel(b.activities(spark, sf), "kind")


@query("w5_value_share", "W5", with_sql("deals") + """
, s AS (SELECT service_line, sum(CAST(deal_value AS DECIMAL(18,2))) AS v FROM deals GROUP BY 1)
SELECT service_line, CAST(v AS DOUBLE) AS total,
       round(CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) * 100, 6) AS share_pct FROM s""")
def value_share(spark, sf):
    sums = b.deals(spark, sf).groupBy("service_line").agg(money_sum("deal_value").alias("total"))
    return an.share_of_total(sums, "total").withColumn("total", F.col("total").cast("double"))


@query("k1_revenue_concentration", "K1 S1 E22", with_sql("accounts", "deals") + """
, t AS (SELECT account_name, sum(CAST(deal_value AS DECIMAL(18,2))) AS v
        FROM deals JOIN accounts USING (account_id) GROUP BY 1 ORDER BY v DESC, account_name LIMIT 20)
SELECT account_name, CAST(v AS DOUBLE) AS deal_value,
       round(CAST(sum(v) OVER (ORDER BY v DESC, account_name ROWS UNBOUNDED PRECEDING) AS DOUBLE)
             / CAST(sum(v) OVER () AS DOUBLE) * 100, 6) AS cum_pct FROM t""")
def revenue_concentration(spark, sf):
    totals = an.account_totals(b.deals(spark, sf), b.accounts(spark, sf), "deal_value")
    return an.concentration(totals, "account_name", "deal_value")


@query("k2_stage_funnel", "K2 W4", with_sql("deals") + """
, f AS (SELECT stage, sum(CAST(deal_value AS DECIMAL(18,2))) AS v FROM deals GROUP BY 1)
SELECT stage, CAST(v AS DOUBLE) AS size,
       round(CAST(v AS DOUBLE) / CAST(max(v) OVER () AS DOUBLE) * 100, 6) AS pct_of_first FROM f""")
def stage_funnel(spark, sf):
    return an.funnel(b.deals(spark, sf), "stage", "deal_value")


@query("k3_win_rate_by_line", "K3 C12", with_sql("deals") + """
, r AS (SELECT service_line, round(count(*) FILTER (lower(stage) IN ('won','closed won','win'))
                / CAST(count(*) AS DOUBLE) * 100, 4) AS win_rate_pct FROM deals GROUP BY 1)
SELECT service_line, win_rate_pct, CAST(28 AS DOUBLE) AS benchmark_pct,
       round(win_rate_pct - 28, 4) AS gap FROM r""")
def win_rate_by_line(spark, sf):
    return an.win_rate_vs_benchmark(b.deals(spark, sf), "service_line")


@query("k4_sales_cycle_trend", "K4 W2 X5 X6", with_sql("deals", "closed") + """
, m AS (SELECT strftime(close_date, '%Y-%m') AS month,
               round(sum(floor(date_diff('second', created, close_date) / 86400.0)) / CAST(count(*) AS DOUBLE), 4) AS avg_days
        FROM closed WHERE close_date IS NOT NULL AND created IS NOT NULL GROUP BY 1)
SELECT month, avg_days, CAST(84 AS BIGINT) AS benchmark_days,
       round(CAST(sum(CAST(avg_days AS DECIMAL(18,4))) OVER w AS DOUBLE) / CAST(count(*) OVER w AS DOUBLE), 4) AS moving_avg
FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def sales_cycle_trend(spark, sf):
    return an.cycle_trend(b.deals_with_close(spark, sf))


@query("k5_top_accounts", "K5 S2", with_sql("accounts", "deals") + """
SELECT account_name, CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) AS deal_value
FROM deals JOIN accounts USING (account_id) GROUP BY 1 ORDER BY deal_value DESC, account_name LIMIT 10""")
def top_accounts(spark, sf):
    totals = an.account_totals(b.deals(spark, sf), b.accounts(spark, sf), "deal_value")
    top = an.top_groups(totals, "account_name", "deal_value", 10)
    return top.select("account_name", F.col("_value").cast("double").alias("deal_value")).orderBy(
        "deal_value", F.col("account_name").desc()
    )


@query("k6_account_matrix", "K6 S4", with_sql("accounts") + """
SELECT account_name, account_id, coalesce(revenue, 0) AS revenue, nation_id
FROM accounts ORDER BY account_id LIMIT 30""")
def account_matrix(spark, sf):
    return an.numeric_matrix(b.accounts(spark, sf), "account_name", "account_id", 30)


@query("k7_kpi_set", "K7 E23 E25", with_sql("accounts", "deals") + """
SELECT (SELECT count(DISTINCT account_id) FROM accounts) AS accounts,
       (SELECT CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) FROM accounts) AS revenue,
       (SELECT CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) FROM deals
         WHERE lower(stage) NOT IN ('won','closed won','win')) AS open_value,
       (SELECT round(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(deal_value) AS DOUBLE), 4)
          FROM deals) AS avg_deal_size""")
def kpi_set(spark, sf):
    return an.kpis(b.accounts(spark, sf), b.deals(spark, sf))


@query("e22_group_totals", "E22", with_sql("deals", "closed", "gaps") + """
SELECT service_line, coalesce(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE), 0) AS total,
       count(*) AS row_count,
       round(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) / CAST(count(deal_value) AS DOUBLE), 4) AS mean
FROM gaps WHERE service_line IS NOT NULL GROUP BY 1""")
def group_totals(spark, sf):
    return an.group_totals(b.deals_with_gaps(spark, sf), "service_line", "deal_value")


@query("e24_distinct_accounts", "E24", """
SELECT 'distinct' AS kind, count(DISTINCT o_custkey) AS n FROM orders
UNION ALL SELECT 'rows', count(*) FROM orders""")
def distinct_accounts(spark, sf):
    deals = b.deals(spark, sf)
    exact = an.distinct_or_rows(deals, "account_id").select(F.lit("distinct").alias("kind"), "n")
    rows = an.distinct_or_rows(deals, None).select(F.lit("rows").alias("kind"), "n")
    return exact.unionByName(rows)


@query("s3_ascending_bar", "S3 C3", with_sql("deals", "closed", "gaps") + """
SELECT deal_id, deal_value FROM gaps WHERE deal_value IS NOT NULL AND deal_id IS NOT NULL""")
def ascending_bar(spark, sf):
    return an.ascending_bar(b.deals_with_gaps(spark, sf), "deal_id", "deal_value")


@query("k8_concentration_bands", "K8", with_sql("deals") + f""", {_ACCOUNT_SUM},
o AS (SELECT v, row_number() OVER (ORDER BY v DESC, account_id) AS p, count(*) OVER () AS n FROM t),
s AS (SELECT CAST(sum(v) FILTER (p * 10 <= n) AS DOUBLE) AS a, CAST(sum(v) FILTER (p * 5 <= n) AS DOUBLE) AS b,
             CAST(sum(v) FILTER (p * 2 > n) AS DOUBLE) AS c, CAST(sum(v) AS DOUBLE) AS t FROM o)
SELECT 'top10' AS band, round(a / t * 100, 4) AS share_pct, CAST(65 AS BIGINT) AS typical_pct, round(round(a / t * 100, 4) - 65, 4) AS gap FROM s
UNION ALL SELECT 'top20', round(b / t * 100, 4), 80, round(round(b / t * 100, 4) - 80, 4) FROM s
UNION ALL SELECT 'bottom50', round(c / t * 100, 4), 7, round(round(c / t * 100, 4) - 7, 4) FROM s""")
def concentration_bands(spark, sf):
    return an.concentration_bands(b.deals(spark, sf), "account_id", "deal_value")


@query("k9_open_value_coverage", "K9", with_sql("deals") + """
, s AS (SELECT CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (stage <> 'Closed Won') AS DOUBLE) AS open_value,
               CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (stage = 'Closed Won') AS DOUBLE) AS target FROM deals)
SELECT open_value, target, round(open_value / target, 6) AS coverage,
       CASE WHEN round(open_value / target, 6) >= 3 THEN 'healthy' WHEN round(open_value / target, 6) >= 2 THEN 'warning'
            WHEN round(open_value / target, 6) >= 1.5 THEN 'low' ELSE 'critical' END AS status FROM s""")
def open_value_coverage(spark, sf):
    target = money_sum_double(F.when(an.won(), F.col("deal_value")))
    return an.coverage(b.deals(spark, sf), target)


@query("k10_deal_brackets", "K10", with_sql("deals") + """
, s AS (SELECT CASE WHEN deal_value * 6 < 100000 THEN 'small' WHEN deal_value * 6 < 500000 THEN 'mid'
                    WHEN deal_value * 6 < 2000000 THEN 'large' ELSE 'strategic' END AS bracket,
               count(*) AS deals, sum(CAST(CAST(deal_value AS DECIMAL(18,2)) * 6 AS DECIMAL(28,2))) AS v FROM deals GROUP BY 1)
SELECT bracket, deals, CAST(v AS DOUBLE) AS total,
       round(CAST(v AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) * 100, 6) AS share_pct FROM s""")
def deal_brackets(spark, sf):
    scaled = b.deals(spark, sf).withColumn("deal_value", F.col("deal_value") * 6)
    return an.bracket_mix(scaled)


@query("k11_account_states", "K11", with_sql("accounts", "deals") + """
, l AS (SELECT account_id, max(created) AS seen FROM deals GROUP BY 1),
d AS (SELECT a.account_id, date_diff('day', CAST(l.seen AS DATE), DATE '2001-08-15') AS idle_days
      FROM accounts a LEFT JOIN l ON a.account_id = l.account_id)
SELECT account_id, idle_days, CASE WHEN idle_days IS NULL OR idle_days >= 90 THEN 'dormant'
       WHEN idle_days >= 60 THEN 'at_risk' WHEN idle_days <= 30 THEN 'healthy' ELSE 'watch' END AS state FROM d""")
def account_states(spark, sf):
    return an.activity_state(b.accounts(spark, sf), b.deals(spark, sf), "created", "2001-08-15")


@query("k12_metrics_vs_benchmark", "K12 A17", with_sql("deals", "closed") + """
, r AS (SELECT 'win_rates' AS category, 'competitive_tender' AS metric, service_line AS subject,
        round(count(*) FILTER (stage = 'Closed Won') / CAST(count(*) AS DOUBLE) * 100, 4) AS value FROM closed GROUP BY service_line),
c AS (SELECT 'sales_cycle_days' AS category, CASE WHEN deal_value < 100000 THEN 'under_100k' ELSE 'between_100k_500k' END AS metric,
        service_line AS subject, round(sum(floor(date_diff('second', created, close_date) / 86400.0)) / CAST(count(*) AS DOUBLE), 4) AS value
      FROM closed WHERE close_date IS NOT NULL GROUP BY 2, 3),
m AS (SELECT * FROM r UNION ALL SELECT * FROM c),
bm(category, metric, low, median, high) AS (VALUES
  ('win_rates', 'competitive_tender', 15.0::DOUBLE, 28.0::DOUBLE, 40.0::DOUBLE),
  ('sales_cycle_days', 'under_100k', 20.0, 45.0, 75.0),
  ('sales_cycle_days', 'between_100k_500k', 60.0, 135.0, 200.0))
SELECT m.category, m.metric, m.subject, m.value, bm.low, bm.median, bm.high,
       CASE WHEN m.value < bm.low THEN 'below' WHEN m.value > bm.high THEN 'above' ELSE 'within' END AS position
FROM m JOIN bm ON m.category = bm.category AND m.metric = bm.metric""")
def metrics_vs_benchmark(spark, sf):
    deals = b.deals_with_close(spark, sf)
    rates = an.win_rate(deals, "service_line").select(
        F.lit("win_rates").alias("category"),
        F.lit("competitive_tender").alias("metric"),
        F.col("service_line").alias("subject"),
        F.col("win_rate_pct").alias("value"),
    )
    bracket = F.when(F.col("deal_value") < 100000, "under_100k").otherwise("between_100k_500k")
    cycles = (
        an.cycle_days(deals)
        .groupBy(bracket.alias("metric"), F.col("service_line").alias("subject"))
        .agg(F.round(F.sum("days").cast("double") / F.count("days"), 4).alias("value"))
        .select(F.lit("sales_cycle_days").alias("category"), "metric", "subject", "value")
    )
    return an.against_benchmark(rates.unionByName(cycles), benchmark_table(spark))


@query("m5_compare_years", "M5", with_sql("deals") + """
, s AS (SELECT service_line,
  coalesce(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (strftime(created, '%Y') = '1999') AS DOUBLE), 0) AS "first",
  coalesce(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (strftime(created, '%Y') = '2000') AS DOUBLE), 0) AS second
  FROM deals GROUP BY 1)
SELECT service_line, "first", second, round(second - "first", 2) AS difference, round(second / "first", 6) AS change_ratio FROM s""")
def compare_years(spark, sf):
    year = F.date_format("created", "yyyy")
    return an.compare_periods(b.deals(spark, sf), "service_line", "deal_value", year, "1999", "2000")


@query("m6_monthly_trend", "M6 X6", with_sql("deals") + """
, m AS (SELECT strftime(created, '%Y-%m') AS month, sum(CAST(deal_value AS DECIMAL(18,2))) AS v FROM deals GROUP BY 1)
SELECT month, CAST(v AS DOUBLE) AS total, CAST(v - lag(v) OVER (ORDER BY month) AS DOUBLE) AS change FROM m""")
def monthly_trend(spark, sf):
    return an.period_trend(b.deals(spark, sf), "created", "deal_value")


