"""The business questions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope.operators import analytics as an
from dealscope.operators import questions as qs
from dealscope.plans import bindings as b
from dealscope.plans.bindings import EVENTS_AS_OF, ORDERS_AS_OF, table, with_sql
from dealscope.plans.registry import query

_TOTALS = """t AS (SELECT account_id, CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS v
    FROM deals GROUP BY 1)"""
_LEADING = """r AS (SELECT account_id, v, row_number() OVER w AS rank, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS run,
        sum(v) OVER () AS tot FROM t WINDOW w AS (ORDER BY v DESC, account_id))
SELECT account_id, CAST(v AS DOUBLE) AS {value}, rank,
       round(CAST(run AS DOUBLE) / CAST(tot AS DOUBLE) * 100, 6) AS cum_pct
FROM r WHERE CAST(run - v AS DOUBLE) / CAST(tot AS DOUBLE) * 100 < 80"""
LINES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("q1_accounts_for_80_pct", "Q1 W1", with_sql("deals") + f", {_TOTALS}, " + _LEADING.format(value="deal_value"))
def accounts_for_80_pct(spark, sf):
    return an.leading_accounts(b.deals(spark, sf), "account_id", "deal_value")


@query("q2_profit_concentration", "Q2 W1", with_sql("deals") + """
, t AS (SELECT account_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(6,2)))) AS DECIMAL(38,4)) AS v
        FROM lineitem JOIN deals ON l_orderkey = deal_id GROUP BY 1)
, r AS (SELECT account_id, v, row_number() OVER w AS rank, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS run,
        sum(v) OVER () AS tot FROM t WINDOW w AS (ORDER BY v DESC, account_id))
SELECT account_id, CAST(v AS DOUBLE) AS profit, rank,
       round(CAST(run AS DOUBLE) / CAST(tot AS DOUBLE) * 100, 6) AS cum_pct FROM r""")
def profit_concentration(spark, sf):
    net = F.col("l_extendedprice").cast("decimal(14,2)") * (
        F.lit(1) - F.col("l_discount").cast("decimal(6,2)")
    )
    per_deal = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("deal_id"))
        .agg(F.sum(net).cast("decimal(28,4)").alias("profit"))
    )
    facts = per_deal.join(b.deals(spark, sf).select("deal_id", "account_id"), "deal_id")
    return an.pareto(facts, "account_id", "profit", F.col("profit")).drop("_before_pct")


@query("q3_dormant_accounts", "Q3", with_sql("accounts", "activities") + f"""
, l AS (SELECT account_id, max(ts) AS seen FROM activities GROUP BY 1),
d AS (SELECT a.account_id, a.account_name, date_diff('day', CAST(seen AS DATE), DATE '{EVENTS_AS_OF}') AS idle_days
      FROM accounts a LEFT JOIN l ON a.account_id = l.account_id)
SELECT * FROM d WHERE idle_days IS NULL OR idle_days >= 90""")
def dormant_accounts(spark, sf):
    return qs.dormant_accounts(b.accounts(spark, sf), b.activities(spark, sf), EVENTS_AS_OF)


@query("q4_tenure_vs_volume", "Q4", with_sql("deals") + f"""
, p AS (SELECT account_id, date_diff('day', CAST(min(created) AS DATE), DATE '{ORDERS_AS_OF}') AS tenure_days, count(*) AS deals
        FROM deals GROUP BY 1),
n AS (SELECT *, ntile(4) OVER (ORDER BY tenure_days DESC, account_id) AS tenure_quartile,
             ntile(4) OVER (ORDER BY deals, account_id) AS volume_quartile FROM p)
SELECT account_id, tenure_days, deals, CAST(tenure_quartile AS INT) AS tenure_quartile, CAST(volume_quartile AS INT) AS volume_quartile
FROM n WHERE tenure_quartile = 1 AND volume_quartile = 1""")
def tenure_vs_volume(spark, sf):
    return qs.tenure_vs_volume(b.deals(spark, sf), ORDERS_AS_OF)


@query("q5_win_rate_by_line", "Q5 K3", with_sql("deals") + """
SELECT service_line, count(*) FILTER (stage = 'Closed Won') AS won, count(*) AS deals,
       round(count(*) FILTER (stage = 'Closed Won') / CAST(count(*) AS DOUBLE) * 100, 4) AS win_rate_pct FROM deals GROUP BY 1""")
def win_rate_by_line(spark, sf):
    return an.win_rate(b.deals(spark, sf), "service_line")


@query("q6_win_rate_by_size", "Q6 K3", with_sql("deals") + """
, s AS (SELECT CASE WHEN deal_value * 3 < 100000 THEN 'small' WHEN deal_value * 3 < 500000 THEN 'mid' ELSE 'large' END AS size, stage FROM deals)
SELECT size, count(*) FILTER (stage = 'Closed Won') AS won, count(*) AS deals,
       round(count(*) FILTER (stage = 'Closed Won') / CAST(count(*) AS DOUBLE) * 100, 4) AS win_rate_pct FROM s GROUP BY 1""")
def win_rate_by_size(spark, sf):
    sized = b.deals(spark, sf).withColumn("size", qs.size_class(F.col("deal_value") * 3))
    return an.win_rate(sized, "size")


@query("q7_cycle_by_line", "Q7 X5", with_sql("deals", "closed") + """
SELECT service_line, round(sum(floor(date_diff('second', created, close_date) / 86400.0)) / CAST(count(*) AS DOUBLE), 4) AS avg_days,
       count(*) AS deals FROM closed WHERE close_date IS NOT NULL GROUP BY 1""")
def cycle_by_line(spark, sf):
    return an.cycle_by_group(b.deals_with_close(spark, sf), "service_line")


@query("q8_stale_open_deals", "Q8", with_sql("deals") + """
, a AS (SELECT deal_id, account_id, stage, date_diff('day', CAST(created AS DATE), DATE '2001-08-15') AS age_days
        FROM deals WHERE stage <> 'Closed Won')
SELECT * FROM a WHERE age_days >= 90""")
def stale_open_deals(spark, sf):
    return qs.stale_deals(b.deals(spark, sf), "2001-08-15")


@query("q9_stage_drop_off", "Q9", with_sql("activities") + """
, s AS (SELECT kind, count(DISTINCT account_id) AS accounts, count(*) AS events,
               CAST(list_position(['view','click','signup','purchase'], kind) - 1 AS BIGINT) AS stage_no
        FROM activities WHERE kind IN ('view','click','signup','purchase') GROUP BY 1),
d AS (SELECT *, round((1 - events / CAST(lag(events) OVER (ORDER BY stage_no) AS DOUBLE)) * 100, 4) AS drop_pct FROM s)
SELECT *, coalesce(drop_pct = max(drop_pct) OVER (), false) AS highest_leak FROM d""")
def stage_drop_off(spark, sf):
    return qs.stage_drop_off(b.activities(spark, sf), ["view", "click", "signup", "purchase"])


@query("q10_won_low_engagement", "Q10", with_sql("accounts", "activities", "deals") + """
, e AS (SELECT a.account_id, count(v.account_id) AS events FROM accounts a LEFT JOIN activities v ON a.account_id = v.account_id GROUP BY 1),
q AS (SELECT *, ntile(4) OVER (ORDER BY events, account_id) AS t FROM e),
w AS (SELECT account_id, count(*) AS won FROM deals WHERE stage = 'Closed Won' GROUP BY 1)
SELECT q.account_id, q.events, w.won FROM q JOIN w ON q.account_id = w.account_id WHERE t = 1""")
def won_low_engagement(spark, sf):
    return qs.won_despite_low_engagement(
        b.accounts(spark, sf), b.activities(spark, sf), b.deals(spark, sf)
    )


@query("q11_underexploited_accounts", "Q11", with_sql("accounts", "deals") + """
, n AS (SELECT a.account_id, a.revenue, count(d.deal_id) AS deals FROM accounts a LEFT JOIN deals d ON a.account_id = d.account_id GROUP BY 1, 2),
q AS (SELECT *, ntile(4) OVER (ORDER BY CAST(revenue AS DECIMAL(18,2)) DESC, account_id) AS big,
             ntile(4) OVER (ORDER BY deals, account_id) AS few FROM n)
SELECT account_id, revenue, deals FROM q WHERE big = 1 AND few = 1""")
def underexploited_accounts(spark, sf):
    return qs.underexploited_accounts(b.accounts(spark, sf), b.deals(spark, sf))


@query("q12_underselling_lines", "Q12", with_sql("deals") + """
, l AS (SELECT service_line, round(count(*) FILTER (stage = 'Closed Won') / CAST(count(*) AS DOUBLE) * 100, 4) AS win_rate_pct,
        CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (stage <> 'Closed Won') AS DOUBLE) AS open_value FROM deals GROUP BY 1),
m AS (SELECT *, round(avg(win_rate_pct) OVER (), 4) AS mean_rate, round(avg(open_value) OVER (), 2) AS mean_open FROM l)
SELECT *, win_rate_pct > mean_rate AND open_value < mean_open AS underselling FROM m""")
def underselling_lines(spark, sf):
    return qs.underselling_lines(b.deals(spark, sf))


@query("q14_account_segments", "Q14", with_sql("accounts", "activities", "deals") + f"""
, e AS (SELECT a.account_id, count(v.account_id) AS events FROM accounts a LEFT JOIN activities v ON a.account_id = v.account_id GROUP BY 1),
p AS (SELECT account_id, sum(CAST(deal_value AS DECIMAL(18,2))) AS rev,
             date_diff('day', CAST(min(created) AS DATE), DATE '{ORDERS_AS_OF}') AS tenure FROM deals GROUP BY 1),
n AS (SELECT p.rev, CAST(ntile(3) OVER (ORDER BY rev DESC, p.account_id) AS INT) AS revenue_tier,
             CAST(ntile(3) OVER (ORDER BY tenure DESC, p.account_id) AS INT) AS tenure_tier,
             CAST(ntile(3) OVER (ORDER BY events DESC, p.account_id) AS INT) AS activity_tier
      FROM p JOIN e ON p.account_id = e.account_id)
SELECT revenue_tier, tenure_tier, activity_tier, count(*) AS accounts, CAST(sum(rev) AS DOUBLE) AS revenue FROM n GROUP BY 1, 2, 3""")
def account_segments(spark, sf):
    return qs.segments(
        b.accounts(spark, sf), b.activities(spark, sf), b.deals(spark, sf), ORDERS_AS_OF
    )


@query("q15_open_deal_health", "Q15", with_sql("deals") + """
, o AS (SELECT *, max(deal_value) OVER () AS mx,
               least(greatest(date_diff('day', CAST(created AS DATE), DATE '2001-08-15'), 0), 365) AS age FROM deals WHERE stage <> 'Closed Won'),
s AS (SELECT service_line, round(((1 - age / CAST(365 AS DOUBLE)) * 0.4::DOUBLE + deal_value / mx * 0.3::DOUBLE
             + CASE WHEN stage = 'Proposal' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * 0.3::DOUBLE) * 100, 2) AS score FROM o)
SELECT service_line, count(*) AS deals, round(CAST(sum(CAST(score AS DECIMAL(9,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE), 4) AS avg_score,
       max(score) AS best, min(score) AS worst FROM s GROUP BY 1""")
def open_deal_health(spark, sf):
    return qs.deal_health(b.deals(spark, sf), "2001-08-15")


_FEATURES = ("deal_value", "age_days", "items", "quantity")


@query("q16_win_drivers", "Q16", with_sql("deals") + f"""
, l AS (SELECT l_orderkey, count(*) AS items, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
f AS (SELECT CASE WHEN stage = 'Closed Won' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w, CAST(deal_value AS DOUBLE) AS deal_value,
             CAST(date_diff('day', CAST(created AS DATE), DATE '{ORDERS_AS_OF}') AS DOUBLE) AS age_days,
             CAST(coalesce(items, 0) AS DOUBLE) AS items, CAST(coalesce(quantity, 0) AS DOUBLE) AS quantity
      FROM deals LEFT JOIN l ON deal_id = l_orderkey),
c AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(w, {c}), 6) AS corr FROM f" for c in _FEATURES) + """)
SELECT feature, corr, abs(corr) AS strength FROM c""")
def win_drivers(spark, sf):
    base = qs.driver_features(b.deals(spark, sf), table(spark, sf, "lineitem"), ORDERS_AS_OF)
    return qs.win_drivers(base, list(_FEATURES))


@query("q17_cross_sell_map", "Q17 M2", with_sql("deals") + ", p AS (SELECT account_id, " + ", ".join(
    f"""CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (service_line = '{x}') AS DOUBLE) AS "{x}" """ for x in LINES)
    + """ FROM deals WHERE stage = 'Closed Won' GROUP BY 1)
SELECT account_id, """ + ", ".join(f'coalesce("{x}", 0) AS "{x}"' for x in LINES)
    + ", concat_ws(', ', " + ", ".join(f"""CASE WHEN "{x}" IS NULL THEN '{x}' END""" for x in LINES)
    + ") AS missing_lines FROM p WHERE " + " + ".join(f'CASE WHEN "{x}" IS NULL THEN 0 ELSE 1 END' for x in LINES) + " = 1")
def cross_sell_map(spark, sf):
    return qs.cross_sell(b.deals(spark, sf))


@query("q19_incomplete_deals", "Q19 C13", with_sql("deals", "closed", "gaps") + """
SELECT deal_id, account_id, concat_ws(', ', CASE WHEN close_date IS NULL THEN 'close_date' END,
       CASE WHEN deal_value IS NULL THEN 'deal_value' END) AS missing FROM gaps WHERE close_date IS NULL OR deal_value IS NULL""")
def incomplete_deals(spark, sf):
    return qs.incomplete_deals(b.deals_with_gaps(spark, sf))


_SPELLINGS = r"""s AS (SELECT substring(md5(c_custkey::VARCHAR), 1, 12) AS m, c_custkey AS k FROM customer),
n AS (SELECT m AS name FROM s UNION ALL SELECT left(m, (k % 11)::INT) || substr(m, (k % 11)::INT + 2) FROM s WHERE k % 3 = 0
 UNION ALL SELECT left(m, (k % 7)::INT) || 'zz' || substr(m, (k % 7)::INT + 1) FROM s WHERE k % 5 = 0 UNION ALL SELECT m || 'xyz' FROM s WHERE k % 4 = 0
 UNION ALL SELECT p_name FROM part),
u AS (SELECT regexp_replace(lower(name), '[^\p{L}\p{M}\p{N}]', '', 'g') AS name, count(*) AS accounts FROM n GROUP BY 1)"""


@query("q20_similar_accounts", "Q20", f"""WITH {_SPELLINGS}
SELECT a.name, b.name AS other, levenshtein(a.name, b.name)::INT AS distance, a.accounts, b.accounts AS other_accounts
FROM u a JOIN u b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 2 WHERE levenshtein(a.name, b.name) <= 2""")
def similar_accounts(spark, sf):
    """Customers under names of letters and digits, some entered again with a character lost or two too many."""
    made = table(spark, sf, "customer").select(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 12).alias("m"), F.col("c_custkey").alias("k"))
    cut = lambda n, extra, skip: F.expr(f"concat(left(m, CAST(k % {n} AS INT)), '{extra}', substring(m, CAST(k % {n} AS INT) + {skip}))")
    names = made.select(F.col("m").alias("account_name"))
    for part in (
        made.where("k % 3 = 0").select(cut(11, "", 2).alias("account_name")),
        made.where("k % 5 = 0").select(cut(7, "zz", 1).alias("account_name")),
        made.where("k % 4 = 0").select(F.concat("m", F.lit("xyz")).alias("account_name")),
        table(spark, sf, "part").select(F.col("p_name").alias("account_name")),
    ):
        names = names.unionByName(part)
    return qs.similar_accounts(names, qs.name_key(F.col("account_name")))


@query("q20_duplicate_accounts", "Q20", r"""
WITH a AS (SELECT c_name AS account_name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT p_name FROM part),
k AS (SELECT account_name, regexp_replace(regexp_replace(lower(account_name), '[^\p{L}\p{M}\p{N}]', '', 'g'), '^(customer|supplier)', '') AS name_key FROM a)
SELECT name_key, count(*) AS accounts, min(account_name) AS first_name, max(account_name) AS last_name
FROM k WHERE name_key <> '' GROUP BY 1 HAVING count(*) > 1""")
def duplicate_accounts(spark, sf):
    names = [
        table(spark, sf, t).select(F.col(c).alias("account_name"))
        for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))
    ]
    everyone = names[0].unionByName(names[1]).unionByName(names[2])
    key = F.regexp_replace(qs.name_key(F.col("account_name")), "^(customer|supplier)", "")
    return qs.duplicate_accounts(everyone, key)


@query("q21_unclassified_share", "Q21", with_sql("deals", "closed", "gaps") + """
, o AS (SELECT count(*) AS open_deals, count(*) FILTER (service_line IS NULL) AS unclassified,
  coalesce(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (service_line IS NULL) AS DOUBLE), 0) AS unclassified_value,
  coalesce(CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE), 0) AS open_value FROM gaps WHERE stage <> 'Closed Won')
SELECT *, round(unclassified / CAST(open_deals AS DOUBLE) * 100, 4) AS pct_deals,
       round(unclassified_value / open_value * 100, 4) AS pct_value FROM o""")
def unclassified_share(spark, sf):
    return qs.unclassified_share(b.deals_with_gaps(spark, sf))


@query("x5_days_open", "X5", with_sql("activities") + f"""
SELECT kind, sum(CAST(floor(date_diff('second', ts, TIMESTAMP '{EVENTS_AS_OF} 00:00:00') / 86400.0) AS BIGINT))::BIGINT AS days, count(*) AS n
FROM activities GROUP BY 1""")
def days_open(spark, sf):
    dated = b.activities(spark, sf).withColumnRenamed("ts", "created")
    return (
        qs.days_open(dated, EVENTS_AS_OF)
        .groupBy("kind")
        .agg(F.sum("days_open").alias("days"), F.count("*").alias("n"))
    )
