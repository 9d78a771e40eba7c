"""Change tracking on the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dealscope.functions.numbers import money_sum_double
from dealscope.functions.ordering import first_per_group
from dealscope.operators import changes as ch
from dealscope.plans import bindings as b
from dealscope.plans.bindings import table, with_sql
from dealscope.plans.registry import query
from dealscope.session import scratch_path
from dealscope.sources import tables as src

AT = "2024-02-01T00:00:00"
_COLUMNS = ["deal_id", "account_id", "service_line", "stage", "deal_value", "created"]


def _corrected(spark, sf):
    """The deals with urgent ones restated: same rows, some other values."""
    urgent = F.col("service_line") == "1-URGENT"
    return (
        b.deals(spark, sf)
        .withColumn("deal_value", F.when(urgent, F.col("deal_value") + 1).otherwise(F.col("deal_value")))
        .withColumn("stage", F.when(urgent & (F.col("stage") == "Open"), "Won").otherwise(F.col("stage")))
    )


def _grown(spark, sf):
    """The deals after an update: proposals of 1995 gone, open deals of 2000 entered again."""
    deals = b.deals(spark, sf)
    kept = _corrected(spark, sf).filter(~((F.col("stage") == "Proposal") & (F.year("created") == 1995)))
    again = deals.filter((F.col("stage") == "Open") & (F.year("created") == 2000))
    return kept.unionByName(again.withColumn("deal_id", -1 - F.col("deal_id")))


_CORRECTED = """, corrected AS (SELECT deal_id, account_id, service_line, CASE WHEN service_line = '1-URGENT' AND stage = 'Open' THEN 'Won' ELSE stage END AS stage,
 CASE WHEN service_line = '1-URGENT' THEN deal_value + 1 ELSE deal_value END AS deal_value, created FROM deals)"""
_GROWN = _CORRECTED + """, grown AS (SELECT * FROM corrected WHERE NOT (stage = 'Proposal' AND year(created) = 1995)
 UNION ALL SELECT -1 - deal_id, account_id, service_line, stage, deal_value, created FROM deals WHERE stage = 'Open' AND year(created) = 2000)"""


@query("u1_fingerprint", "U1", """SELECT 'orders' AS "table", count(*) AS row_count,
 md5('o_custkey|o_orderdate|o_orderkey|o_orderpriority|o_orderstatus|o_totalprice') AS col_hash FROM orders""")
def fingerprint(spark, sf):
    return ch.fingerprint(table(spark, sf, "orders"), "orders", AT).select("table", "row_count", "col_hash")


@query("u1_row_hash", "U1", """
WITH n AS (SELECT count(*) AS row_count, max(l_orderkey) AS last FROM lineitem)
SELECT v AS variant, CASE v WHEN 'one row less' THEN row_count - 1 ELSE row_count END AS row_count,
 v IN ('columns turned', 'rows dealt anew') AS same_rows, v <> 'column renamed' AS same_columns
FROM n, (VALUES ('columns turned'), ('rows dealt anew'), ('one cell changed'), ('one row less'), ('column renamed'), ('two cells swapped')) t(v)""")
def row_hash(spark, sf):
    """What the row hash tells apart: neither the order of rows nor of columns, but any change of a cell or row."""
    lines = table(spark, sf, "lineitem")
    first = lines.agg(F.min(F.struct("l_orderkey", "l_linenumber"))).scalar()
    is_first = F.struct("l_orderkey", "l_linenumber") == first
    variants = {
        "columns turned": lines.select(*reversed(lines.columns)),
        # dealt by the whole row into as many parts as the session's shuffles have, so that no task reads much of a large table
        "rows dealt anew": lines.repartition(*lines.columns),
        "one cell changed": lines.withColumn("l_tax", F.when(is_first, F.col("l_tax") + 1).otherwise(F.col("l_tax"))),
        "one row less": lines.where(~is_first),
        "column renamed": lines.withColumnRenamed("l_tax", "l_duty"),
        "two cells swapped": lines.withColumns({
            "l_tax": F.when(is_first, F.col("l_quantity")).otherwise(F.col("l_tax")),
            "l_quantity": F.when(is_first, F.col("l_tax")).otherwise(F.col("l_quantity")),
        }),
    }
    own = ch.fingerprint(lines, "lineitem", AT).select(F.struct("row_hash", "col_hash")).scalar()
    prints = None
    for name, df in variants.items():
        one = ch.fingerprint(df, "lineitem", AT).select(
            F.lit(name).alias("variant"), "row_count", (F.col("row_hash") == own["row_hash"]).alias("same_rows"),
            (F.col("col_hash") == own["col_hash"]).alias("same_columns"),
        )
        prints = one if prints is None else prints.unionByName(one)
    return prints


@query("u2_classified_updates", "U2", """
SELECT 'same' AS "table", 'DUPLICATE' AS class, count(*) AS row_count FROM orders
UNION ALL SELECT 'reordered', 'DUPLICATE', count(*) FROM orders
UNION ALL SELECT 'corrected', 'CORRECTED_DATA', count(*) FROM orders
UNION ALL SELECT 'shorter', 'UPDATED_VERSION', count(*) FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'wider', 'UPDATED_VERSION', count(*) FROM orders
UNION ALL SELECT 'unseen', 'NEW_TABLE', count(*) FROM orders""")
def classified_updates(spark, sf):
    deals = b.deals(spark, sf)
    incoming = {
        "same": deals,
        "reordered": deals.orderBy(F.col("deal_value").desc()),
        "corrected": _corrected(spark, sf),
        "shorter": deals.filter(F.col("stage") != "Proposal"),
        "wider": deals.withColumn("region", F.lit("x")),
        "unseen": deals,
    }
    known = ch.fingerprint(deals, "deals", AT)
    names = F.array(*[F.lit(n) for n in incoming if n != "unseen"])
    registry = known.withColumn("table", F.explode(names))
    prints = None
    for name, df in incoming.items():
        one = ch.fingerprint(df, name, AT)
        prints = one if prints is None else prints.unionByName(one)
    return ch.classify(prints, registry).select("table", "class", "row_count")


@query("t1_row_changes", "T1 U3", with_sql("deals") + _GROWN + """
SELECT (SELECT count(*) FROM (SELECT * FROM grown EXCEPT SELECT * FROM deals)) AS rows_added,
       (SELECT count(*) FROM (SELECT * FROM deals EXCEPT SELECT * FROM grown)) AS rows_removed""")
def row_changes(spark, sf):
    return ch.row_changes(b.deals(spark, sf), _grown(spark, sf))


_CELLS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (o.{c} IS DISTINCT FROM n.{c}) AS changed_cells FROM deals o JOIN corrected n ON o.deal_id = n.deal_id"""
    for c in _COLUMNS if c != "deal_id")


@query("u3_cell_changes", "U3 D19", with_sql("deals") + _CORRECTED + f", c AS ({_CELLS}) SELECT * FROM c WHERE changed_cells > 0")
def cell_changes(spark, sf):
    return ch.cell_changes(b.deals(spark, sf), _corrected(spark, sf), ["deal_id"])


def _shown(column, side):
    kind = "DECIMAL(18,2)" if column == "deal_value" else "VARCHAR"
    return f"{side}.{column}::{kind}::VARCHAR"


@query("u3_change_samples", "U3", with_sql("deals") + _CORRECTED + ", c AS (" + " UNION ALL ".join(
    f"""SELECT o.deal_id, '{c}' AS "column", {_shown(c, 'o')} AS old_value, {_shown(c, 'n')} AS new_value
 FROM deals o JOIN corrected n ON o.deal_id = n.deal_id WHERE o.{c} IS DISTINCT FROM n.{c}"""
    for c in _COLUMNS if c != "deal_id") + """)
SELECT deal_id, "column", old_value, new_value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY deal_id) AS rn FROM c) WHERE rn <= 3""")
def change_samples(spark, sf):
    samples = ch.change_samples(b.deals(spark, sf), _corrected(spark, sf), ["deal_id"])
    number = F.col("column") == "deal_value"  # shown with two decimals on both engines

    def shown(name):
        return F.when(number, F.col(name).cast("decimal(18,2)").cast("string")).otherwise(F.col(name)).alias(name)

    return samples.select("deal_id", "column", shown("old_value"), shown("new_value"))


@query("u4_diff_summary", "U3 U4", with_sql("deals") + _CORRECTED + f""", c AS ({_CELLS}),
s AS (SELECT (SELECT count(*) FROM (SELECT * FROM corrected EXCEPT SELECT * FROM deals)) AS rows_added,
 (SELECT count(*) FROM (SELECT * FROM deals EXCEPT SELECT * FROM corrected)) AS rows_removed, 0::BIGINT AS columns_added, 0::BIGINT AS columns_removed,
 (SELECT sum(changed_cells)::BIGINT FROM c) AS changed_cells, (SELECT string_agg("column", ', ' ORDER BY "column") FROM c WHERE changed_cells > 0) AS changed_columns)
SELECT *, rows_added || ' new rows, ' || rows_removed || ' rows removed, ' || changed_cells || ' values corrected in ' || changed_columns AS summary FROM s""")
def diff_summary(spark, sf):
    return ch.diff(b.deals(spark, sf), _corrected(spark, sf), ["deal_id"])


@query("u7_merged_latest", "U7 T3 W8", with_sql("deals") + _GROWN + """
SELECT * FROM grown UNION ALL SELECT * FROM deals WHERE deal_id NOT IN (SELECT deal_id FROM grown)""")
def merged_latest(spark, sf):
    return ch.merge_latest(b.deals(spark, sf), _grown(spark, sf), "deal_id")


@query("w8_latest_per_account", "W8", """
SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def latest_per_account(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return first_per_group(events, ["user_id"], [F.col("event_id").desc()])


@query("u6_registry_upsert", "U6", """
SELECT 'deals' AS "table", count(*) AS row_count FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'events', count(*) FROM events""")
def registry_upsert(spark, sf):
    deals = b.deals(spark, sf)
    registry = ch.fingerprint(deals, "deals", AT).unionByName(
        ch.fingerprint(table(spark, sf, "events"), "events", AT)
    )
    newer = ch.fingerprint(deals.filter(F.col("stage") != "Proposal"), "deals", AT)
    return ch.register(registry, newer).select("table", "row_count")


@query("u8_stale_answers", "U8", with_sql("deals", "questions") + """
, a AS (SELECT conv_id, turn, CASE WHEN phrase LIKE '%deal%' THEN 'deals' WHEN phrase LIKE '%accounts%' THEN 'accounts' ELSE 'events' END AS "table" FROM questions),
u AS (SELECT 'deals' AS "table", abs((SELECT count(*) FROM deals WHERE stage <> 'Proposal') - (SELECT count(*) FROM deals)) / (SELECT count(*) FROM deals)::DOUBLE AS moved
 UNION ALL SELECT 'accounts', 0)
SELECT conv_id, turn, a."table", coalesce(moved > 0.1, false) AS stale FROM a LEFT JOIN u ON a."table" = u."table" """)
def stale_answers(spark, sf):
    asked = F.when(F.col("phrase").contains("deal"), "deals").when(
        F.col("phrase").contains("accounts"), "accounts"
    )
    answers = b.questions(spark, sf).select("conv_id", "turn", asked.otherwise("events").alias("table"))
    deals, accounts = b.deals(spark, sf), b.accounts(spark, sf)
    registry = ch.fingerprint(deals, "deals", AT).unionByName(ch.fingerprint(accounts, "accounts", AT))
    now = ch.fingerprint(deals.filter(F.col("stage") != "Proposal"), "deals", AT).unionByName(
        ch.fingerprint(accounts, "accounts", AT)
    )
    return ch.stale_answers(answers, ch.classify(now, registry))


_GROWN_CELLS = _CELLS.replace("JOIN corrected n", "JOIN grown n")


@query("u5_processed_update", "U5 U3 U4", with_sql("deals") + _GROWN + f""", g AS ({_GROWN_CELLS}),
s AS (SELECT (SELECT count(*) FROM (SELECT * FROM grown EXCEPT SELECT * FROM deals)) AS rows_added,
 (SELECT count(*) FROM (SELECT * FROM deals EXCEPT SELECT * FROM grown)) AS rows_removed)
SELECT rows_added, rows_removed, 0::BIGINT AS columns_added, 0::BIGINT AS columns_removed, changed_cells, changed_columns,
 rows_added || ' new rows, ' || rows_removed || ' rows removed, ' || changed_cells || ' values corrected in ' || changed_columns AS summary
FROM s, (SELECT sum(changed_cells)::BIGINT AS changed_cells, string_agg("column", ', ' ORDER BY "column") FILTER (changed_cells > 0) AS changed_columns FROM g)""")
def processed_update(spark, sf):
    deals = b.deals(spark, sf)
    _, changes = ch.process_update(
        "deals", _grown(spark, sf), ch.fingerprint(deals, "deals", AT), deals, ["deal_id"], AT
    )
    return changes


@query("u9_load_flow", "U9 A7 A8", with_sql("deals") + _CORRECTED + """
SELECT 'NEW_TABLE' AS class, count(*) AS row_count, CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) AS total, 1 AS step FROM deals
UNION ALL SELECT 'DUPLICATE', count(*), CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE), 2 FROM deals
UNION ALL SELECT 'CORRECTED_DATA', count(*), CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE), 3 FROM corrected""")
def load_flow(spark, sf):
    base = scratch_path(spark, "load-flow")
    deals, at = b.deals(spark, sf), dt.datetime(2024, 2, 1)
    registry, current, out = ch.fingerprint(deals, "none", AT).filter(F.lit(False)), None, None
    for step, df in enumerate((deals, deals, _corrected(spark, sf)), 1):
        label, current, registry = ch.load_update(
            spark, "deals", df, registry, base, at + dt.timedelta(hours=step), current
        )
        one = src.load_version(spark, base, "deals", current).agg(
            F.count("*").alias("row_count"), money_sum_double("deal_value").alias("total")
        )
        one = one.select(F.lit(label).alias("class"), "row_count", "total", F.lit(step).alias("step"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a9_version_list", "A7 A9", """
SELECT '20240201T000000_000000Z' AS version, count(*) AS row_count FROM orders
UNION ALL SELECT '20240202T000000_000000Z', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def version_list(spark, sf):
    base, deals = scratch_path(spark, "versions"), b.deals(spark, sf)
    src.save_version(deals, base, "deals", dt.datetime(2024, 2, 1))
    won = deals.filter(F.col("stage") == "Closed Won")
    src.save_version(won, base, "deals", dt.datetime(2024, 2, 2))
    return src.list_versions(spark, base, "deals")


@query("a8_version_rollback", "A8", with_sql("deals") + " SELECT deal_id, account_id, service_line, stage, deal_value, strftime(created, '%Y-%m-%d') AS created FROM deals")
def version_rollback(spark, sf):
    base = scratch_path(spark, "rollback")
    version = src.save_version(b.deals(spark, sf), base, "deals", dt.datetime(2024, 2, 1))
    src.save_version(_grown(spark, sf), base, "deals", dt.datetime(2024, 2, 2))
    old = src.load_version(spark, base, "deals", version)
    return old.withColumn("created", F.date_format("created", "yyyy-MM-dd"))
