"""Join discovery, quality and joins on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope.operators import joins as jn
from dealscope.plans import bindings as b
from dealscope.plans.bindings import table, with_sql
from dealscope.plans.registry import query


def _crm(spark, sf):
    return {
        "accounts": b.accounts(spark, sf),
        "deals": b.deals(spark, sf),
        "nation": table(spark, sf, "nation").withColumnsRenamed(
            {"n_nationkey": "nation_id", "n_name": "nation_name", "n_regionkey": "region_id"}
        ),
        "region": table(spark, sf, "region").withColumnsRenamed(
            {"r_regionkey": "region_id", "r_name": "region_name"}
        ),
    }


# name similarities of the gated pairs are metadata; overlaps come from the data
_PAIRS = [
    ("accounts", "deals", "account_id", "account_id", 1.0),
    ("accounts", "nation", "nation_id", "nation_id", 1.0),
    ("nation", "region", "region_id", "region_id", 1.0),
    ("accounts", "region", "nation_id", "region_id", "6::DOUBLE / 12"),  # "nation" and "region" share "ion"
    ("deals", "nation", "account_id", "nation_id", "6::DOUBLE / 13"),  # "account" and "nation" share "aon"
]
_CRM = with_sql("accounts", "deals") + """, nation_t AS (SELECT n_nationkey AS nation_id, n_name AS nation_name, n_regionkey AS region_id FROM nation),
region_t AS (SELECT r_regionkey AS region_id, r_name AS region_name FROM region)"""


def _overlap_sql(left, right, lc, rc, sim):
    src = {"nation": "nation_t", "region": "region_t"}
    l, r = src.get(left, left), src.get(right, right)
    return f"""SELECT '{left}' AS left_table, '{right}' AS right_table, '{lc}' AS left_col, '{rc}' AS right_col, ({sim})::DOUBLE AS name_similarity,
 greatest(s / dl, s / dr) AS overlap FROM (SELECT (SELECT count(DISTINCT {lc}) FROM {l})::DOUBLE AS dl, (SELECT count(DISTINCT {rc}) FROM {r})::DOUBLE AS dr,
 (SELECT count(*) FROM (SELECT {lc} FROM {l} INTERSECT SELECT {rc} FROM {r}))::DOUBLE AS s)"""


@query("d1_join_candidates", "D1 D2 D3 D11", _CRM + ", o AS (" + " UNION ALL ".join(_overlap_sql(*p) for p in _PAIRS) + """)
SELECT left_table, right_table, left_col, right_col, round(name_similarity, 4) AS name_similarity, round(overlap, 4) AS value_overlap,
 round(0.4::DOUBLE * name_similarity + 0.6::DOUBLE * overlap, 4) AS confidence FROM o""")
def join_candidates(spark, sf):
    found = jn.suggest(_crm(spark, sf))
    return jn.candidate_rows(spark, jn.best_per_pair(found))


_WIDE = [("c_custkey", "o_custkey"), ("c_custkey", "o_orderkey")]


@query("d1_key_overlaps", "D1 D3", " UNION ALL ".join(f"""
SELECT '{a}' AS left_col, '{c}' AS right_col, (SELECT count(DISTINCT {a}) FROM customer) AS left_values,
 (SELECT count(DISTINCT {c}) FROM orders) AS right_values, (SELECT count(*) FROM (SELECT {a} FROM customer INTERSECT SELECT {c} FROM orders)) AS shared"""
    for a, c in _WIDE))
def key_overlaps(spark, sf):
    frames = {"customer": table(spark, sf, "customer"), "orders": table(spark, sf, "orders")}
    pairs = [("customer", "orders", a, c) for a, c in _WIDE]
    shared = jn.shared_values(frames, pairs)
    rows = [(p[2], p[3], *counts) for p, counts in shared.items()]
    return spark.createDataFrame(
        rows, "left_col string, right_col string, left_values bigint, right_values bigint, shared bigint"
    )


@query("d3_value_overlap", "D3 D4 T2", """
WITH s AS (SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT user_id FROM events))::DOUBLE AS n,
 (SELECT count(DISTINCT c_custkey) FROM customer)::DOUBLE AS l, (SELECT count(DISTINCT user_id) FROM events)::DOUBLE AS r)
SELECT round(n / l, 6) AS referential_overlap, round(greatest(n / l, n / r), 6) AS value_overlap FROM s""")
def value_overlap(spark, sf):
    return jn.overlap(table(spark, sf, "customer"), table(spark, sf, "events"), "c_custkey", "user_id")


@query("d5_join_quality", "D5 D6 D7 T2", """
WITH l AS (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1),
j AS (SELECT count(*) AS mk, sum(l.n) AS ml, sum(r.n) AS mr, sum(l.n * r.n)::DOUBLE AS jr FROM l JOIN r ON l.k = r.k),
s AS (SELECT (SELECT count(*) FROM customer) AS left_rows, (SELECT count(*) FROM events) AS right_rows, (SELECT count(*) FROM l) AS left_keys,
 (SELECT count(*) FROM r) AS right_keys, mk AS matched_keys, ml::BIGINT AS matched_rows, mr::BIGINT AS mr, jr FROM j)
SELECT left_rows, right_rows, left_keys, right_keys, matched_keys, matched_rows, left_rows - matched_rows AS lost_left_rows,
 right_rows - mr AS lost_right_rows, round(matched_rows / left_rows::DOUBLE, 4) AS match_rate, round(jr / left_rows::DOUBLE, 4) AS expansion,
 jr / left_rows::DOUBLE > 1.1 AS duplicate_risk,
 concat_ws('; ', CASE WHEN 1 - matched_rows / left_rows::DOUBLE > 0.2 THEN (left_rows - matched_rows) || ' left rows have no match' END,
  CASE WHEN jr / left_rows::DOUBLE > 1.1 THEN 'M:N relationship, rows may be duplicated' END) AS warnings FROM s""")
def quality_of_join(spark, sf):
    return jn.join_quality(table(spark, sf, "customer"), table(spark, sf, "events"), "c_custkey", "user_id")


@query("d8_join_chain", "D8 C10 D12", """
SELECT o_orderkey AS deal_id, c_custkey AS account_id, c_name AS account_name, n_name AS nation_name, r_name AS region_name, o_totalprice AS deal_value,
 c_nationkey AS nation_id, n_regionkey AS region_id, o_orderpriority AS service_line
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def join_chain(spark, sf):
    chain = [
        jn.Candidate("deals", "accounts", "account_id", "account_id"),
        jn.Candidate("accounts", "nation", "nation_id", "nation_id"),
        jn.Candidate("nation", "region", "region_id", "region_id"),
    ]
    counts = {"deals": 4, "accounts": 3, "nation": 2, "region": 1}
    master = jn.build_chain(_crm(spark, sf), chain, row_counts=counts).master
    return master.select(
        "deal_id", "account_id", "account_name", "nation_name", "region_name", "deal_value",
        "nation_id", "region_id", "service_line",
    )


def _joined(how):
    def plan(spark, sf):
        # the unmatched sides are visible: unclassified deals on the left, idle accounts on the right
        left = b.deals_with_gaps(spark, sf).select("deal_id", "account_id", "deal_value")
        right = b.accounts(spark, sf).select("account_id", "account_name")
        return jn.equi_join(left, right, "account_id", "account_id", how, "accounts")

    return plan


for _how, _sql in (("left", "LEFT"), ("inner", "INNER"), ("outer", "FULL OUTER"), ("right", "RIGHT")):
    query(f"d9_{_how}_join", "D9", with_sql("accounts", "deals", "closed", "gaps") + f""", l AS (SELECT deal_id, account_id, deal_value FROM gaps),
r AS (SELECT account_id, account_name FROM accounts)
SELECT coalesce(l.account_id, r.account_id) AS account_id, deal_id, deal_value, account_name FROM l {_sql} JOIN r ON l.account_id = r.account_id""")(_joined(_how))


@query("d10_manual_join", "D10", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, n_name, n_regionkey, n_nationkey FROM supplier INNER JOIN nation ON s_nationkey = n_nationkey""")
def manual_join(spark, sf):
    tables = {"supplier": table(spark, sf, "supplier"), "nation": table(spark, sf, "nation")}
    chosen = jn.Candidate("supplier", "nation", "s_nationkey", "n_nationkey", join_type="inner")
    return jn.build_chain(tables, [chosen, chosen]).master


@query("d13_unknown_mentions", "D13", """
WITH notes AS (SELECT unnest(string_split('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ', SUPPLIER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ', Prospect ' || o_orderpriority, ',')) AS mention FROM orders),
known AS (SELECT lower(c_name) AS k FROM customer UNION SELECT lower(s_name) FROM supplier)
SELECT trim(mention) AS mention, count(*) AS mentions FROM notes WHERE lower(trim(mention)) NOT IN (SELECT k FROM known) GROUP BY 1""")
def unknown_mentions(spark, sf):
    padded = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    notes = table(spark, sf, "orders").select(
        F.concat(
            F.lit("Customer#"), padded, F.lit(", SUPPLIER#"), padded, F.lit(", Prospect "), F.col("o_orderpriority")
        ).alias("accounts")
    )
    known = table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(
        table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    )
    return jn.unknown_mentions(notes, "accounts", known, "name")


@query("d14_unseen_pages", "D14 X20", """
WITH h AS (SELECT page_id, url, substring(md5(url), 1, 16) AS url_hash FROM pages),
seen AS (SELECT url_hash FROM h WHERE url LIKE 'http://%')
SELECT url_hash, min(page_id) AS page_id FROM h WHERE url_hash NOT IN (SELECT url_hash FROM seen) GROUP BY 1""")
def unseen_pages(spark, sf):
    hashed = table(spark, sf, "pages").select(
        "page_id", "url", F.substring(F.md5("url"), 1, 16).alias("url_hash")
    )
    seen = hashed.filter(F.col("url").startswith("http://"))
    return jn.drop_seen(hashed, "url_hash", seen, "page_id").select("url_hash", "page_id")
