"""Type inference on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope.operators import semantic_types as st
from dealscope.plans import bindings as b
from dealscope.plans.bindings import table, with_sql
from dealscope.plans.registry import query

_TEXT = with_sql("deals", "closed", "gaps") + """, d AS (
SELECT CAST(deal_id AS VARCHAR) AS deal_id, '£' || format('{:,.2f}', CAST(deal_value AS DECIMAL(18,2))::DOUBLE) AS deal_value,
  (deal_id % 40) || '%' AS discount, strftime(created, '%d/%m/%Y') AS created, service_line,
  'user' || account_id || '@mail.test' AS contact_email, (account_id % 1000) || '.5' AS score, 'note for deal ' || deal_id AS remark FROM gaps)"""


@query("b1_inferred_casts", "B1 B2 B4 B6 B8 B9 B10 B11 X1 X3 X4", with_sql("deals", "closed", "gaps") + """
SELECT CAST(deal_id AS DOUBLE) AS deal_id, deal_value, CAST(deal_id % 40 AS DOUBLE) AS discount, strftime(created, '%Y-%m-%d') AS created,
 service_line, 'user' || account_id || '@mail.test' AS contact_email, (account_id % 1000) + 0.5::DOUBLE AS score, 'note for deal ' || deal_id AS remark FROM gaps""")
def inferred_casts(spark, sf):
    cast, _ = st.infer_and_cast(b.deals_as_text(spark, sf))
    return cast.withColumn("created", F.date_format("created", "yyyy-MM-dd"))


@query("b5_match_evidence", "B5 B7 B9 B11", _TEXT + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS non_null, count(*) FILTER (regexp_matches({c}, '[£$€¥₹]')) AS currency_symbol,
 count(*) FILTER (regexp_matches(trim({c}), '^[£$€¥₹\\s]?-?[\\d,]+\\.?\\d*$')) AS currency_match,
 count(*) FILTER (regexp_matches(trim({c}), '^-?[\\d,]+\\.?\\d*\\s*%$')) AS percentage_match,
 count(try_cast({c} AS DOUBLE)) AS numeric_cast, count(try_strptime({c}, '%d/%m/%Y')) AS day_first FROM d"""
    for c in ("deal_id", "deal_value", "discount", "created", "service_line", "contact_email", "score", "remark")))
def match_evidence(spark, sf):
    return st.evidence(b.deals_as_text(spark, sf)).select(
        "column", "non_null", "currency_symbol", "currency_match", "percentage_match", "numeric_cast",
        F.col("date1").alias("day_first"),
    )


_INFERRED = {
    "deal_id": "numeric", "deal_value": "currency", "discount": "percentage", "created": "date",
    "service_line": "categorical", "contact_email": "email", "score": "numeric", "remark": "text",
}


@query("b14_column_schema", "B12 B13 B14 B15", _TEXT + " " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", 'string' AS raw_dtype, '{t}' AS inferred_type, count(*) - count({c}) AS null_count,
 round((count(*) - count({c})) / count(*)::DOUBLE * 100, 2) AS null_pct, count(DISTINCT {c}) AS unique_count FROM d"""
    for c, t in _INFERRED.items()))
def column_schema(spark, sf):
    return st.detect_schema(b.deals_as_text(spark, sf))


_SAMPLED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("b14_first_values", "B14", "WITH o AS (SELECT *, row_number() OVER () AS rn FROM orders) " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", (SELECT string_agg(v, '|' ORDER BY rn) FROM (SELECT rn, {"strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')" if c == "o_orderdate" else c + "::VARCHAR"} AS v
 FROM o WHERE {c} IS NOT NULL ORDER BY rn LIMIT 3)) AS samples""" for c in _SAMPLED))
def first_values(spark, sf):
    found = st.first_values(table(spark, sf, "orders").select(*_SAMPLED))
    return found.select("column", F.array_join("samples", "|").alias("samples"))


@query("b15_currency_columns", "B15 B3", """
SELECT 'o_totalprice' AS "column", 'double' AS raw_dtype, 'currency' AS inferred_type, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct,
 count(DISTINCT o_totalprice) AS unique_count FROM orders""")
def currency_columns(spark, sf):
    return st.columns_of_type(st.detect_schema(table(spark, sf, "orders")), "currency")


def _id_case(column: str, source: str) -> str:
    return f"(SELECT CASE WHEN count(DISTINCT {column}) > 0.8 * count({column}) THEN 'identifier' ELSE 'numeric' END FROM {source})"


@query("b3_numeric_types", "B3 B12", with_sql("accounts", "deals") + f"""
SELECT 'deals' AS "table", 'deal_id' AS "column", {_id_case('deal_id', 'deals')} AS inferred_type
UNION ALL SELECT 'deals', 'account_id', {_id_case('account_id', 'deals')}
UNION ALL SELECT 'deals', 'deal_value', 'currency'
UNION ALL SELECT 'accounts', 'account_id', {_id_case('account_id', 'accounts')}
UNION ALL SELECT 'accounts', 'nation_id', {_id_case('nation_id', 'accounts')}
UNION ALL SELECT 'accounts', 'revenue', 'currency'
UNION ALL SELECT 'lineitem', 'l_discount', 'percentage' UNION ALL SELECT 'lineitem', 'l_tax', 'percentage'
UNION ALL SELECT 'lineitem', 'l_orderkey', 'numeric' UNION ALL SELECT 'lineitem', 'l_partkey', 'numeric'
UNION ALL SELECT 'lineitem', 'l_suppkey', 'numeric' UNION ALL SELECT 'lineitem', 'l_linenumber', 'numeric'
UNION ALL SELECT 'lineitem', 'l_extendedprice', 'currency' UNION ALL SELECT 'lineitem', 'l_quantity', 'numeric'""")
def numeric_types(spark, sf):
    frames = {
        "deals": b.deals(spark, sf).select("deal_id", "account_id", "deal_value"),
        "accounts": b.accounts(spark, sf).select("account_id", "nation_id", "revenue"),
        "lineitem": table(spark, sf, "lineitem").drop("l_returnflag", "l_linestatus", "l_shipdate"),
    }
    rows = [
        (name, t.column, t.semantic)
        for name, df in frames.items()
        for t in st.infer_types(df).values()
    ]
    return spark.createDataFrame(rows, "table string, column string, inferred_type string")
