"""Profiles, quality rules and reports on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope.operators import profiling as pf
from dealscope.operators import quality as ql
from dealscope.plans import bindings as b
from dealscope.plans.bindings import table, with_sql
from dealscope.plans.registry import query

# column, Spark type, kind (n number, d date, s text), semantic (None: by distinct count)
TABLES = {
    "region": [("r_regionkey", "int", "n", "numeric"), ("r_name", "string", "s", None)],
    "nation": [
        ("n_nationkey", "int", "n", "numeric"), ("n_name", "string", "s", None),
        ("n_regionkey", "int", "n", "numeric"),
    ],
    "accounts": [
        ("account_id", "bigint", "n", "identifier"), ("account_name", "string", "s", None),
        ("industry", "string", "s", None), ("revenue", "double", "n", "currency"),
        ("nation_id", "int", "n", "identifier"),
    ],
    "supplier": [
        ("s_suppkey", "bigint", "n", "numeric"), ("s_name", "string", "s", None),
        ("s_nationkey", "int", "n", "numeric"), ("s_acctbal", "double", "n", "numeric"),
    ],
    "part": [
        ("p_partkey", "bigint", "n", "numeric"), ("p_name", "string", "s", None),
        ("p_brand", "string", "s", None), ("p_type", "string", "s", None),
        ("p_size", "int", "n", "numeric"), ("p_retailprice", "double", "n", "currency"),
    ],
    "orders": [
        ("o_orderkey", "bigint", "n", "numeric"), ("o_custkey", "bigint", "n", "numeric"),
        ("o_orderstatus", "string", "s", None), ("o_totalprice", "double", "n", "currency"),
        ("o_orderdate", "timestamp_ntz", "d", "date"), ("o_orderpriority", "string", "s", None),
    ],
    "lineitem": [
        ("l_orderkey", "bigint", "n", "numeric"), ("l_partkey", "bigint", "n", "numeric"),
        ("l_suppkey", "bigint", "n", "numeric"), ("l_linenumber", "int", "n", "numeric"),
        ("l_quantity", "double", "n", "numeric"), ("l_extendedprice", "double", "n", "currency"),
        ("l_discount", "double", "n", "numeric"), ("l_tax", "double", "n", "numeric"),
        ("l_returnflag", "string", "s", None), ("l_linestatus", "string", "s", None),
        ("l_shipdate", "timestamp_ntz", "d", "date"),
    ],
    "events": [
        ("event_id", "bigint", "n", "identifier"), ("ts", "timestamp_ntz", "d", "date"),
        ("user_id", "bigint", "n", "identifier"), ("event_type", "string", "s", None),
        ("value", "double", "n", "currency"), ("props", "string", "s", None),
    ],
    "gaps": [
        ("deal_id", "bigint", "n", "identifier"), ("account_id", "bigint", "n", "identifier"),
        ("service_line", "string", "s", None), ("stage", "string", "s", None),
        ("deal_value", "double", "n", "currency"), ("created", "timestamp_ntz", "d", "date"),
        ("close_date", "timestamp_ntz", "d", "date"), ("lost_reason", "string", "s", None),
    ],
    "outcomes": [
        ("stage", "string", "s", None), ("service_line", "string", "s", None),
        ("deal_value", "double", "n", "currency"), ("lost_reason", "string", "s", None),
    ],
}
AS_OF = "2001-06-30"
_BASE = with_sql("accounts", "deals", "closed") + """,
gaps AS (SELECT deal_id, account_id, nullif(service_line, '4-NOT SPECIFIED') AS service_line, stage,
         CASE WHEN deal_value >= 200000 THEN deal_value END AS deal_value, created, close_date, CAST(NULL AS VARCHAR) AS lost_reason FROM closed),
outcomes AS (SELECT stage, service_line, round(deal_value, -5) AS deal_value, lost_reason FROM gaps)"""


def _gaps(spark, sf):
    """Deals with one null-heavy and one empty column, so that every rule can fire."""
    value = F.when(F.col("deal_value") >= 200000, F.col("deal_value"))
    return (
        b.deals_with_gaps(spark, sf)
        .select(
            "deal_id", "account_id", "service_line", "stage", value.alias("deal_value"),
            "created", "close_date",
        )
        .withColumn("lost_reason", F.lit(None).cast("string"))
    )


def _outcomes(spark, sf):
    """Coarse deal outcomes: many equal rows and mostly missing values."""
    return _gaps(spark, sf).select(
        "stage", "service_line", F.round("deal_value", -5).alias("deal_value"), "lost_reason"
    )


def _tables(spark, sf, names=tuple(TABLES)):
    special = {"accounts": b.accounts, "gaps": _gaps, "outcomes": _outcomes}
    return {
        n: special[n](spark, sf) if n in special else table(spark, sf, n) for n in names
    }


def _column_sql(name: str) -> str:
    parts = []
    for c, dtype, kind, semantic in TABLES[name]:
        guess = f"'{semantic}'" if semantic else f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'text' END"
        num = (
            f"round(min({c})::DOUBLE, 4) AS min_num, round(max({c})::DOUBLE, 4) AS max_num, round(avg({c}), 4) AS mean, "
            f"round(coalesce(stddev_samp({c}), 0), 4) AS std, round(median({c})::DOUBLE, 4) AS median, "
            f"count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count"
            if kind == "n"
            else "NULL::DOUBLE AS min_num, NULL::DOUBLE AS max_num, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, "
            "NULL::DOUBLE AS median, 0::BIGINT AS zero_count, 0::BIGINT AS negative_count"
        )
        day = (
            f"min({c})::DATE::VARCHAR AS min_date, max({c})::DATE::VARCHAR AS max_date, "
            f"count(*) FILTER ({c} > TIMESTAMP '{AS_OF} 00:00:00') AS future_count"
            if kind == "d"
            else "NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date, 0::BIGINT AS future_count"
        )
        parts.append(
            f"""SELECT '{name}' AS "table", '{c}' AS "column", '{dtype}' AS dtype, {guess} AS semantic,
            count(*) AS row_count, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) / count(*)::DOUBLE * 100, 2) AS null_pct,
            count(DISTINCT {c}) AS distinct_count, {num}, {day} FROM {name}"""
        )
    return " UNION ALL ".join(parts)


def _table_sql(name: str) -> str:
    cols = [c for c, *_ in TABLES[name]]
    nulls = " + ".join(f"count(*) - count({c})" for c in cols)
    empty = ", ".join(f"CASE WHEN count({c}) = 0 THEN '{c}' END" for c in sorted(cols))
    return f"""SELECT '{name}' AS "table", count(*) AS row_count, {len(cols)}::BIGINT AS col_count,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows,
        round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name}))) / count(*)::DOUBLE * 100, 2) AS duplicate_pct,
        round(({nulls}) / (count(*) * {len(cols)})::DOUBLE * 100, 2) AS overall_null_pct,
        concat_ws(',', {empty}) AS empty_columns FROM {name}"""


_COLUMNS = "p AS (" + " UNION ALL ".join(_column_sql(t) for t in TABLES) + ")"
_TABLES = "t AS (" + " UNION ALL ".join(_table_sql(t) for t in TABLES) + ")"
_ISSUES = """i AS (
 SELECT 'error' AS severity, "table", "column", 'FULLY_EMPTY' AS rule, 'Column ''' || "column" || ''' is completely empty (100% null)' AS description,
        row_count AS affected_rows, null_pct AS affected_pct FROM p WHERE null_pct = 100
 UNION ALL SELECT 'warning', "table", "column", 'HIGH_NULLS', 'Column ''' || "column" || ''' is ' || null_pct::DECIMAL(7,2)::VARCHAR || '% null (threshold: 30%)',
        null_count, null_pct FROM p WHERE null_pct > 30 AND null_pct <> 100
 UNION ALL SELECT 'warning', "table", "column", 'ZERO_REVENUE', 'Column ''' || "column" || ''' has ' || zero_count || ' zero values ('
        || round(zero_count / row_count::DOUBLE * 100, 2)::DECIMAL(7,2)::VARCHAR || '%)', zero_count, round(zero_count / row_count::DOUBLE * 100, 2)
        FROM p WHERE semantic = 'currency' AND zero_count > 0
 UNION ALL SELECT 'warning', "table", "column", 'NEGATIVE_REVENUE', 'Column ''' || "column" || ''' has ' || negative_count || ' negative values ('
        || round(negative_count / row_count::DOUBLE * 100, 2)::DECIMAL(7,2)::VARCHAR || '%)', negative_count, round(negative_count / row_count::DOUBLE * 100, 2)
        FROM p WHERE semantic = 'currency' AND negative_count > 0
 UNION ALL SELECT 'warning', "table", "column", 'FUTURE_DATES', 'Column ''' || "column" || ''' has ' || future_count || ' dates beyond today ('
        || round(future_count / row_count::DOUBLE * 100, 2)::DECIMAL(7,2)::VARCHAR || '%)', future_count, round(future_count / row_count::DOUBLE * 100, 2)
        FROM p WHERE future_count > 0
 UNION ALL SELECT CASE WHEN duplicate_pct >= 5 THEN 'error' ELSE 'warning' END, "table", NULL, 'DUPLICATE_ROWS',
        duplicate_rows || ' duplicate rows found (' || duplicate_pct::DECIMAL(7,2)::VARCHAR || '%)', duplicate_rows, duplicate_pct FROM t WHERE duplicate_rows > 0
 UNION ALL SELECT 'warning', "table", NULL, 'HIGH_OVERALL_NULL', 'Table-wide null rate is ' || overall_null_pct::DECIMAL(7,2)::VARCHAR || '%', 0, overall_null_pct
        FROM t WHERE overall_null_pct > 30),
r AS (SELECT *, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END::BIGINT AS severity_rank FROM i)"""
_ALL = f"{_BASE}, {_COLUMNS}, {_TABLES}, {_ISSUES}"


def _issues(spark, sf):
    facts = pf.all_quality_facts(_tables(spark, sf), AS_OF)
    return ql.all_issues(facts), pf.table_rows(facts)


@query("e1_profile_orders", "E1 E3 E4 E5 E6 B16", _BASE + " " + _column_sql("orders"))
def profile_orders(spark, sf):
    return pf.profile_columns(table(spark, sf, "orders"), "orders", AS_OF)


@query("e1_profile_lineitem", "E1 E3 E4 E5 E6 B16", _BASE + " " + _column_sql("lineitem"))
def profile_lineitem(spark, sf):
    return pf.profile_columns(table(spark, sf, "lineitem"), "lineitem", AS_OF)


@query("e2_profile_all_tables", "E2 E3 E4 E5 E6", f"{_BASE}, {_COLUMNS} SELECT * FROM p")
def profile_all_tables(spark, sf):
    return pf.profile_all(_tables(spark, sf), AS_OF)


@query("e7_top_values", "E7", _BASE + " " + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT 'gaps' AS "table", '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
        {c} AS value, count(*) AS value_count FROM gaps WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5"""
    for c in ("service_line", "stage")) + """ UNION ALL SELECT * FROM (SELECT 'events' AS "table", 'props' AS "column",
        row_number() OVER (ORDER BY count(*) DESC, props) AS rank, props AS value, count(*) AS value_count FROM events GROUP BY props) WHERE rank <= 5
    UNION ALL SELECT * FROM (SELECT 'events' AS "table", 'event_type' AS "column",
        row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank, event_type, count(*) AS value_count FROM events GROUP BY event_type) WHERE rank <= 5""")
def top_values(spark, sf):
    frames = _tables(spark, sf, ("gaps", "events"))
    return pf.top_values(frames["gaps"], "gaps").unionByName(pf.top_values(frames["events"], "events"))


@query("e8_duplicate_rows", "E8", """
WITH twice AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')
SELECT 'lines' AS name, count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS duplicate_rows FROM twice
UNION ALL SELECT 'parts', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) FROM part""")
def duplicate_rows(spark, sf):
    lines, parts = table(spark, sf, "lineitem"), table(spark, sf, "part")
    lines = lines.unionByName(lines.filter(F.col("l_returnflag") == "R"))  # returned lines entered again
    return pf.duplicate_rows(lines).withColumn("name", F.lit("lines")).unionByName(
        pf.duplicate_rows(parts).withColumn("name", F.lit("parts"))
    )


@query("e9_table_profiles", "E8 E9 E29", f"{_BASE}, {_TABLES} SELECT * FROM t")
def table_profiles(spark, sf):
    return pf.profile_tables(_tables(spark, sf))


@query("e10_column_issues", "E10 E11 E12", _ALL + ' SELECT severity, "table", "column", rule, description, affected_rows, affected_pct FROM i WHERE "column" IS NOT NULL')
def column_issues(spark, sf):
    return ql.column_issues(pf.all_quality_facts(_tables(spark, sf), AS_OF))


@query("e13_table_issues", "E13", _ALL + ' SELECT severity, "table", "column", rule, description, affected_rows, affected_pct FROM i WHERE "column" IS NULL')
def table_issues(spark, sf):
    return ql.table_issues(pf.profile_tables(_tables(spark, sf)))


@query("e14_all_issues", "E14", _ALL + " SELECT * FROM r")
def all_issues(spark, sf):
    return _issues(spark, sf)[0]


@query("e14_issue_counts", "E14", _ALL + " SELECT severity, count(*) AS issues FROM r GROUP BY 1")
def issue_counts(spark, sf):
    return ql.issue_counts(_issues(spark, sf)[0])


@query("e15_report_totals", "E15", _ALL + """ SELECT (SELECT count(*) FROM t) AS total_tables, (SELECT sum(row_count)::BIGINT FROM t) AS total_rows,
 (SELECT count(*) FROM r) AS total_issues, (SELECT count(*) FROM r WHERE severity = 'error') AS errors,
 (SELECT count(*) FROM r WHERE severity = 'warning') AS warnings, (SELECT count(*) FROM r WHERE severity = 'info') AS infos""")
def report_totals(spark, sf):
    issues, tables = _issues(spark, sf)
    return ql.report_totals(tables, issues)


@query("e15_nested_report", "E15", _ALL + """ SELECT t."table", row_count, duplicate_rows, overall_null_pct, severity, "column", rule, affected_rows, affected_pct
 FROM t LEFT JOIN r ON r."table" = t."table\"""")
def nested_report(spark, sf):
    """The JSON documents, read back as rows."""
    issues, tables = _issues(spark, sf)
    issue = "severity string, column string, rule string, affected_rows bigint, affected_pct double"
    document = f"row_count bigint, duplicate_rows bigint, overall_null_pct double, issues array<struct<{issue.replace(' ', ':').replace(',:', ',')}>>"
    read = ql.nested_report(tables, issues).select("table", F.from_json("report", document).alias("d"))
    return read.select("table", "d.row_count", "d.duplicate_rows", "d.overall_null_pct", F.explode_outer("d.issues").alias("i")).select(
        "table", "row_count", "duplicate_rows", "overall_null_pct", "i.*"
    )


_SUMMARY = """, c AS (SELECT "table", count(*) AS issues, count(*) FILTER (severity = 'error') AS errors FROM r GROUP BY 1),
s AS (SELECT t."table", row_count, col_count, overall_null_pct, duplicate_rows, coalesce(issues, 0) AS issues,
      CASE WHEN coalesce(errors, 0) > 0 OR overall_null_pct >= 30 THEN 'red' WHEN overall_null_pct >= 10 THEN 'amber' ELSE 'green' END AS light
      FROM t LEFT JOIN c ON t."table" = c."table")"""


@query("e16_quality_summary", "E16 E17", _ALL + _SUMMARY + " SELECT * FROM s")
def quality_summary(spark, sf):
    issues, tables = _issues(spark, sf)
    return ql.summary(tables, issues)


@query("e30_catalog", "E30", _ALL + _SUMMARY + """ SELECT "table", row_count, "table" IN ('accounts', 'orders') AS joined, light FROM s""")
def catalog(spark, sf):
    issues, tables = _issues(spark, sf)
    return ql.catalog(ql.summary(tables, issues), ["accounts", "orders"])


@query("e29_flagged_columns", "E29", _ALL + """ SELECT "table", string_agg("column", ',' ORDER BY "column") AS columns
 FROM (SELECT DISTINCT "table", "column" FROM r WHERE "column" IS NOT NULL) GROUP BY 1""")
def flagged_columns(spark, sf):
    return ql.flagged_columns(_issues(spark, sf)[0])


@query("e18_schema_table", "E18", _BASE + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null, round((count(*) - count({c})) / count(*)::DOUBLE * 100, 1) AS null_pct,
    count(DISTINCT {c}) AS distinct_count FROM gaps""" for c, t, *_ in TABLES["gaps"]))
def schema_table(spark, sf):
    return pf.schema_table(_gaps(spark, sf), "gaps")


@query("e19_column_statistics", "E19", """SELECT 'l_extendedprice' AS "column", count(*) AS row_count, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_pct,
 count(DISTINCT l_extendedprice) AS distinct_count, round(min(l_extendedprice), 4) AS min_num, round(max(l_extendedprice), 4) AS max_num,
 round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(median(l_extendedprice), 4) AS median,
 count(*) FILTER (l_extendedprice = 0) AS zero_count, count(*) FILTER (l_extendedprice < 0) AS negative_count,
 NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date, 0::BIGINT AS future_count FROM lineitem""")
def column_statistics(spark, sf):
    return pf.column_statistics(table(spark, sf, "lineitem"), "l_extendedprice", AS_OF)


@query("c7_sample_values", "C7", " UNION ALL ".join(
    f"""SELECT 'orders' AS "table", '{c}' AS "column", (SELECT array_to_string(list(x), '|') FROM
    (SELECT DISTINCT {c} AS x FROM orders ORDER BY x LIMIT 10)) AS samples, (SELECT count(DISTINCT {c}) FROM orders) AS distinct_count"""
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    + """ UNION ALL SELECT 'orders', 'o_orderdate', (SELECT array_to_string(list(strftime(x, '%Y-%m-%d %H:%M:%S')), '|') FROM
    (SELECT DISTINCT o_orderdate AS x FROM orders ORDER BY x LIMIT 10)), (SELECT count(DISTINCT o_orderdate) FROM orders)""")
def sample_values(spark, sf):
    return pf.sample_values(table(spark, sf, "orders"), "orders")


_NULLS = "n AS (" + " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{dtype}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count,
    round((count(*) - count({c})) / count(*)::DOUBLE * 100, 2) AS null_pct FROM {t}""" for t in TABLES for c, dtype, *_ in TABLES[t]) + ")"


@query("s8_null_rates", "S8 Q18 E3", f"{_BASE}, {_NULLS} SELECT * FROM n")
def null_rates(spark, sf):
    return pf.all_null_rates(_tables(spark, sf)).orderBy(F.col("null_pct").desc(), "table", "column")


@query("q18_highest_null_rates", "Q18 S8", f"""{_BASE}, {_NULLS} SELECT "table", "column", null_pct FROM n ORDER BY null_pct DESC, "table", "column" LIMIT 10""")
def highest_null_rates(spark, sf):
    rates = pf.all_null_rates(_tables(spark, sf)).select("table", "column", "null_pct")
    return rates.orderBy(F.col("null_pct").desc(), "table", "column").limit(10)


@query("q13_quality_scores", "Q13", f"""{_BASE}, {_TABLES} SELECT "table", overall_null_pct, duplicate_pct,
 round(greatest(0, 100 - overall_null_pct - duplicate_pct), 2) AS score FROM t""")
def quality_scores(spark, sf):
    return ql.quality_score(pf.profile_tables(_tables(spark, sf)))


_ACTIONS = """, a AS (SELECT row_number() OVER (ORDER BY severity_rank, affected_pct DESC, "table", "column" NULLS FIRST, rule) AS priority,
 severity, "table", "column", rule, affected_rows, affected_pct FROM r)"""


@query("q22_action_list", "Q22 E14", _ALL + _ACTIONS + " SELECT * FROM a")
def action_list(spark, sf):
    return ql.action_list(_issues(spark, sf)[0])


@query("q23_fix_list", "Q23", _ALL + _ACTIONS + """ SELECT priority, lower(replace(rule, '_', ' ')) || ' in ' || "table" AS fix,
 "table", "column", NULL::VARCHAR AS owner FROM a""")
def fix_list(spark, sf):
    return ql.fix_list(ql.action_list(_issues(spark, sf)[0]))


@query("a14_quality_report_lines", "A14", _ALL + """, l AS (
 SELECT "table", 1 AS seq, 'TABLE: ' || "table" AS line FROM t UNION ALL SELECT "table", 2, '  Rows          : ' || row_count FROM t
 UNION ALL SELECT "table", 3, '  Columns       : ' || col_count FROM t
 UNION ALL SELECT "table", 4, '  Duplicate rows: ' || duplicate_rows || ' (' || duplicate_pct::DECIMAL(7,2)::VARCHAR || '%)' FROM t
 UNION ALL SELECT "table", 5, '  Overall nulls : ' || overall_null_pct::DECIMAL(7,2)::VARCHAR || '%' FROM t
 UNION ALL SELECT "table", 6, '  Fully empty   : ' || CASE WHEN empty_columns = '' THEN 'none' ELSE empty_columns END FROM t
 UNION ALL SELECT "table", 6 + row_number() OVER (PARTITION BY "table" ORDER BY severity_rank, "column" NULLS FIRST, rule),
   '    [' || upper(severity) || '] ' || coalesce("column", 'table') || ' ' || rule || ' — ' || description FROM r)
 SELECT "table", CAST(seq AS INT) AS seq, line FROM l""")
def quality_report_lines(spark, sf):
    issues, tables = _issues(spark, sf)
    return ql.report_lines(tables, issues)


