"""Bind the test tables to the business entities the operators work on.

``SQL`` holds the same bindings as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF = "2024-02-01"
ORDERS_AS_OF = "2001-12-31"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.col("c_mktsegment").alias("industry"),
        F.col("c_acctbal").alias("revenue"),
        F.col("c_nationkey").alias("nation_id"),
    )


def deals(spark: SparkSession, sf: str) -> DataFrame:
    stage = (
        F.when(F.col("o_orderstatus") == "F", "Closed Won")
        .when(F.col("o_orderstatus") == "O", "Open")
        .otherwise("Proposal")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("deal_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderpriority").alias("service_line"),
        stage.alias("stage"),
        F.col("o_totalprice").alias("deal_value"),
        F.col("o_orderdate").alias("created"),
    )


def deals_with_close(spark: SparkSession, sf: str) -> DataFrame:
    """Deals with the last ship date as close date; null when nothing shipped."""
    shipped = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("deal_id"))
        .agg(F.max("l_shipdate").alias("close_date"))
    )
    return deals(spark, sf).join(shipped, "deal_id", "left")


def deals_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Deals with missing fields: unclassified lines, small values unrecorded."""
    return (
        deals_with_close(spark, sf)
        .withColumn(
            "service_line",
            F.when(F.col("service_line") != "4-NOT SPECIFIED", F.col("service_line")),
        )
        .withColumn("deal_value", F.when(F.col("deal_value") >= 20000, F.col("deal_value")))
    )


def deals_as_text(spark: SparkSession, sf: str) -> DataFrame:
    """Deals as they would come from a spreadsheet: every column is text."""
    day = F.date_format("created", "dd/MM/yyyy")
    return deals_with_gaps(spark, sf).select(
        F.col("deal_id").cast("string").alias("deal_id"),
        F.concat(F.lit("£"), F.format_number(F.col("deal_value").cast("decimal(18,2)"), 2)).alias("deal_value"),
        F.concat(F.pmod("deal_id", F.lit(40)).cast("string"), F.lit("%")).alias("discount"),
        day.alias("created"),
        F.col("service_line"),
        F.format_string("user%d@mail.test", "account_id").alias("contact_email"),
        F.format_string("%d.5", F.pmod("account_id", F.lit(1000))).alias("score"),
        F.concat(F.lit("note for deal "), F.col("deal_id").cast("string")).alias("remark"),
    )


def activities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("account_id"), "ts", F.col("event_type").alias("kind"), "value"
    )


PHRASES = (
    "What is the win rate by service line?",
    "Show total pipeline coverage by stage.",
    "Which accounts are dormant or at risk?",
    "Compare the average deal size versus last year.",
    "What if we raise prices, what would change?",
    "Is revenue concentration typical for the sector?",
    "List missing close dates and duplicate accounts.",
    "What should we focus on in the sales cycle?",
)


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as questions: a stock phrase by turn, then the turn's own text."""
    phrase = F.array(*[F.lit(p) for p in PHRASES])
    turn = F.pmod("turn", F.lit(len(PHRASES))).cast("int")
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") == "user")
        .select(
            "conv_id",
            "turn",
            F.get(phrase, turn).alias("phrase"),
            F.concat_ws(" ", F.get(phrase, turn), F.col("text")).alias("question"),
            "text",
        )
    )


def iteration_log(spark: SparkSession, sf: str) -> DataFrame:
    """Answer iterations: one row per conversation turn with a review score."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.col("turn").alias("iteration"),
        F.pmod(F.length("text") * 7, F.lit(101)).cast("bigint").alias("score"),
        "role",
        "text",
    )


def training_log(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewed answers: documents joined with their labels."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    recommendation = F.when(
        F.col("toxic") == 1,
        F.to_json(
            F.struct(
                F.concat(F.lit("Review "), F.col("source")).alias("priority_action"),
                F.concat(F.lit("Language "), F.col("lang")).alias("risk_flag"),
                F.lit("").alias("opportunity"),
            )
        ),
    ).otherwise(F.when(F.col("lang") == "de", F.lit("{not json")))
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.col("source").alias("question"),
        F.col("text").alias("interpretation"),
        F.col("lang").alias("intent_type"),
        (F.col("quality") == 1).alias("is_final"),
        F.pmod("n_chars", F.lit(101)).cast("bigint").alias("critic_score"),
        recommendation.alias("recommendation"),
    )


def _phrase_case(turn: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
    return f"CASE {turn} % {len(PHRASES)} {cases} END"


SQL = {
    "accounts": """accounts AS (
        SELECT c_custkey AS account_id, c_name AS account_name, c_mktsegment AS industry,
               c_acctbal AS revenue, c_nationkey AS nation_id FROM customer)""",
    "deals": """deals AS (
        SELECT o_orderkey AS deal_id, o_custkey AS account_id, o_orderpriority AS service_line,
               CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'Open' ELSE 'Proposal' END AS stage,
               o_totalprice AS deal_value, o_orderdate AS created FROM orders)""",
    "closed": """closed AS (
        SELECT d.*, s.close_date FROM deals d LEFT JOIN (
            SELECT l_orderkey, max(l_shipdate) AS close_date FROM lineitem GROUP BY l_orderkey) s
        ON d.deal_id = s.l_orderkey)""",
    "gaps": """gaps AS (
        SELECT deal_id, account_id, nullif(service_line, '4-NOT SPECIFIED') AS service_line, stage,
               CASE WHEN deal_value >= 20000 THEN deal_value END AS deal_value, created, close_date
        FROM closed)""",
    "activities": """activities AS (
        SELECT user_id AS account_id, ts, event_type AS kind, value FROM events)""",
    "questions": f"""questions AS (
        SELECT conv_id, turn, {_phrase_case('turn')} AS phrase,
               {_phrase_case('turn')} || ' ' || text AS question, text
        FROM conversations WHERE role = 'user')""",
    "iterations": """iterations AS (
        SELECT conv_id AS query_id, turn AS iteration, (length(text) * 7) % 101 AS score, role, text
        FROM conversations)""",
    "training": """training AS (
        SELECT d.doc_id, d.source AS question, d.text AS interpretation, d.lang AS intent_type,
               l.quality = 1 AS is_final, d.n_chars % 101 AS critic_score,
               CASE WHEN l.toxic = 1 THEN 'Review ' || d.source END AS rec_action,
               CASE WHEN l.toxic = 1 THEN 'Language ' || d.lang END AS rec_risk
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
}


def with_sql(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named bindings."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
