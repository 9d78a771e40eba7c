"""Result shaping and answer-log queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions import text as tx
from dealscope.functions.numbers import money_sum_double
from dealscope.operators import logs as lg
from dealscope.operators import shaping as sh
from dealscope.plans import bindings as b
from dealscope.plans.bindings import table, with_sql
from dealscope.plans.registry import query


def answers(spark, sf):
    """Assistant turns as answers with a recommendation text in one of its two forms."""
    action = F.format_string("Call account %d", "conv_id")
    risk = F.format_string("Turn %d is late", "turn")
    chance = F.when(F.pmod("turn", F.lit(3)) == 0, "").otherwise("Offer more")
    signed = F.concat(
        F.lit("🎯 PRIORITY ACTION: "), action, F.lit("\n⚠️ RISK FLAG: "), risk, F.lit("\n💡 OPPORTUNITY: "), chance
    )
    plain = F.concat(
        F.lit("PRIORITY ACTION: "), action, F.lit("\nRISK FLAG: "), risk, F.lit("\nOPPORTUNITY: "), chance
    )
    section = (F.pmod("turn", F.lit(6)) + 1).cast("bigint")
    return (
        table(spark, sf, "conversations")
        .filter(F.col("role") == "assistant")
        .select(
            "conv_id",
            "turn",
            section.alias("section"),
            (section * 8 + F.col("turn")).alias("position"),
            F.col("text").alias("question"),
            F.when(F.pmod("turn", F.lit(2)) == 1, signed).otherwise(plain).alias("recommendation"),
        )
        .withColumn("rec", tx.recommendation_sections(F.col("recommendation")))
    )


_ANSWERS = """answers AS (SELECT conv_id, turn, turn % 6 + 1 AS section, (turn % 6 + 1) * 8 + turn AS position, text AS question,
 'Call account ' || conv_id AS priority_action, 'Turn ' || turn || ' is late' AS risk_flag, CASE WHEN turn % 3 = 0 THEN '' ELSE 'Offer more' END AS opportunity
 FROM conversations WHERE role = 'assistant')"""


@query("x13_recommendation_sections", "X13", f"WITH {_ANSWERS} SELECT conv_id, turn, priority_action, risk_flag, opportunity FROM answers")
def recommendation_sections(spark, sf):
    return answers(spark, sf).select("conv_id", "turn", "rec.*")


@query("x14_recommendation_json", "X14", with_sql("training") + """
SELECT doc_id, coalesce(rec_action, '') AS priority_action, coalesce(rec_risk, '') AS risk_flag, '' AS opportunity FROM training""")
def recommendation_json(spark, sf):
    log = b.training_log(spark, sf)
    return log.select("doc_id", tx.recommendation_json(F.col("recommendation")).alias("r")).select("doc_id", "r.*")


def _reviews(spark, sf):
    """Review JSON of each iteration: complete, without a score, or unreadable."""
    good = F.to_json(
        F.struct(
            F.col("score").alias("total_score"),
            F.create_map(F.lit("code_correctness"), F.col("score")).alias("dimension_scores"),
            F.col("role").alias("specific_feedback"),
        )
    )
    text = (
        F.when(F.col("role") == "assistant", good)
        .when(F.col("role") == "user", F.lit('{"highest_priority_fix": "chart"}'))
        .otherwise("not json at all")
    )
    return b.iteration_log(spark, sf).withColumn("review", text)


@query("x15_review_json", "X15", with_sql("iterations") + """
SELECT query_id, iteration, CAST(CASE role WHEN 'assistant' THEN score ELSE 50 END AS INT) AS total_score,
 CASE role WHEN 'assistant' THEN 'assistant' WHEN 'user' THEN '' ELSE 'Could not parse critic response' END AS specific_feedback,
 CASE role WHEN 'user' THEN 'chart' ELSE 'code' END AS highest_priority_fix, CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS dimensions FROM iterations""")
def review_json(spark, sf):
    parsed = _reviews(spark, sf).withColumn("r", tx.review_json(F.col("review")))
    return parsed.select(
        "query_id", "iteration", "r.total_score", "r.specific_feedback", "r.highest_priority_fix",
        F.size("r.dimension_scores").alias("dimensions"),
    )


@query("x17_code_blocks", "X17", """
SELECT conv_id, turn, 'x = "' || text || '"' || CASE role WHEN 'system' THEN chr(10) || 'import os; eval(x)' ELSE '' END AS code,
 CASE role WHEN 'system' THEN 'import os,eval(' ELSE '' END AS unsafe FROM conversations""")
def code_blocks(spark, sf):
    code = F.concat(
        F.lit('x = "'), F.col("text"), F.lit('"'),
        F.when(F.col("role") == "system", "\nimport os; eval(x)").otherwise(""),
    )
    fenced = F.concat(F.lit("Here is the code:\n```python\n"), code, F.lit("\n```\n"), F.col("text"))
    reply = F.when(F.col("role") == "user", code).otherwise(fenced)
    found = table(spark, sf, "conversations").select("conv_id", "turn", tx.code_block(reply).alias("code"))
    return found.withColumn("unsafe", F.array_join(tx.unsafe_patterns(F.col("code")), ","))


@query("w6_best_iterations", "W6", with_sql("iterations") + """, r AS (SELECT query_id, iteration, score,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, iteration) AS rn FROM iterations) SELECT query_id, iteration, score FROM r WHERE rn = 1""")
def best_iterations(spark, sf):
    return lg.best_iterations(b.iteration_log(spark, sf).select("query_id", "iteration", "score"))


@query("w7_final_iterations", "W7", with_sql("iterations") + """, e AS (SELECT query_id,
 min(iteration) FILTER (score >= 85) AS hit, max(iteration) FILTER (iteration <= 5) AS last FROM iterations GROUP BY 1)
SELECT i.query_id, iteration, score, iteration = least(coalesce(hit, last), last) AS is_final FROM iterations i JOIN e ON i.query_id = e.query_id""")
def final_iterations(spark, sf):
    return lg.final_flags(b.iteration_log(spark, sf).select("query_id", "iteration", "score"))


def _coded(spark, sf):
    return b.iteration_log(spark, sf).select(
        "query_id", "iteration", "score", F.col("role").alias("question_type"),
        F.regexp_extract("text", r"^(\S+)", 1).alias("code"),
    )


_CODED = with_sql("iterations") + r""", c AS (SELECT query_id, iteration, score, role AS question_type, regexp_extract(text, '^(\S+)', 1) AS code FROM iterations)"""


@query("m10_stored_patterns", "M10", _CODED + """, r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY query_id, iteration) AS rn FROM c WHERE score >= 90)
SELECT query_id, iteration, score, question_type, code FROM r WHERE rn = 1""")
def stored_patterns(spark, sf):
    return lg.store_patterns(_coded(spark, sf), ["query_id", "iteration"])


_UPSERT = _CODED + """, u AS (SELECT question_type, count(*) AS use_count, max(score) AS score, arg_min(code, query_id * 1000 + iteration) AS code_pattern FROM c GROUP BY 1)"""


@query("m11_pattern_upsert", "M11", _UPSERT + " SELECT * FROM u")
def pattern_upsert(spark, sf):
    return lg.upsert_patterns(_coded(spark, sf), ["query_id", "iteration"])


@query("s6_patterns_by_score", "S6 C8", _UPSERT + " SELECT * FROM u WHERE question_type ILIKE '%S%T%' OR question_type ILIKE '%ss%'")
def patterns_by_score(spark, sf):
    return lg.patterns(lg.upsert_patterns(_coded(spark, sf), ["query_id", "iteration"]), "SS").unionByName(
        lg.patterns(lg.upsert_patterns(_coded(spark, sf), ["query_id", "iteration"]), "ystem")
    )


@query("s5_recent_rows", "S5", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_rows(spark, sf):
    return lg.recent(table(spark, sf, "events"), "ts", "event_id", 20).select("event_id", "event_type", "value")


@query("c9_training_records", "C9", with_sql("training") + """
SELECT doc_id, critic_score, 75 AS min_score FROM training WHERE is_final AND critic_score >= 75
UNION ALL SELECT doc_id, critic_score, 80 FROM training WHERE is_final AND critic_score >= 80""")
def training_records(spark, sf):
    log = b.training_log(spark, sf).select("doc_id", "critic_score", "is_final")
    parts = [
        lg.good_records(log, m).select("doc_id", "critic_score", F.lit(m).alias("min_score"))
        for m in (fv.TRAINING_SCORE, fv.FINE_TUNE_SCORE)
    ]
    return parts[0].unionByName(parts[1])


_PAIRS = with_sql("training") + r""", p AS (SELECT doc_id, question AS instruction, 'Intent: ' || intent_type AS context,
 CASE WHEN rec_action IS NOT NULL THEN regexp_replace(interpretation || chr(10) || chr(10) || 'RECOMMENDATION:' || chr(10) || 'Priority Action: ' || rec_action || chr(10)
   || 'Risk Flag: ' || rec_risk || chr(10) || 'Opportunity: ', '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') ELSE interpretation END AS response,
 critic_score AS score, intent_type FROM training WHERE is_final AND critic_score >= 80)"""


@query("m15_training_pairs", "M15 C9 X14", _PAIRS + " SELECT * FROM p WHERE instruction <> '' AND response <> ''")
def training_pairs(spark, sf):
    return lg.fine_tune_pairs(b.training_log(spark, sf))


@query("e27_intent_coverage", "E27", _PAIRS + """ SELECT count(*) AS pairs, (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT intent_type AS i FROM p)) AS intents
 FROM p WHERE instruction <> '' AND response <> ''""")
def intent_coverage(spark, sf):
    return lg.intent_coverage(lg.fine_tune_pairs(b.training_log(spark, sf)))


_DIMENSIONS = sorted({d for dims in fv.RUBRIC_WEIGHTS.values() for d in dims})
_RUBRIC = "rubric(intent, dimension, weight) AS (VALUES " + ", ".join(
    f"('{i}', '{d}', {w})" for i, dims in fv.RUBRIC_WEIGHTS.items() for d, w in dims.items()) + ")"
_EDGE = r"[^\p{L}\p{N}_]"
_INTENT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(question), '(^|{_EDGE})({'|'.join(words)})($|{_EDGE})') THEN '{name}'"
    for name, words in fv.INTENT_KEYWORDS) + " ELSE 'aggregation' END"


@query("m9_weighted_scores", "M9", with_sql("questions") + f""", {_RUBRIC}, q AS (SELECT conv_id, turn, length(text) AS n, {_INTENT} AS intent FROM questions)
SELECT conv_id, turn, q.intent, round(sum(weight * ((n + length(dimension)) % 101)) / 100::DOUBLE, 4) AS weighted_score, sum(weight)::BIGINT AS total_weight
FROM q JOIN rubric r ON r.intent = CASE WHEN q.intent = 'comparison' THEN 'aggregation' ELSE q.intent END GROUP BY 1, 2, 3""")
def weighted_scores(spark, sf):
    scores = F.create_map(
        *[x for d in _DIMENSIONS for x in (F.lit(d), F.pmod(F.length("text") + len(d), F.lit(101)))]
    )
    scored = b.questions(spark, sf).select(
        "conv_id", "turn", tx.intent(F.col("question")).alias("intent"), scores.alias("dimension_scores")
    )
    return lg.weighted_scores(scored, lg.rubric_table(spark), ["conv_id", "turn"])


@query("m12_action_table", "M12 W9", f"""WITH {_ANSWERS}
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY position, turn) AS number, section, priority_action, left(question, 80) AS source_question,
 risk_flag, opportunity, '' AS owner, '' AS due_date FROM answers""")
def action_table(spark, sf):
    return lg.action_table(answers(spark, sf), "conv_id", "position", ("turn",))


@query("m13_session_summary", "M13", f"""WITH {_ANSWERS},
f AS (SELECT conv_id, count(*) AS items, count(DISTINCT section) AS sections, list(priority_action ORDER BY position)[1:3] AS a, list(risk_flag ORDER BY position)[1:3] AS r,
 (list(opportunity ORDER BY position) FILTER (opportunity <> ''))[1:2] AS o FROM answers GROUP BY 1)
SELECT conv_id, items, sections, 'This session covered ' || items || ' agenda items across ' || sections || ' sections. Key findings: ' || array_to_string(a, '; ')
 || '. Top risks: ' || array_to_string(r, '; ') || '.' || CASE WHEN o IS NOT NULL AND len(o) > 0 THEN ' Opportunities identified: ' || array_to_string(o, '; ') || '.' ELSE '' END AS summary FROM f""")
def session_summary(spark, sf):
    return lg.session_summary(answers(spark, sf), "conv_id", "position")


def _messages(spark, sf):
    replies = answers(spark, sf).select("conv_id", "turn", "rec")
    talk = table(spark, sf, "conversations").withColumn(
        "confidence", F.pmod(F.length("text"), F.lit(101)).cast("bigint")
    )
    return talk.join(replies, ["conv_id", "turn"], "left")


@query("m14_transcript_lines", "M14 A14", f"""WITH {_ANSWERS},
m AS (SELECT c.conv_id, c.turn, role, text, length(text) % 101 AS score, priority_action, risk_flag, opportunity FROM conversations c LEFT JOIN answers a ON c.conv_id = a.conv_id AND c.turn = a.turn AND c.role = 'assistant'),
l AS (SELECT conv_id, turn, 0 AS k, CASE role WHEN 'user' THEN 'USER: ' ELSE 'AGENT: ' END || text AS line FROM m WHERE role IN ('user', 'assistant')
 UNION ALL SELECT conv_id, turn, 1, '         RECOMMENDATION: Priority Action: ' || priority_action FROM m WHERE role = 'assistant' AND priority_action <> ''
 UNION ALL SELECT conv_id, turn, 2, '         Risk Flag: ' || risk_flag FROM m WHERE role = 'assistant' AND risk_flag <> ''
 UNION ALL SELECT conv_id, turn, 3, '         Opportunity: ' || opportunity FROM m WHERE role = 'assistant' AND opportunity <> ''
 UNION ALL SELECT conv_id, turn, 4, '         Confidence: ' || CASE WHEN score >= 85 THEN 'High' WHEN score >= 60 THEN 'Review' ELSE 'Low' END || ' (' || score || '/100)' FROM m WHERE role = 'assistant'
 UNION ALL SELECT conv_id, turn, 5, '' FROM m WHERE role = 'assistant')
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INT) AS line_no, line FROM l""")
def transcript_lines(spark, sf):
    return lg.transcript_lines(_messages(spark, sf), "conv_id", "turn")


@query("m14_headed_transcript", "M14", f"""WITH m AS (SELECT conv_id, turn, role, text, '[' || printf('%02d:%02d', 9 + turn // 60, turn % 60) || '] ' AS said FROM conversations),
l AS (SELECT conv_id, turn, 0 AS k, said || CASE role WHEN 'user' THEN 'USER: ' ELSE 'AGENT: ' END || text AS line FROM m WHERE role IN ('user', 'assistant')
 UNION ALL SELECT conv_id, turn, 1, '' FROM m WHERE role = 'assistant'
 UNION ALL SELECT DISTINCT conv_id, NULL, unnest([0, 1, 2, 3]), unnest(['{lg.TRANSCRIPT_TITLE}', 'Date: 2024-02-01', 'Session ID: ' || conv_id, '']) FROM m)
SELECT conv_id, turn, CAST(k AS INT) AS line_no, line FROM l""")
def headed_transcript(spark, sf):
    """Transcripts with a header per session and the minute of each message."""
    talk = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text", F.lit(None).cast("bigint").alias("confidence"),
        F.struct(*[F.lit("").alias(n) for n in ("priority_action", "risk_flag", "opportunity")]).alias("rec"),
        F.format_string("%02d:%02d:00", (F.lit(9) + F.floor(F.col("turn") / 60)).cast("int"), (F.col("turn") % 60).cast("int")).alias("said_at"),
    )
    return lg.transcript_lines(talk, "conv_id", "turn", time="said_at", day="2024-02-01")


@query("e26_session_scores", "E26", """SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS queries,
 round(sum(length(text) % 101) / count(*)::DOUBLE, 4) AS avg_confidence FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def session_scores(spark, sf):
    replies = _messages(spark, sf).filter(F.col("role") == "assistant")
    return lg.session_scores(replies.withColumn("session_id", F.col("conv_id").cast("string")))


@query("m21_note_texts", "M21", """SELECT deal_id, array_to_string(list_filter([CASE WHEN stage = 'Open' THEN 'KEY LEARNINGS:' || chr(10) || 'still open' END,
 'ACCOUNTS MENTIONED: Customer ' || account_id, CASE WHEN deal_value < 20000 THEN 'DATA CORRECTIONS:' || chr(10) || 'value missing' END,
 CASE WHEN stage = 'Proposal' THEN 'ACTIONS AGREED:' || chr(10) || 'follow up' END], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS note
FROM (SELECT o_orderkey AS deal_id, o_custkey AS account_id, o_totalprice AS deal_value,
      CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'O' THEN 'Open' ELSE 'Proposal' END AS stage FROM orders)""")
def note_texts(spark, sf):
    notes = b.deals(spark, sf).select(
        "deal_id",
        F.when(F.col("stage") == "Open", "still open").alias("learned"),
        F.format_string("Customer %d", "account_id").alias("accounts"),
        F.when(F.col("deal_value") < 20000, "value missing").otherwise("").alias("corrections"),
        F.when(F.col("stage") == "Proposal", "follow up").alias("actions"),
        F.lit(None).cast("string").alias("strategic"),
    )
    return notes.select("deal_id", lg.note_text().alias("note"))


@query("a16_day_documents", "A16", """
SELECT strftime(ts, '%Y%m%d') AS day, event_id, CASE WHEN event_id = min(event_id) OVER (PARTITION BY strftime(ts, '%Y%m%d')) THEN ''
 ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || event_type || ' by ' || user_id AS part FROM events""")
def day_documents(spark, sf):
    notes = table(spark, sf, "events").select(
        F.date_format("ts", "yyyyMMdd").alias("day"), "event_id",
        F.format_string("%s by %d", "event_type", "user_id").alias("note"),
    )
    return lg.day_document_parts(notes, "day", "event_id", "note")


# --- result shaping ---------------------------------------------------------------------


@query("c1_row_search", "C1", "SELECT o_orderkey, o_orderpriority FROM orders WHERE " + " OR ".join(
    f"regexp_matches({c}::VARCHAR, '(?i)urgent|77$')"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def row_search(spark, sf):
    return sh.search(table(spark, sf, "orders"), "urgent|77$").select("o_orderkey", "o_orderpriority")


@query("c2_preview_counts", "C2", """WITH h AS (SELECT regexp_matches(concat_ws(chr(10), c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment), '(?i)auto|42') AS hit FROM customer)
SELECT least(count(*) FILTER (hit), 100)::BIGINT AS shown, count(*) FILTER (hit) AS filtered, count(*) AS total FROM h""")
def preview_counts(spark, sf):
    df = table(spark, sf, "customer")
    return sh.preview_counts(df, sh.search(df, "auto|42"), 100)


@query("c2_preview_rows", "C2", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def preview_rows(spark, sf):
    return sh.preview(
        table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"),
        [F.col("c_acctbal").desc(), F.col("c_custkey")], 5,
    )


_STAGES = ["Closed Won", "Open", "Proposal"]


@query("m2_line_by_stage", "M2", with_sql("deals") + " SELECT service_line, " + ", ".join(
    f"""CAST(sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (stage = '{s}') AS DOUBLE) AS "{s} | total", count(*) FILTER (stage = '{s}') AS "{s} | deals" """
    for s in _STAGES) + " FROM deals GROUP BY 1")
def line_by_stage(spark, sf):
    return sh.pivot(
        b.deals(spark, sf), "service_line", "stage", _STAGES,
        {"total": money_sum_double("deal_value"), "deals": F.count(F.lit(1))},
    )


_SCENARIO = """s AS (SELECT 'deals' AS metric, count(*)::DOUBLE AS b, count(*)::DOUBLE AS n FROM deals
 UNION ALL SELECT 'revenue', sum(CAST(deal_value AS DECIMAL(18,2)))::DOUBLE, sum(CAST(deal_value AS DECIMAL(18,4)) * 1.1)::DOUBLE FROM deals
 UNION ALL SELECT 'won_value', sum(CAST(deal_value AS DECIMAL(18,2))) FILTER (stage = 'Closed Won')::DOUBLE, sum(CAST(deal_value AS DECIMAL(18,4)) * 1.1) FILTER (stage = 'Closed Won')::DOUBLE FROM deals)"""


@query("m4_price_scenario", "M4 M3", with_sql("deals") + f""", {_SCENARIO}
SELECT metric, b AS baseline, n AS scenario, round(n - b, 2) AS change, CASE WHEN b <> 0 THEN CASE WHEN n >= b THEN '+' ELSE '' END
 || round((n - b) / b * 100, 1)::DECIMAL(18,1)::VARCHAR || '%' ELSE '' END AS pct_change FROM s""")
def price_scenario(spark, sf):
    named = {
        "deals": F.count("*"),
        "revenue": money_sum_double("deal_value"),
        "won_value": money_sum_double(F.when(F.col("stage") == "Closed Won", F.col("deal_value"))),
    }
    return sh.scenario(b.deals(spark, sf), {"deal_value": "1.1"}, named)


@query("m3_year_comparison", "M3 D16 T5", with_sql("deals") + """
, b AS (SELECT strftime(created, '%m') AS metric, CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM deals WHERE year(created) = 2000 GROUP BY 1),
s AS (SELECT strftime(created, '%m') AS metric, CAST(sum(CAST(deal_value AS DECIMAL(18,2))) AS DOUBLE) AS v FROM deals WHERE year(created) = 2001 GROUP BY 1)
SELECT coalesce(b.metric, s.metric) AS metric, b.v AS baseline, s.v AS scenario, round(s.v - b.v, 2) AS change,
 CASE WHEN b.v <> 0 AND s.v IS NOT NULL THEN CASE WHEN s.v >= b.v THEN '+' ELSE '' END || round((s.v - b.v) / b.v * 100, 1)::DECIMAL(18,1)::VARCHAR || '%' ELSE '' END AS pct_change
FROM b FULL OUTER JOIN s ON b.metric = s.metric""")
def year_comparison(spark, sf):
    def year(y):
        return (
            b.deals(spark, sf)
            .filter(F.year("created") == y)
            .groupBy(F.date_format("created", "MM").alias("metric"))
            .agg(money_sum_double("deal_value").alias("value"))
        )

    return sh.what_if(year(2000), year(2001))


@query("e28_result_null_ratio", "E28", with_sql("deals", "closed", "gaps") + """
SELECT count(*) AS n_rows, ((count(*) - count(service_line)) + (count(*) - count(deal_value)) + (count(*) - count(close_date))) / (count(*) * 3)::DOUBLE AS null_ratio FROM gaps""")
def result_null_ratio(spark, sf):
    return sh.null_ratio(b.deals_with_gaps(spark, sf).select("service_line", "deal_value", "close_date"))


@query("m7_confidence_scores", "M7 M8", """
WITH q AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_rows, count(*) FILTER (role = 'system') / count(*)::DOUBLE AS nulls,
  max(length(text)) % 4 AS retries, max(length(text)) % 3 = 0 AS assumed, max(length(text)) % 7 = 0 AS cannot FROM conversations GROUP BY 1),
s AS (SELECT *, 100 - retries * 20 AS st FROM q),
t AS (SELECT *, CASE WHEN n_rows = 0 THEN least(st, 20) ELSE st - floor(nulls * 30) - CASE WHEN n_rows = 1 THEN 10 ELSE 0 END END - CASE WHEN assumed THEN 10 ELSE 0 END AS v FROM s),
u AS (SELECT conv_id, CAST(CASE WHEN cannot THEN 0 ELSE greatest(0, least(100, v)) END AS INT) AS score FROM t)
SELECT conv_id, score, CASE WHEN score >= 85 THEN 'High confidence' WHEN score >= 60 THEN 'Review recommended' ELSE 'Low confidence — verify manually' END AS label FROM u""")
def confidence_scores(spark, sf):
    longest = F.max(F.length("text"))
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("n_rows"),
        (F.count_if(F.col("role") == "system") / F.count("*")).alias("nulls"),
        F.pmod(longest, F.lit(4)).alias("retries"),
        (F.pmod(longest, F.lit(3)) == 0).alias("assumed"),
        (F.pmod(longest, F.lit(7)) == 0).alias("cannot"),
    )
    score = sh.confidence(*[F.col(c) for c in ("n_rows", "nulls", "retries", "assumed", "cannot")])
    return per.select("conv_id", score.alias("score")).withColumn("label", sh.confidence_label(F.col("score")))
