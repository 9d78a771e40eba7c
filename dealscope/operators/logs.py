"""Answer-log analytics: iterations, patterns, training pairs, actions, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.functions import text as tx
from dealscope.functions.numbers import ratio
from dealscope.functions.ordering import first_per_group

# Fixed schemas of the history tables
QUERY_LOG = (
    "id bigint, timestamp timestamp_ntz, question string, code string, result_summary string, "
    "score double, iterations int, error string"
)
CODE_PATTERNS = (
    "id bigint, timestamp timestamp_ntz, question_type string, code_pattern string, score double, use_count bigint"
)
SESSION_LOG = "session_id string, started_at timestamp_ntz, file_names array<string>"
CALL_LOG = (
    "timestamp string, provider string, model string, system_snippet string, user_snippet string, "
    "response_snippet string, latency_ms bigint, error string"
)


def best_iterations(log: DataFrame) -> DataFrame:
    """Best-scoring iteration per query, the earliest on ties."""
    return first_per_group(log, ["query_id"], [F.col("score").desc(), F.col("iteration")])


def final_flags(log: DataFrame, threshold: int = fv.SCORE_THRESHOLD, allowed: int = fv.MAX_ITERATIONS) -> DataFrame:
    """The iteration that ends each query: first at the threshold, else the last allowed.

    The end of each query is one aggregated row, joined back; no window holds a query.
    """
    ends = log.groupBy("query_id").agg(
        F.min(F.when(F.col("score") >= threshold, F.col("iteration"))).alias("_hit"),
        F.max(F.when(F.col("iteration") <= allowed, F.col("iteration"))).alias("_last"),
    )
    end = F.least(F.coalesce("_hit", "_last"), F.col("_last"))
    return log.join(ends, "query_id").withColumn("is_final", F.col("iteration") == end).drop("_hit", "_last")


def log_rows(df: DataFrame, summary_chars: int = 500) -> DataFrame:
    """Query-log rows as stored; summaries keep ``summary_chars`` characters."""
    return df.withColumn("result_summary", F.substring(F.coalesce("result_summary", F.lit("")), 1, summary_chars))


def call_rows(df: DataFrame, system_chars: int = 200, user_chars: int = 200, response_chars: int = 400) -> DataFrame:
    """Call-log rows as stored; each snippet keeps its number of characters."""
    return df.withColumns(
        {
            "system_snippet": F.substring("system_snippet", 1, system_chars),
            "user_snippet": F.substring("user_snippet", 1, user_chars),
            "response_snippet": F.substring("response_snippet", 1, response_chars),
        }
    )


def recent(log: DataFrame, when: str, key: str, n: int | None = 20) -> DataFrame:
    """The ``n`` latest rows, as a top-k; all rows, latest first, without ``n``."""
    ordered = log.orderBy(F.col(when).desc(), F.col(key).desc())
    return ordered if n is None else ordered.limit(n)


def patterns(stored: DataFrame, question_type: str | None = None) -> DataFrame:
    """Patterns by score, best first; optional contains filter in any case."""
    if question_type:
        escaped = question_type.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        stored = stored.filter(F.col("question_type").ilike(f"%{escaped}%"))
    return stored.orderBy(F.col("score").desc(), "question_type")


def store_patterns(answers: DataFrame, order: list[str], min_score: int = fv.PATTERN_SCORE) -> DataFrame:
    """Answers good enough to keep, the earliest of each equal code."""
    good = answers.filter(F.col("score") >= min_score)
    return first_per_group(good, ["code"], [F.col(c) for c in order])


def upsert_patterns(logged: DataFrame, order: list[str]) -> DataFrame:
    """Uses, best score and first code per question type (partial aggregates only)."""
    first = F.min(F.struct(*order, F.col("code").alias("_code")))
    return (
        logged.groupBy("question_type")
        .agg(F.count("*").alias("use_count"), F.max("score").alias("score"), first.alias("_f"))
        .select("question_type", "use_count", "score", F.col("_f._code").alias("code_pattern"))
    )


def good_records(log: DataFrame, min_score: int) -> DataFrame:
    """Final records with at least ``min_score``."""
    return log.filter(F.col("is_final") & (F.coalesce("critic_score", F.lit(0)) >= min_score))


def fine_tune_pairs(log: DataFrame, min_score: int = fv.FINE_TUNE_SCORE) -> DataFrame:
    """Instruction and response pairs, recommendation block included, empties dropped."""
    given = F.from_json("recommendation", tx.RECOMMENDATION)
    rec = tx.recommendation_json(F.col("recommendation"))
    answer = F.coalesce("interpretation", F.lit(""))
    block = F.concat(
        F.lit("\n\nRECOMMENDATION:\nPriority Action: "), rec["priority_action"],
        F.lit("\nRisk Flag: "), rec["risk_flag"], F.lit("\nOpportunity: "), rec["opportunity"],
    )
    any_text = F.concat(rec["priority_action"], rec["risk_flag"], rec["opportunity"]) != ""
    has_fields = F.coalesce(
        given["priority_action"], given["risk_flag"], given["opportunity"]
    ).isNotNull()
    response = (
        F.when(any_text, tx.strip(F.concat(answer, block)))
        .when(has_fields, tx.strip(answer))
        .otherwise(answer)
    )
    pairs = good_records(log, min_score).select(
        "doc_id",
        F.coalesce("question", F.lit("")).alias("instruction"),
        F.concat(F.lit("Intent: "), F.coalesce("intent_type", F.lit("unknown"))).alias("context"),
        response.alias("response"),
        F.col("critic_score").alias("score"),
        F.coalesce("intent_type", F.lit("unknown")).alias("intent_type"),
    )
    return pairs.filter((F.col("instruction") != "") & (F.col("response") != ""))


def intent_coverage(pairs: DataFrame) -> DataFrame:
    """Pairs and the sorted distinct intents (a handful of category names)."""
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.array_join(F.array_sort(F.collect_set("intent_type")), ",").alias("intents"),
    )


def rubric_table(spark: SparkSession) -> DataFrame:
    """M9: the rubric weights as rows; a fixed table of about thirty."""
    rows = [(i, d, w) for i, dims in fv.RUBRIC_WEIGHTS.items() for d, w in dims.items()]
    return spark.createDataFrame(rows, "intent string, dimension string, weight int")


def weighted_scores(scored: DataFrame, rubric: DataFrame, key: list[str]) -> DataFrame:
    """M9: weighted score per answer; an intent without weights uses aggregation's.

    ``scored`` has one row per answer with its intent and a map of dimension scores.
    """
    known = list(fv.RUBRIC_WEIGHTS)
    used = F.when(F.col("intent").isin(*known), F.col("intent")).otherwise("aggregation")
    joined = scored.withColumn("_used", used).join(
        F.broadcast(rubric.withColumnRenamed("intent", "_used")), "_used"
    )
    points = F.col("weight") * F.coalesce(F.col("dimension_scores")[F.col("dimension")], F.lit(0))
    return joined.groupBy(*key, "intent").agg(
        F.round(F.sum(points).cast("double") / 100, 4).alias("weighted_score"),
        F.sum("weight").alias("total_weight"),
    )


def session_scores(answers: DataFrame) -> DataFrame:
    """Queries and mean confidence per session."""
    return answers.groupBy("session_id").agg(
        F.count("*").alias("queries"),
        F.round(ratio(F.sum("confidence"), F.count("confidence")), 4).alias("avg_confidence"),
    )


# --- actions and summaries -----------------------------------------------------------


def number_in_session(
    actions: DataFrame, session: str, position: str, ties: tuple[str, ...] = (), stretch: int = 1024
) -> DataFrame:
    """Running number 1, 2, ... of each action within its session, by position and then ``ties``.

    A session is cut into stretches of ``stretch`` positions. Only the row counts of
    its stretches are ordered together; rows are numbered inside their stretch, so a
    session of any length is spread over many tasks. Null positions come last.
    """
    place = F.floor(F.col(position) / stretch)
    cut = actions.withColumn("_stretch", F.coalesce(place.cast("bigint"), F.lit(2**62)))
    earlier = Window.partitionBy(session).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(session, "_stretch").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    starts = starts.withColumnsRenamed({session: "_session", "_stretch": "_of"})
    inside = Window.partitionBy(session, "_stretch").orderBy(F.col(position).asc_nulls_last(), *ties)
    numbered = cut.withColumn("_within", F.row_number().over(inside))
    same = F.col(session).eqNullSafe(F.col("_session")) & (F.col("_stretch") == F.col("_of"))
    return (
        numbered.join(starts, same)
        .withColumn("number", (F.col("_within") + F.col("_before")).cast("bigint"))
        .drop("_stretch", "_of", "_session", "_within", "_before")
    )


def action_table(answers: DataFrame, session: str, position: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Actions with source question, flags, and open owner and due date."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(f"rec.{name}"), F.lit("—"))

    numbered = number_in_session(answers, session, position, ties)
    return numbered.select(
        session,
        "number",
        "section",
        shown("priority_action").alias("priority_action"),
        F.substring("question", 1, 80).alias("source_question"),
        shown("risk_flag").alias("risk_flag"),
        shown("opportunity").alias("opportunity"),
        F.lit("").alias("owner"),
        F.lit("").alias("due_date"),
    )


#: texts of a session's summary and how many of each are told
_TOLD = {"priority_action": 3, "risk_flag": 3, "opportunity": 2}


def session_summary(answers: DataFrame, session: str, position: str) -> DataFrame:
    """Items, sections, first three actions and risks, first two opportunities.

    The texts of all three kinds are taken in one pass, of which the first few per session and kind leave a task.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("_kind"), F.col(f"rec.{name}").alias("_text")) for name in _TOLD])
    listed = answers.select(session, position, F.inline(cells)).filter(F.col("_text") != "")
    first = first_per_group(listed, [session, "_kind"], [F.col(position)], max(_TOLD.values()))
    own = lambda name: F.collect_list(F.when(F.col("_kind") == name, F.struct(position, "_text")))
    told = first.groupBy(session).agg(*[F.slice(F.array_sort(own(name)), 1, n).alias(name) for name, n in _TOLD.items()])
    joined = [F.nullif(F.array_join(F.transform(name, lambda s: s["_text"]), "; "), F.lit("")).alias(name) for name in _TOLD]
    counts = answers.groupBy(session).agg(F.count("*").alias("items"), F.count_distinct("section").alias("sections"))
    out = counts.join(told.select(session, *joined), session, "left")
    text = F.concat_ws(
        " ",
        F.concat(
            F.lit("This session covered "), F.col("items").cast("string"), F.lit(" agenda items across "),
            F.col("sections").cast("string"), F.lit(" sections."),
        ),
        F.concat(F.lit("Key findings: "), F.coalesce("priority_action", F.lit("see individual sections")), F.lit(".")),
        F.concat(F.lit("Top risks: "), F.coalesce("risk_flag", F.lit("none flagged")), F.lit(".")),
        F.concat(F.lit("Opportunities identified: "), F.col("opportunity"), F.lit(".")),
    )
    return out.select(session, "items", "sections", text.alias("summary"))


TRANSCRIPT_TITLE = "--- Chat transcript ---"


def transcript_lines(
    messages: DataFrame, session: str, turn: str, time: str | None = None, day: str | None = None
) -> DataFrame:
    """Chat transcript lines keyed by (session, turn, line number).

    ``time`` names a column whose text (its first five characters) stands before a message. With ``day`` (a date)
    each session begins with a header: its lines have a null turn, which sorts first.
    """
    pad = "         "
    at = F.lit("")
    if time:
        shown = F.substring(F.col(time).cast("string"), 1, 5)
        at = F.when(F.coalesce(shown, F.lit("")) != "", F.concat(F.lit("["), shown, F.lit("] "))).otherwise("")

    def extra(title: str, name: str) -> Column:
        value = F.col(f"rec.{name}")
        return F.when(value != "", F.concat(F.lit(f"{pad}{title}: "), value))

    score = F.col("confidence")
    level = F.when(score >= 85, "High").when(score >= 60, "Review").otherwise("Low")
    agent = F.array(
        F.concat(at, F.lit("AGENT: "), F.col("text")),
        extra("RECOMMENDATION: Priority Action", "priority_action"),
        extra("Risk Flag", "risk_flag"),
        extra("Opportunity", "opportunity"),
        F.when(
            score.isNotNull(),
            F.concat(F.lit(f"{pad}Confidence: "), level, F.lit(" ("), score.cast("string"), F.lit("/100)")),
        ),
        F.lit(""),
    )
    lines = F.when(F.col("role") == "user", F.array(F.concat(at, F.lit("USER: "), F.col("text")))).when(
        F.col("role") == "assistant", F.array_compact(agent)
    )
    out = messages.select(session, turn, F.posexplode(lines).alias("line_no", "line"))
    if day is None:
        return out
    title = [F.lit(TRANSCRIPT_TITLE), F.lit(f"Date: {day}"), F.concat(F.lit("Session ID: "), F.col(session).cast("string")), F.lit("")]
    nothing = F.lit(None).cast(messages.schema[turn].dataType).alias(turn)
    header = messages.select(session).distinct().select(session, nothing, F.posexplode(F.array(*title)).alias("line_no", "line"))
    return header.unionByName(out)


def call_summary(log: DataFrame, percentiles: tuple[int, ...] = (50, 95)) -> DataFrame:
    """Calls, errors and latency per provider (percentiles to 1/10,000 of the ranks)."""
    return log.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.count("error").alias("errors"),
        F.round(ratio(F.sum("latency_ms"), F.count("latency_ms")), 4).alias("avg_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        *[F.percentile_approx("latency_ms", p / 100, 10_000).alias(f"p{p}_latency_ms") for p in percentiles],
    )


# --- notes -----------------------------------------------------------------------------

NOTE_SECTIONS = (
    ("learned", "KEY LEARNINGS:\n"),
    ("accounts", "ACCOUNTS MENTIONED: "),
    ("corrections", "DATA CORRECTIONS:\n"),
    ("actions", "ACTIONS AGREED:\n"),
    ("strategic", "STRATEGIC CONTEXT:\n"),
)


def note_text() -> Column:
    """The filled note sections, blank ones left out."""
    parts = [
        F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(title), F.col(name)))
        for name, title in NOTE_SECTIONS
    ]
    return F.concat_ws("\n\n", *parts)


def day_document_parts(notes: DataFrame, day: str, seq: str, text: str) -> DataFrame:
    """Notes as parts of their day's document, separators included.

    Every note after the first of its day starts with the separator, so the parts of
    a day in ``seq`` order are the document. A day is never gathered in one task;
    the only per-day data is its first sequence number.
    """
    firsts = notes.groupBy(day).agg(F.min(seq).alias("_first"))
    part = F.when(F.col(seq) == F.col("_first"), F.col(text)).otherwise(
        F.concat(F.lit(fv.NOTE_SEPARATOR), F.col(text))
    )
    return notes.join(firsts, day).select(day, seq, part.alias("part"))
