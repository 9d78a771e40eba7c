"""Sources, sinks and streams on the test tables; files go to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealscope.operators import logs as lg
from dealscope.plans import bindings as b
from dealscope.plans.bindings import table, with_sql
from dealscope.plans.registry import query
from dealscope.session import scratch_path
from dealscope.sources import benchmarks as bm
from dealscope.sources import loading as ld
from dealscope.sources import notes as nt
from dealscope.sources import tables as src
from dealscope.streaming import ingest as st


@query("a1_csv_round_trip", "A1 A13 X22", with_sql("deals", "closed", "gaps") + """
SELECT CAST(deal_id AS VARCHAR) AS deal_id, '£' || format('{:,.2f}', CAST(deal_value AS DECIMAL(18,2))::DOUBLE) AS deal_value,
 strftime(created, '%d/%m/%Y') AS created, service_line FROM gaps""")
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    src.write_csv(b.deals_as_text(spark, sf).select("deal_id", "deal_value", "created", "service_line"), path)
    return src.read_csv(spark, path)


def _folder(spark, sf):
    folder = scratch_path(spark, "folder")
    for name in ("customer", "nation", "supplier"):
        src.write_csv(table(spark, sf, name), f"{folder}/{name}.csv")
    src.make_folder(spark, f"{folder}/broken.csv")
    return folder


@query("a3_folder_status", "A3", """
SELECT 'customer' AS name, 'loaded' AS status, 5 AS n_columns, count(*) AS n_rows FROM customer
UNION ALL SELECT 'nation', 'loaded', 3, count(*) FROM nation UNION ALL SELECT 'supplier', 'loaded', 4, count(*) FROM supplier
UNION ALL SELECT 'broken', 'failed', 0, 0""")
def folder_status(spark, sf):
    return ld.load(spark, _folder(spark, sf)).status.select("name", "status", "n_columns", "n_rows")


@query("a5_load_summary", "A5 A6", """
SELECT 4::BIGINT AS files_found, 3::BIGINT AS files_loaded, 1::BIGINT AS files_failed, 0::BIGINT AS bad_rows,
 (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) AS total_rows, 12::BIGINT AS total_columns,
 hits::BIGINT AS cache_hits, 3::BIGINT - hits AS cache_misses, 'broken: no data files' AS errors FROM (VALUES (0), (2)) t(hits)""")
def load_summary(spark, sf):
    """The same folder twice; in between one table is written anew, so its copy no longer counts."""
    folder, copies = _folder(spark, sf), scratch_path(spark, "copies")
    first = ld.load_summary(ld.load(spark, folder, copies).status)
    src.write_csv(table(spark, sf, "nation").repartition(2), f"{folder}/nation.csv")
    return first.unionByName(ld.load_summary(ld.load(spark, folder, copies).status))


@query("a3_bad_rows", "A3 A1", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey % 7 = 0 AS bad, o_orderkey % 2 AS half FROM orders)
SELECT half::INT AS half, 'good' AS kind, o_orderkey || '|' || o_custkey || CASE half WHEN 0 THEN '|' || o_orderstatus ELSE '' END AS record FROM o WHERE NOT bad
UNION ALL SELECT half::INT, 'bad', o_orderkey || ',' || o_custkey || CASE half WHEN 0 THEN ',' || o_orderstatus ELSE '' END || ',one more' FROM o WHERE bad""")
def bad_rows(spark, sf):
    """A list of two paths into one folder each; one row in seven has a cell too many, one table lacks a column."""
    orders, folder = table(spark, sf, "orders"), scratch_path(spark, "lines")
    columns, paths = ["o_orderkey", "o_custkey", "o_orderstatus"], []
    for half in (0, 1):
        own = columns if half == 0 else columns[:2]
        line = F.concat_ws(",", *own, F.when(F.col("o_orderkey") % 7 == 0, "one more")).alias(",".join(own))
        paths.append(f"{folder}/half{half}.csv")
        rows = orders.where(F.col("o_orderkey") % 2 == half).select(line)
        rows.write.option("header", True).option("sep", "\x01").csv(paths[-1])
    loaded = ld.load(spark, paths)
    parts = [
        df.select(F.lit(int(name[-1])).alias("half"), F.lit("good").alias("kind"), F.concat_ws("|", *df.columns).alias("record"))
        for name, df in loaded.tables.items()
    ]
    bad = loaded.bad_rows.select(F.substring("name", -1, 1).cast("int").alias("half"), F.lit("bad").alias("kind"), "record")
    return parts[0].unionByName(parts[1]).unionByName(bad)


@query("a16_appended_notes", "A16", """
WITH n AS (SELECT strftime(ts, '%Y%m%d') AS day, event_id % 3 AS load, event_id, event_type || ' ' || event_id AS note FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY load, event_id) AS rn FROM n)
SELECT day, CAST(load + 1 AS INT) AS append, event_id AS seq, CASE WHEN rn = 1 THEN '' ELSE chr(10) || chr(10) || '---' || chr(10) || chr(10) END || note AS part FROM r""")
def appended_notes(spark, sf):
    """Three appends, each of them twice, and one that breaks off before its commit."""
    events = table(spark, sf, "events")
    notes = events.select(
        F.date_format("ts", "yyyyMMdd").alias("day"), "event_id", F.concat_ws(" ", "event_type", "event_id").alias("note")
    )
    days = nt.DayNotes(spark, scratch_path(spark, "notes"))
    for load in (0, 1, 2):
        for _ in range(2):
            days.append(f"load_{load}", notes.where(F.col("event_id") % 3 == load), "day", "event_id", "note")
    notes.withColumnRenamed("event_id", "seq").write.parquet(f"{days.path}/parts/append=broken")
    return days.parts().select("day", F.col("place.append.n").alias("append"), F.col("place.seq").alias("seq"), "part")


@query("a6_parquet_copy", "A6 X20", """
SELECT 16 AS key_length, 1::BIGINT AS keys, * FROM orders""")
def parquet_copy(spark, sf):
    folder, orders = scratch_path(spark, "copies"), table(spark, sf, "orders")
    key = src.table_key(orders)
    src.cached(spark, folder, key, lambda: orders)
    again = src.cached(spark, folder, key, lambda: orders.limit(0))
    return again.select(
        F.lit(len(key)).alias("key_length"), F.lit(len(src.cached_keys(spark, folder))).cast("bigint").alias("keys"), "*"
    )


_LOG = "doc_id bigint, question string, intent_type string, critic_score bigint, is_final boolean"


@query("a10_json_lines", "A10 A11", with_sql("training") + " SELECT doc_id, question, intent_type, critic_score, is_final FROM training")
def json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    log = b.training_log(spark, sf).select("doc_id", "question", "intent_type", "critic_score", "is_final")
    good = log.select(F.to_json(F.struct("*")).alias("line"))
    broken = log.select(F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(", broken")).alias("line"))
    blank = log.select(F.lit("").alias("line"))
    good.unionByName(broken).unionByName(blank).write.text(path)
    return src.read_jsonl(spark, path, _LOG)


@query("a12_appended_log", "A11 A12 M20", """
SELECT CASE role WHEN 'user' THEN 'local' ELSE 'cloud' END AS provider, 2 * count(*) AS calls, 2 * count(*) FILTER (role = 'system') AS errors,
 round(sum(length(text)) / count(*)::DOUBLE, 4) AS avg_latency_ms, max(length(text)) AS max_latency_ms,
 quantile_disc(length(text), 0.5) AS p50_latency_ms, quantile_disc(length(text), 0.95) AS p95_latency_ms FROM conversations GROUP BY 1""")
def appended_log(spark, sf):
    path = scratch_path(spark, "calls")
    calls = table(spark, sf, "conversations").select(
        F.lit("2024-02-01T00:00:00").alias("timestamp"),
        F.when(F.col("role") == "user", "local").otherwise("cloud").alias("provider"),
        F.lit("m").alias("model"),
        F.col("text").alias("system_snippet"),
        F.col("text").alias("user_snippet"),
        F.col("text").alias("response_snippet"),
        F.length("text").cast("bigint").alias("latency_ms"),
        F.when(F.col("role") == "system", "timeout").alias("error"),
    )
    for _ in range(2):
        src.write_jsonl(lg.call_rows(calls), path, append=True)
    return lg.call_summary(src.read_jsonl(spark, path, lg.CALL_LOG))


@query("a13_log_export", "A13 S5", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS question, CAST(user_id AS VARCHAR) AS iterations
FROM events""")
def log_export(spark, sf):
    path = scratch_path(spark, "export")
    latest = lg.recent(table(spark, sf, "events"), "ts", "event_id", n=None)
    src.write_csv(
        latest.select(F.col("event_id").alias("id"), F.col("event_type").alias("question"), F.col("user_id").alias("iterations")),
        path,
    )
    return src.read_csv(spark, path)


@query("a14_written_transcript", "A14 M14", r"""
WITH l AS (SELECT CASE role WHEN 'user' THEN 'USER: ' ELSE 'AGENT: ' END || regexp_replace(text, '[\r\n]+', ' ', 'g') AS line FROM conversations WHERE role IN ('user', 'assistant')
 UNION ALL SELECT '' FROM conversations WHERE role = 'assistant')
SELECT line, count(*) AS times FROM l GROUP BY 1""")
def written_transcript(spark, sf):
    path = scratch_path(spark, "transcript")
    # line breaks inside a message are kept as blanks, so one message is one line
    talk = table(spark, sf, "conversations").withColumn("text", F.regexp_replace("text", r"[\r\n]+", " "))
    talk = talk.withColumn("confidence", F.lit(None).cast("bigint")).withColumn(
        "rec",
        F.struct(
            F.lit("").alias("priority_action"), F.lit("").alias("risk_flag"), F.lit("").alias("opportunity")
        ),
    )
    src.write_lines(lg.transcript_lines(talk, "conv_id", "turn"), path, ["conv_id", "turn", "line_no"])
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("times"))


@query("a15_text_tree", "A15", """
SELECT 'source=' || source AS source_type, sum(length(text) + 1)::BIGINT AS n_chars FROM documents GROUP BY 1
UNION ALL SELECT 'base', sum(length(text) + 1)::BIGINT FROM benchmark""")
def text_tree(spark, sf):
    base = scratch_path(spark, "knowledge")
    docs = table(spark, sf, "documents").select("text", "source")
    docs.write.partitionBy("source").text(f"{base}/scraped", lineSep="\n")
    table(spark, sf, "benchmark").select("text").write.text(f"{base}/base")
    files = src.read_text_tree(spark, base)
    return files.groupBy("source_type").agg(F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("a15_text_files", "A15", """
SELECT 'scraped_item_id=' || item_id AS prefix, 'item_id=' || item_id AS source_type, md5(text || chr(10)) AS text_md5 FROM benchmark""")
def text_files(spark, sf):
    """One file per test item, each text compared as a whole."""
    base = scratch_path(spark, "knowledge")
    items = table(spark, sf, "benchmark").select("item_id", "text")
    items.repartition("item_id").write.partitionBy("item_id").text(f"{base}/scraped", lineSep="\n")
    files = src.read_text_tree(spark, base)
    return files.select(F.regexp_replace("prefix", "_part-.*$", "").alias("prefix"), "source_type", F.md5("text").alias("text_md5"))


@query("a17_benchmark_table", "A17", """
SELECT o_orderpriority AS service_line, count(*) FILTER (o_totalprice < 100000) AS small, count(*) FILTER (o_totalprice >= 100000 AND o_totalprice < 500000) AS mid
FROM orders GROUP BY 1""")
def benchmark_limits(spark, sf):
    limits = bm.benchmark_table(spark).filter(F.col("category") == "deal_size_brackets")
    wide = limits.groupBy("metric").pivot("stat", ["min", "max"]).agg(F.max("value_num"))
    wide = wide.fillna({"min": 0.0}).filter(F.col("metric").isin("small", "mid"))
    low = {r["metric"]: (r["min"], r["max"]) for r in wide.collect()}
    value = F.col("deal_value")
    return b.deals(spark, sf).groupBy("service_line").agg(
        *[F.count_if((value >= lo) & (value < hi)).alias(name) for name, (lo, hi) in low.items()]
    )


@query("a18_history_tables", "A18", """
SELECT conv_id * 100 + turn AS id, role AS question, left(text, 500) AS result_summary, (length(text) * 7) % 101 AS score FROM conversations""")
def history_tables(spark, sf):
    path = scratch_path(spark, "history")
    rows = b.iteration_log(spark, sf).select(
        (F.col("query_id") * 100 + F.col("iteration")).alias("id"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
        F.col("role").alias("question"),
        F.lit("").alias("code"),
        F.col("text").alias("result_summary"),
        F.col("score").cast("double").alias("score"),
        F.col("iteration").cast("int").alias("iterations"),
        F.lit(None).cast("string").alias("error"),
    )
    lg.log_rows(rows).write.mode("append").parquet(path)
    stored = spark.read.schema(lg.QUERY_LOG).parquet(path)
    return stored.select(
        "id", "question", "result_summary", F.col("score").cast("bigint").alias("score")
    )


@query("a18_session_log", "A18", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, string_agg(DISTINCT role || '.csv', ',' ORDER BY role || '.csv') AS files FROM conversations GROUP BY 1""")
def session_log(spark, sf):
    path = scratch_path(spark, "sessions")
    table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("session_id")).agg(
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("started_at"),
        F.array_sort(F.collect_set(F.concat("role", F.lit(".csv")))).alias("file_names"),
    ).write.parquet(path)
    stored = spark.read.schema(lg.SESSION_LOG).parquet(path)
    return stored.select("session_id", F.array_join("file_names", ",").alias("files"))


# --- streams -----------------------------------------------------------------------------


def _event_files(spark, sf, parts=4):
    folder = scratch_path(spark, "landing")
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    events.repartition(parts).write.parquet(folder)
    return folder, events.schema


@query("r1_file_ingest", "R1 A19", "SELECT event_id, user_id, event_type, value FROM events")
def file_ingest(spark, sf):
    folder, schema = _event_files(spark, sf)
    target, checkpoint = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    for _ in range(2):  # the second run finds no new file
        st.ingest(st.new_files(spark, folder, schema, "parquet", 1), target, checkpoint)
    return spark.read.schema(schema).parquet(target).select("event_id", "user_id", "event_type", "value")


@query("r2_stream_upsert", "R2 U7 W8", """
SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def stream_upsert(spark, sf):
    folder = scratch_path(spark, "landing")
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    # two files in time order: the second one carries the later events
    half = events.agg(F.avg("event_id")).scalar()
    first = events.filter(F.col("event_id") < half)
    first.write.parquet(folder)
    base, checkpoint = scratch_path(spark, "upserted"), scratch_path(spark, "upsert-state")
    st.upsert(st.new_files(spark, folder, events.schema, "parquet"), "events", base, checkpoint)
    events.filter(F.col("event_id") >= half).write.mode("append").parquet(folder)
    st.upsert(st.new_files(spark, folder, events.schema, "parquet"), "events", base, checkpoint)
    return st.current(spark, base, "user_id", "event_id")


@query("r3_seen_registry", "R3 X20", "SELECT DISTINCT substring(md5(url), 1, 16) AS url_hash FROM pages")
def seen_registry(spark, sf):
    folder = scratch_path(spark, "pages")
    pages = table(spark, sf, "pages").select(F.substring(F.md5("url"), 1, 16).alias("url_hash"))
    pages.write.parquet(folder)
    target, checkpoint = scratch_path(spark, "seen"), scratch_path(spark, "seen-state")
    st.ingest_unseen(st.new_files(spark, folder, pages.schema, "parquet"), "url_hash", target, checkpoint)
    pages.write.mode("append").parquet(folder)  # every page is found again
    st.ingest_unseen(st.new_files(spark, folder, pages.schema, "parquet"), "url_hash", target, checkpoint)
    return spark.read.parquet(target).select("url_hash")


@query("r4_log_stream", "R4 S5", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def log_stream(spark, sf):
    folder, schema = _event_files(spark, sf, 2)
    target, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "log-state")
    st.ingest(st.new_files(spark, folder, schema, "parquet"), target, checkpoint)
    return lg.recent(spark.read.schema(schema).parquet(target), "ts", "event_id").select("event_id", "event_type")


