"""Streams in two runs, against the batch result."""

from pyspark.sql import functions as F

from dealscope.session import scratch_path
from dealscope.streaming import ingest as st

SCHEMA = "id bigint, seq bigint, val string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").option("header", True).csv(folder)


def test_each_file_is_ingested_once(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    land(spark, folder, [(1, 1, "a")])
    st.ingest(st.new_files(spark, folder, SCHEMA), target, state)
    land(spark, folder, [(2, 2, "b")])
    for _ in range(2):
        st.ingest(st.new_files(spark, folder, SCHEMA), target, state)
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2]


def test_upsert_takes_equal_batches_and_compacts(spark):
    folder, base, state = (scratch_path(spark, n) for n in ("in", "base", "state"))

    def run():
        st.upsert(st.new_files(spark, folder, SCHEMA, per_trigger=1), "t", base, state)

    def rows():
        return sorted((r["id"], r["val"]) for r in st.current(spark, base, "id", "seq").collect())

    land(spark, folder, [(1, 1, "a"), (2, 2, "b")])
    run()
    land(spark, folder, [(1, 1, "a"), (2, 2, "b")])  # the same file again
    run()
    assert rows() == [(1, "a"), (2, "b")]
    land(spark, folder, [(2, 3, "B"), (3, 4, "c")])
    run()
    assert rows() == [(1, "a"), (2, "B"), (3, "c")]
    st.compact(spark, base, "id", "seq")
    assert rows() == [(1, "a"), (2, "B"), (3, "c")]
    land(spark, folder, [(1, 5, "A")])
    run()
    assert rows() == [(1, "A"), (2, "B"), (3, "c")]


def test_seen_items_across_runs(spark):
    folder, target, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    for rows in ([(1, 1, "x"), (2, 2, "y")], [(1, 3, "x"), (3, 4, "z")]):
        land(spark, folder, rows)
        st.ingest_unseen(st.new_files(spark, folder, SCHEMA).select("val"), "val", target, state)
    assert sorted(r["val"] for r in spark.read.parquet(target).collect()) == ["x", "y", "z"]


def test_watermark_bounds_the_registry(spark):
    folder = scratch_path(spark, "in")
    land(spark, folder, [(1, 1, "x")])
    stream = st.new_files(spark, folder, SCHEMA).withColumn("at", F.timestamp_seconds("seq"))
    plan = st.unseen(stream, "val", "at")._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan and "DeduplicateWithinWatermark" in plan
