"""Streams of new files: ingest, upsert, seen-item registry, log append.

Every stream keeps its place in a checkpoint folder, runs with ``availableNow`` and
writes so that a repeated micro-batch leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.functions.ordering import first_per_group
from dealscope.operators.changes import fingerprint
from dealscope.sources.tables import list_folder, path_exists
from dealscope.streaming.seen import SeenItems


def new_files(spark: SparkSession, folder: str, schema, fmt: str = "csv", per_trigger: int = 100, **options) -> DataFrame:
    """A stream over the files that appear in ``folder``."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.options(**options).load(folder)


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append the stream to a Parquet folder, each file once."""
    _run(stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint))


def upsert(stream: DataFrame, table: str, base: str, checkpoint: str) -> None:
    """R2: write each micro-batch as one delta folder with its fingerprint.

    A batch costs its own rows only; the table is never rewritten. The folder is
    named by the batch number, so a repeated batch replaces itself. Rows equal to an
    older batch are written again: they may revert what came between.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        prints = fingerprint(batch, table, "").withColumn("written_by", F.lit(number))
        batch.write.mode("overwrite").parquet(f"{base}/deltas/batch={number}")
        prints.write.mode("overwrite").parquet(f"{base}/fingerprints/batch={number}")
        batch.unpersist()

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def _compacted(spark: SparkSession, base: str) -> int:
    """Number of the newest batch inside a finished compaction, -1 if there is none."""
    folder = f"{base}/compacted"
    if not path_exists(spark, folder):
        return -1
    done = [int(n.split("=")[1]) for n in list_folder(spark, folder, "") if n.startswith("upto=")]
    done = [n for n in done if path_exists(spark, f"{folder}/upto={n}/_SUCCESS")]
    return max(done, default=-1)


def current(spark: SparkSession, base: str, key: str, sequence: str) -> DataFrame:
    """R2: the latest row per key over the last compaction and the deltas after it."""
    upto = _compacted(spark, base)
    rows = spark.read.parquet(f"{base}/deltas").filter(F.col("batch") > upto)
    if upto >= 0:
        rows = rows.unionByName(
            spark.read.parquet(f"{base}/compacted/upto={upto}").withColumn("batch", F.lit(upto))
        )
    order = [F.col("batch").desc(), F.col(sequence).desc()]
    return first_per_group(rows, [key], order).drop("batch")


def compact(spark: SparkSession, base: str, key: str, sequence: str) -> None:
    """Write the current rows as a new folder; readers of older folders are not disturbed."""
    newest = spark.read.parquet(f"{base}/deltas").agg(F.max("batch")).first()[0]
    if newest > _compacted(spark, base):
        target = f"{base}/compacted/upto={newest}"
        current(spark, base, key, sequence).write.mode("overwrite").parquet(target)


def unseen(stream: DataFrame, hash_col: str, event_time: str, keep: str = "7 days") -> DataFrame:
    """First item per hash within the watermark, which bounds the state."""
    return stream.withWatermark(event_time, keep).dropDuplicatesWithinWatermark([hash_col])


def ingest_unseen(stream: DataFrame, hash_col: str, target: str, checkpoint: str, **settings) -> None:
    """Append items whose hash was not seen before, one per hash and for good.

    Seen hashes are in a registry beside the items (``SeenItems``; ``settings`` go there), of which a batch reads
    the partitions its own hashes fall in. Items and registry are folders named by the batch number, and a batch
    looks at older numbers only, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = SeenItems(spark, f"{target}/_seen", **settings)
        folder = f"{target}/batch={number}"
        seen.unseen(batch.dropDuplicates([hash_col]), hash_col, number).write.mode("overwrite").parquet(folder)
        seen.add(number, spark.read.schema(batch.schema).parquet(folder), hash_col)

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint))


def list_batches(spark: SparkSession, base: str) -> list[str]:
    """Names of the batch folders below ``base``."""
    if not path_exists(spark, base):
        return []
    return [n for n in list_folder(spark, base, "") if n.startswith("batch=")]
