"""Helpers the text operators share: row keys, durable tables, checked broadcasts, array expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.session import shared_folder

#: ``[^\x20\x09-\x0D]+``: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
#: rows up to which a table may be broadcast; counted before the hint is given
BROADCAST_ROWS = 200_000
#: rows of a small table that go to one file
ROWS_A_FILE = 20_000
#: id of rows without one; it sorts after every other
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that a lost executor loses none of it.

    ``rows``: about how many narrow rows it has, where that is known. A table too small for all shuffle partitions
    is written as few files and not as one per partition.
    """
    context = df.sparkSession.sparkContext
    if rows is not None and (files := rows // ROWS_A_FILE + 1) < partitions(df.sparkSession):
        df = df.repartition(files)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often lambdas inside ``body`` read it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of ``text``; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged. ``lower`` does that for ASCII texts; only others are mapped by character."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def word_windows(hashes: Column, size: int) -> Column:
    """One hash for each run of ``size`` entries of an array of word hashes, in order; empty if there are fewer."""
    one = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])
    return F.when(
        F.size(hashes) >= size,
        let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: one(h, i))),
    ).otherwise(F.array().cast("array<bigint>"))


#: matches whose positions are summed up together
MATCH_BLOCK = 256


def located(text: Column, pattern: str, keep: Callable[[Column], Column]) -> Column:
    """start (from 0, in code points), match and the text on both sides up to the next matches, of every match kept.

    Positions are running sums of the lengths of matches and of the pieces between them, summed by blocks so that
    a text of many matches takes no square of their number. A match is not empty.
    """
    length = lambda x: F.length(x["before"]) + F.length(x["match"])

    def placed(found: Column, begin: Column) -> Column:
        zero = F.struct(begin.alias("at"), F.array().cast("array<struct<start:int,match:string,before:string,after:string>>").alias("out"))

        def add(state: Column, x: Column) -> Column:
            start = state["at"] + F.length(x["before"])
            one = F.struct(start.alias("start"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after"))
            kept = F.when(keep(x["match"]), F.concat(state["out"], F.array(one))).otherwise(state["out"])
            return F.struct((state["at"] + length(x)).alias("at"), kept.alias("out"))

        return F.aggregate(found, zero, add, lambda s: s["out"])

    def in_blocks(found: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(found) / MATCH_BLOCK).cast("int")),
            lambda k: F.slice(found, k * MATCH_BLOCK + 1, MATCH_BLOCK),
        )
        return let(
            cut,
            lambda blocks: let(
                F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x))),
                lambda sums: F.flatten(
                    F.transform(
                        blocks, lambda b, k: placed(b, F.aggregate(F.slice(sums, 1, k), F.lit(0), lambda n, x: n + x))
                    )
                ),
            ),
        )

    both = F.struct(
        F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )
    pairs = let(
        both,
        lambda x: F.transform(
            x["match"],
            lambda m, i: F.struct(m.alias("match"), F.get(x["before"], i).alias("before"), F.get(x["before"], i + 1).alias("after")),
        ),
    )
    return let(pairs, in_blocks)


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, ``row_hash`` and the named columns: rows that agree in both are the same document twice."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), *columns)


def kept_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Whole rows of ``docs`` with (left_semi) or without (left_anti) their key among ``keys``."""
    marked = docs.withColumn("_llm_row_hash", F.xxhash64("doc_id", "text"))
    keys = keys.select(F.col("doc_id").alias("_llm_doc_id"), F.col("row_hash").alias("_llm_key_hash"))
    condition = marked["doc_id"].eqNullSafe(keys["_llm_doc_id"]) & (marked["_llm_row_hash"] == keys["_llm_key_hash"])
    return marked.join(keys, condition, how).drop("_llm_row_hash")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` holds at most ``most_bytes`` in each, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(lengths):
            if i > begin and held + n > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by ``key``: one table for each of its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        ends = pc.indices_nonzero(pc.not_equal(keys[:-1], keys[1:])).to_pylist()
        begin = 0
        for end in [*(int(e) + 1 for e in ends), batch.num_rows]:
            part = batch.slice(begin, end - begin)
            if held and held[-1].column(key)[0] != part.column(key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
            begin = end
    if held:
        yield pa.Table.from_batches(held)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more, by whatever file system it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
