"""Day documents that notes are appended to: ordered parts and a log of commits.

    {path}/parts/append=ID/...      the notes of one append
    {path}/commits/NNNNNNNNNN-ID    an empty file: append ID is part of the documents, as the N-th

The parts are written first; the commit file, created only if it is not there, makes them count all at once. An
append that broke before leaves the old documents, and its repetition overwrites what it left. An append that
is committed is not done again, so repeating it changes nothing. Two appends at the same time may take the same
number; their ids then order them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope import fixed_values as fv
from dealscope.operators.logs import day_document_parts
from dealscope.sources import tables as src

_SCHEMA = "day string, seq bigint, note string"


class DayNotes:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> dict[str, int]:
        """Append id -> place in the log, by file names only."""
        folder = f"{self.path}/commits"
        if not src.path_exists(self.spark, folder):
            return {}
        found: dict[str, int] = {}
        for name in src.list_folder(self.spark, folder, ""):
            if m := re.fullmatch(r"([0-9]{10})-([A-Za-z0-9_]+)", name):
                found[m[2]] = min(int(m[1]), found.get(m[2], int(m[1])))
        return found

    def append(self, append_id: str, notes: DataFrame, day: str, seq: str, text: str) -> bool:
        """Append each row's note to its day's document, in ``seq`` order; False if the append is there already."""
        if not re.fullmatch("[A-Za-z0-9_]+", append_id):
            raise ValueError(f"append id {append_id!r} may hold letters, digits and _ only")
        if append_id in self.committed():
            return False
        rows = notes.select(F.col(day).cast("string").alias("day"), F.col(seq).cast("bigint").alias("seq"), F.col(text).alias("note"))
        rows.where(F.col("note").isNotNull()).write.mode("overwrite").parquet(f"{self.path}/parts/append={append_id}")
        return self._commit(append_id)

    def _commit(self, append_id: str) -> bool:
        place = max(self.committed().values(), default=0) + 1
        return src.create_empty(self.spark, f"{self.path}/commits/{place:010d}-{append_id}")

    def parts(self) -> DataFrame:
        """day, place, part: the documents' parts, separators included; a day's parts in ``place`` order are its document."""
        done = self.committed()
        frames = [
            self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/parts/append={name}").withColumn("append", F.struct(F.lit(n).alias("n"), F.lit(name).alias("id")))
            for name, n in done.items()
        ]
        rows = self.spark.createDataFrame([], _SCHEMA).withColumn("append", F.struct(F.lit(0).alias("n"), F.lit("").alias("id")))
        for one in frames:
            rows = rows.unionByName(one)
        placed = rows.select("day", F.struct("append", "seq").alias("place"), "note")
        return day_document_parts(placed, "day", "place", "note")

    def write_documents(self, path: str) -> str:
        """The documents as text parts in day and place order, one folder per day; each ends with a line break."""
        ordered = self.parts().repartitionByRange("day", "place").sortWithinPartitions("day", "place")
        # the line break behind each part is the first character of the next one's separator
        part = F.when(F.col("part").startswith(fv.NOTE_SEPARATOR), F.expr("substring(part, 2)")).otherwise(F.col("part"))
        named = ordered.select(F.concat(F.lit("notes_"), F.col("day")).alias("document"), part.alias("part"))
        named.write.mode("error").partitionBy("document").text(path)
        return path
