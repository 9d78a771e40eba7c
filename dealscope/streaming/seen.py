"""A registry of seen items that costs a batch what the batch holds, however long the registry is.

Hashes lie in partitions by their own value, each partition as a folder with its items and with Bloom filters over
them. A batch opens only the partitions its hashes fall in: first their filters, which tell for nearly every unseen
hash that it is not there, then the items of partitions where a filter said it may be. Batches are written beside
each other and merged now and then; the merge chooses the number of partitions so that each holds about
``rows_per_part`` hashes, so a partition does not grow with the registry.

    {path}/batches/number=N/...   {path}/merged/upto=N_parts=K/...    each with items/part=P and filters/part=P

A batch is a folder named by its number and looks at older numbers only, and a merge takes batches older than the
one being written, so a repeated batch finds what it found before and replaces itself.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscope.session import delete_path
from dealscope.sources.tables import list_folder, path_exists

#: bits of one filter (the size of Spark's bitmaps), hashes set in it at most on average, and bits set by each
BITS, PER_FILTER, PROBES = 32_768, 3_000, 3
ROWS_PER_PART, FIRST_PARTS, MERGE_AFTER = 100_000, 16, 16


class State(NamedTuple):
    """The newest finished merge (or none), the partition count and the batch numbers after it."""

    merged: str | None
    upto: int
    parts: int
    batches: list[int]


class SeenItems:
    def __init__(self, spark: SparkSession, path: str, rows_per_part: int = ROWS_PER_PART, merge_after: int = MERGE_AFTER):
        self.spark, self.path = spark, path
        self.rows_per_part, self.merge_after = rows_per_part, merge_after

    # --- where things are: folder names only

    def state(self, before: int | None = None) -> State:
        merged, upto, parts = None, -1, FIRST_PARTS
        for name in self._names("merged"):
            n, k = (int(x.split("=")[1]) for x in name.split("_"))
            done = path_exists(self.spark, f"{self.path}/merged/{name}/filters/_SUCCESS")
            if done and upto < n and (before is None or n < before):
                merged, upto, parts = f"{self.path}/merged/{name}", n, k
        numbers = sorted(int(n.split("=")[1]) for n in self._names("batches"))
        ready = [n for n in numbers if n > upto and (before is None or n < before) and self._done(n)]
        return State(merged, upto, parts, ready)

    def _names(self, kind: str) -> list[str]:
        folder = f"{self.path}/{kind}"
        return [n for n in list_folder(self.spark, folder, "") if "=" in n] if path_exists(self.spark, folder) else []

    def _done(self, number: int) -> bool:
        return path_exists(self.spark, f"{self._batch(number)}/filters/_SUCCESS")

    def _batch(self, number: int) -> str:
        return f"{self.path}/batches/number={number}"

    def _folders(self, state: State) -> list[str]:
        return [state.merged] * (state.merged is not None) + [self._batch(n) for n in state.batches]

    # --- reading

    def _read(self, folders: list[str], kind: str, parts: list[int], columns: list[str]) -> DataFrame | None:
        """Rows of the named partitions only: the others' folders are not opened."""
        found = None
        for folder in folders:
            own = {n for n in list_folder(self.spark, f"{folder}/{kind}", "") if n.startswith("part=")}
            paths = [f"{folder}/{kind}/part={p}" for p in parts if f"part={p}" in own]
            if paths:
                one = self.spark.read.option("basePath", f"{folder}/{kind}").parquet(*paths).select(*columns)
                found = one if found is None else found.unionByName(one)
        return found

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r["part"] for r in rows.select("part").distinct().collect())  # no more than there are partitions

    def split(self, items: DataFrame, hash_col: str, before: int | None = None) -> tuple[DataFrame, DataFrame | None]:
        """``items`` with their partition, and the registered hashes among them (None: surely none is)."""
        state = self.state(before)
        placed = items.withColumn("part", _part(F.col(hash_col), state.parts))
        folders = self._folders(state)
        filters = self._read(folders, "filters", self._touched(placed), ["part", "of", "filter", "bits"]) if folders else None
        if filters is None:
            return placed, None
        asked = placed.select(F.col(hash_col).alias("hash"), "part").distinct()
        own = (asked["part"] == filters["part"]) & (F.pmod(F.xxhash64("hash", F.lit(-1)), "of") == F.col("filter"))
        may = asked.join(filters, own).where(_holds(F.col("bits"), F.col("hash"))).select("hash", asked["part"]).distinct()
        held = self._read(folders, "items", self._touched(may), ["hash"])
        return placed, None if held is None else may.join(held.distinct(), "hash", "left_semi").select("hash")

    def unseen(self, items: DataFrame, hash_col: str, before: int | None = None) -> DataFrame:
        """The rows of ``items`` whose hash no batch (before the given number) registered."""
        placed, held = self.split(items, hash_col, before)
        rest = placed if held is None else placed.join(held, placed[hash_col] == held["hash"], "left_anti")
        return rest.drop("part")

    def hashes(self) -> DataFrame:
        folders = self._folders(self.state())
        frames = [self.spark.read.parquet(f"{f}/items").select("hash") for f in folders]
        return _union(frames) if frames else self.spark.createDataFrame([], "hash string")

    def bytes_opened(self, items: DataFrame, hash_col: str, before: int | None = None) -> int:
        """The size of the files that ``unseen`` opens for these items."""
        state = self.state(before)
        folders = self._folders(state)
        placed, _ = self.split(items, hash_col, before)
        filters = self._read(folders, "filters", self._touched(placed), ["bits"]) if folders else None
        if filters is None:
            return 0
        asked = placed.select(F.col(hash_col).alias("hash"), "part").distinct()
        all_filters = self._read(folders, "filters", self._touched(placed), ["part", "of", "filter", "bits"])
        own = (asked["part"] == all_filters["part"]) & (F.pmod(F.xxhash64("hash", F.lit(-1)), "of") == F.col("filter"))
        may = asked.join(all_filters, own).where(_holds(F.col("bits"), F.col("hash"))).select(asked["part"])
        held = self._read(folders, "items", self._touched(may), ["hash"])
        files = filters.inputFiles() + (held.inputFiles() if held is not None else [])
        return sum(_size(self.spark, f) for f in files)

    # --- writing

    def add(self, number: int, items: DataFrame, hash_col: str) -> None:
        """Register the hashes of batch ``number``; merges what is older when it has become many batches."""
        state = self.state(number)
        if len(state.batches) >= self.merge_after:
            self.merge(number)
            state = self.state(number)
        rows = items.select(F.col(hash_col).alias("hash")).distinct()
        self._write(rows, self._batch(number), state.parts)

    def merge(self, before: int | None = None) -> None:
        """One folder for all batches older than ``before``, partitioned for their number; what it replaces goes."""
        state = self.state(before)
        if not state.batches:
            return
        folders = self._folders(state)
        rows = _union([self.spark.read.parquet(f"{f}/items").select("hash") for f in folders]).distinct()
        count = sum(self.spark.read.parquet(f"{f}/items").count() for f in folders)  # footers only
        parts = FIRST_PARTS
        while parts * self.rows_per_part < count:
            parts *= 2
        self._write(rows, f"{self.path}/merged/upto={state.batches[-1]}_parts={parts}", parts)
        for folder in folders:
            delete_path(self.spark, folder)

    def _write(self, rows: DataFrame, folder: str, parts: int) -> None:
        placed = rows.withColumn("part", _part(F.col("hash"), parts))
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/items")
        stored = self.spark.read.schema("hash string, part int").parquet(f"{folder}/items")
        sizes = stored.groupBy("part").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PER_FILTER)).cast("int").alias("of"))
        cells = stored.join(sizes, "part").withColumn("filter", F.pmod(F.xxhash64("hash", F.lit(-1)), "of").cast("int"))
        cells = cells.select("part", "of", "filter", F.explode(F.array(*[_bit(F.col("hash"), i) for i in range(PROBES)])).alias("bit"))
        bits = cells.groupBy("part", "of", "filter").agg(F.bitmap_construct_agg("bit").alias("bits"))
        bits.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/filters")


def _part(hash_col: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(hash_col), F.lit(parts)).cast("int")


def _bit(hash_col: Column, probe: int) -> Column:
    """The place of a hash's ``probe``-th bit in its filter."""
    return F.pmod(F.xxhash64(hash_col, F.lit(probe)), F.lit(BITS))


def _holds(bits: Column, hash_col: Column) -> Column:
    """Whether all bits of a hash are set."""
    out = None
    for probe in range(PROBES):
        at = _bit(hash_col, probe)
        byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        one = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)) != 0
        out = one if out is None else out & one
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _size(spark: SparkSession, file: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
