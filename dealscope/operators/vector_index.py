"""Exact nearest neighbours of a table of questions in a partitioned vector index.

Build: equal vectors become one entry (the smallest key stands for them). A bounded sample gives pivots, spread
out by farthest-first choice; every entry belongs to the cell of its nearest pivot, cells are cut by distance to
the pivot into blocks of at most ``BLOCK_ROWS`` entries, and each block keeps the range of its entries' distances
to every pivot. The index is a Parquet table of blocks, one row a block, the vectors packed as bytes.

Search: equal questions are asked once. Each question looks into one block near it first, up to ``CHUNK`` questions
with one block in a row of a join, which bounds the distance of its k-th neighbour; by the triangle inequality a
block can hold a nearer entry only if for every pivot the question's distance is within that bound of the block's
range. Questions of near cells make groups of at most about ``GROUP``, packed as one row each. A task meets one group
with one stripe of the blocks: it fetches the group once, reads the blocks from the index and lets those in reach of
the group pass: a block out of a question's reach is left out, the others are compared by one matrix product, and
the bound shrinks with every nearer entry. The result is exact, ties going to the smaller key. A vector is never
shuffled or stored for another group or stripe, so disk grows with questions + corpus; at most ``k`` rows a question
and stripe come out, for about as many tasks as the session shuffles into. Where vectors can hardly be told apart by
pivots the pairs compared grow with questions x corpus, as do, divided by ``GROUP``, the bytes read from the index.

Two vectors of different length are not comparable and raise; null vectors are not indexed and find nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscope import fixed_values as fv
from dealscope.functions.ordering import first_per_group
from dealscope.session import scratch_path

BLOCK_ROWS, CHUNK = 1024, 128
#: questions of a group, fewest blocks in reach a group and stripe, questions in one matrix product
GROUP, FEWEST_BLOCKS, TILE = 16384, 8, 256
#: entries drawn for the choice of pivots; fewest and most pivots
SAMPLE, FEWEST, MOST = 4096, 16, 512
#: bounds give way by this much and this share, so that the rounding of distances never leaves a neighbour out
SLACK = 1e-6
#: a vector shorter than this has no direction
NO_LENGTH = 1e-9
#: single precision judges squares up to this size, and is off by less than this share of them for each entry
LARGEST, SINGLE = 1e30, 2.0**-23
#: bytes of blocks that a Python worker takes at once, where the session names no other number
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


class VectorIndex(NamedTuple):
    path: str
    metric: str
    dims: int
    pivots: np.ndarray
    key_type: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/blocks")

    def members(self, spark: SparkSession) -> DataFrame:
        """rep, key: every indexed key with the one that stands for its vector."""
        return spark.read.parquet(f"{self.path}/members")


class Search(NamedTuple):
    """``hits``: question, key, distance. ``work``: one row that compares the pairs looked at with all of them."""

    hits: DataFrame
    work: DataFrame


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * dims:
        raise ValueError(f"vectors must have {dims} entries, no null among them")
    return flat.reshape(-1, dims)


def _listed(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def _directions(matrix: np.ndarray, side: int) -> np.ndarray:
    """Vectors of length 1; one without direction is at right angles to every other of its own and the other side."""
    length = np.sqrt((matrix * matrix).sum(axis=1))
    flat = length <= NO_LENGTH
    extra = np.zeros((len(matrix), 2))
    extra[flat, side] = 1.0
    unit = np.where(flat[:, None], 0.0, matrix / np.where(flat, 1.0, length)[:, None])
    return np.hstack([unit, extra])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, for bounds."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _prepared(df: DataFrame, name: str, vector: str, metric: str, side: int, dims: int) -> DataFrame:
    """(name, v) with v as the search compares it: as given, or by direction."""
    rows = df.select(name, F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    if metric == "l2":
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _listed(_directions(_matrix(batch.column("v"), dims), side))
            yield pa.RecordBatch.from_arrays([batch.column(name), made], names=[name, "v"])

    return rows.mapInArrow(run, T.StructType([df.schema[name], T.StructField("v", T.ArrayType(T.DoubleType()))]))


def _spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the farthest from those before it; fewer if the sample has no more."""
    chosen, least = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        least = np.minimum(least, _apart(sample, sample[chosen[-1:]])[:, 0])
        far = int(least.argmax())
        if least[far] <= 0:
            break
        chosen.append(far)
    return sample[chosen]


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_matrix(batch.column("v"), pivots.shape[1]), pivots)
            cell = apart.argmin(axis=1)
            made = {"cell": pa.array(cell.astype(np.int32)), "r": pa.array(apart[np.arange(len(cell)), cell])}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("rep", "v")} | made)

    return run


def _blocks(pivots: np.ndarray):
    """Rows sorted by cell and distance to blocks, with the range of distances to every pivot."""

    def block(cell: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        reps = rows.column("rep").combine_chunks()
        matrix = _matrix(rows.column("v"), pivots.shape[1])
        apart = _apart(matrix, pivots)
        made = {
            "cell": pa.array([cell], pa.int32()),
            "block": pa.array([f"{cell}:{reps[0].as_py()}"]),
            "n": pa.array([len(matrix)], pa.int64()),
            "low": _listed(apart.min(axis=0)[None]),
            "high": _listed(apart.max(axis=0)[None]),
            "reps": pa.ListArray.from_arrays(pa.array([0, len(reps)], pa.int32()), reps),
            "data": pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        of = None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (cells[a] != of or sum(x.num_rows for x in held) >= BLOCK_ROWS):
                        yield block(of, held)
                        held = []
                    of = int(cells[a])
                    take = min(b - a, BLOCK_ROWS - sum(x.num_rows for x in held))
                    held.append(batch.slice(a, take))
                    a += take
        if held:
            yield block(of, held)

    return run


def build_index(corpus: DataFrame, key: str, vector: str, path: str | None = None, metric: str = "l2", pivots: int | None = None) -> VectorIndex:
    """Write the index of ``corpus`` below ``path`` (a new folder of the shared one if none is given)."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "vector-index")
    first = corpus.select(F.size(vector)).where(F.col(vector).isNotNull()).limit(1).collect()
    given = first[0][0] if first else 0
    dims = given + (2 if metric == "cosine" else 0)
    kind = corpus.schema[key].dataType.simpleString()
    own = _prepared(corpus.select(key, vector), key, vector, metric, 0, given).withColumnRenamed(key, "key")
    # the vector crosses the network once, in the grouping that finds equal ones
    grouped = own.withColumn("digest", F.xxhash64("v"))
    entries = grouped.groupBy("digest", "v").agg(F.min("key").alias("rep"))
    entries.write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    # only the hash of a vector meets its entry; equal hashes of different vectors are told apart by the vector
    same = grouped.join(entries.withColumnsRenamed({"digest": "d", "v": "w"}), (F.col("digest") == F.col("d")) & (F.col("v") == F.col("w")))
    same.select("rep", "key").write.parquet(f"{path}/members")
    count = entries.count()
    wanted = pivots or min(MOST, max(FEWEST, round(2 * (count / BLOCK_ROWS) ** 0.5)))
    sample = entries.orderBy(F.xxhash64("digest", F.lit(7)), "rep").limit(SAMPLE).select("v").toArrow()
    if sample.num_rows:
        chosen = _spread_out(_matrix(sample.column("v"), dims), wanted)
        placed = entries.select("rep", "v").mapInArrow(_cells(chosen), f"rep {kind}, v array<double>, cell int, r double")
        placed.write.parquet(f"{path}/placed")
        order = ["cell", "r", "rep"]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = spark.read.parquet(f"{path}/placed").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    else:
        chosen, dealt = np.zeros((0, dims)), entries.select("rep", "v").limit(0)
    schema = f"cell int, block string, n bigint, low array<double>, high array<double>, reps array<{kind}>, data binary"
    dealt.mapInArrow(_blocks(chosen), schema).write.parquet(f"{path}/blocks")
    return VectorIndex(path, metric, given, chosen, kind)


def _compared(k: int, dims: int, digits: int, half: bool):
    """The k nearest entries of one block for each question of a row; exact, after a selection by the fast form."""

    def nearest(asked: np.ndarray, matrix: np.ndarray, reps: list) -> Iterator[tuple[int, object, float]]:
        fast = _apart(asked, matrix)
        top = min(k, len(matrix))
        edge = np.partition(fast, top - 1, axis=1)[:, top - 1]
        scale = 1.0 + edge
        # twice the rounding of the output, so that ties after rounding are all compared
        for i in range(len(asked)):
            margin = max(1e-6 * scale[i], 4 * 10.0**-digits / max(edge[i], 1e-6))
            near = np.flatnonzero(fast[i] <= edge[i] + margin)
            gap = matrix[near] - asked[i]
            exact = np.round((gap * gap).sum(axis=1) / (2 if half else 1), digits)
            best = sorted(zip(exact.tolist(), (reps[x] for x in near.tolist()), strict=True))[:k]
            for distance, rep in best:
                yield i, rep, distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                asked = batch.column("asked")[n].as_py()
                matrix = np.frombuffer(batch.column("data")[n].as_py(), "<f8").reshape(-1, dims)
                vectors = np.array([a["v"] for a in asked])
                if vectors.shape[1] != dims:
                    raise ValueError(f"vectors must have {dims} entries")
                found = list(nearest(vectors, matrix, batch.column("reps")[n].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([asked[i]["q"] for i, *_ in found], pa.int64()),
                        pa.array([rep for _, rep, _ in found], batch.schema.field("reps").type.value_type),
                        pa.array([d for *_, d in found], pa.float64()),
                    ],
                    names=["q", "rep", "distance"],
                )

    return run


def _looked_up(pairs: DataFrame, index: VectorIndex, k: int, digits: int) -> DataFrame:
    """q, rep, distance for (q, v, block) pairs: the k nearest of every pair."""
    spark = pairs.sparkSession
    dims = index.pivots.shape[1]
    # a block that many ask for is met by many rows of at most about CHUNK questions
    sizes = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = pairs.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")))
    chunks = dealt.groupBy("block", "chunk").agg(F.collect_list(F.struct("q", "v")).alias("asked"))
    rows = chunks.join(index.blocks(spark).select("block", "reps", "data"), "block").select("asked", "reps", "data")
    return rows.mapInArrow(_compared(k, dims, digits, index.metric == "cosine"), f"q bigint, rep {index.key_type}, distance double")


def _stored(df: DataFrame, path: str, name: str) -> DataFrame:
    df.write.parquet(f"{path}/{name}")
    return df.sparkSession.read.parquet(f"{path}/{name}")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows that are blocks go to Python a few at a time, as an executor holds a batch more than once."""
    if spark.conf.get(BATCH_SETTING, None) is not None:
        yield
        return
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING)


def _near_cell(pivots: np.ndarray, filled: np.ndarray):
    """The nearest cell of each question (q, v) that holds anything, with the distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = _apart(_matrix(batch.column("v"), pivots.shape[1]), pivots[filled])
            own = apart.argmin(axis=1)
            made = [batch.column("q"), pa.array(filled[own].astype(np.int32)), pa.array(apart[np.arange(len(own)), own])]
            yield pa.RecordBatch.from_arrays(made, names=["q", "cell", "r"])

    return run


def _packed(pivots: np.ndarray):
    """The questions of a partition as one row a group, with the range of their distances to every pivot and the largest bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            groups = batch.column("group").to_numpy()
            for group in np.unique(groups).tolist():
                held.setdefault(group, []).append(batch.filter(pa.array(groups == group)))
        for group, parts in held.items():
            rows = pa.Table.from_batches(parts)
            matrix = _matrix(rows.column("v"), pivots.shape[1])
            apart = _apart(matrix, pivots)
            made = {"group": pa.array([group], pa.int32())}
            for name, column in (("q", "q"), ("theta", "theta"), ("home", "block")):
                values = rows.column(column).combine_chunks()
                made[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            made |= {
                "v": pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
                "g_low": _listed(apart.min(axis=0)[None]),
                "g_high": _listed(apart.max(axis=0)[None]),
                "widest": pa.array([pc.max(rows.column("theta")).as_py()], pa.float64()),
            }
            yield pa.RecordBatch.from_pydict(made)

    return run


def _dealt_cells(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(cell, first group, groups): a large cell is cut into groups of at most about ``GROUP``, small ones share one."""
    out, group, held = [], 0, 0
    for cell, n in sorted(counts.items()):
        if held and held + n > GROUP:
            group, held = group + 1, 0
        parts = -(-n // GROUP)
        out.append((cell, group, parts))
        group, held = (group + parts, 0) if parts > 1 else (group, held + n)
    return out


class _Asked:
    """The questions of a group and the ``k`` nearest entries they have met."""

    def __init__(self, row: pa.RecordBatch, pivots: np.ndarray, k: int, digits: int, half: bool):
        self.k, self.digits, self.scale, self.slack = k, digits, 2.0 if half else 1.0, 10.0**-digits
        self.q, self.home = row.column("q")[0].values, row.column("home")[0].values.to_numpy(zero_copy_only=False)
        self.v = np.frombuffer(row.column("v")[0].as_buffer(), "<f8").reshape(-1, pivots.shape[1])
        self.square = (self.v * self.v).sum(axis=1)
        # one product gives what has to be added to a question's own square to be the squared distance
        self.left = np.hstack([-2 * self.v, np.ones((len(self.v), 1))])
        with np.errstate(over="ignore"):
            self.rough = self.left.astype(np.float32)
        self.apart = _apart(self.v, pivots)
        self.theta = row.column("theta")[0].values.to_numpy().copy()
        self.found: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.new = self.pairs = 0

    def meet(self, name: str, matrix: np.ndarray, reps: pa.Array, low: np.ndarray, high: np.ndarray) -> None:
        gap = np.maximum(low - self.apart, self.apart - high).max(axis=1)
        near = np.flatnonzero((gap <= self.theta * (1 + SLACK) + SLACK) & (self.home != name))
        self.pairs += len(near) * len(matrix)
        square = (matrix * matrix).sum(axis=1)
        right, most = np.hstack([matrix, square[:, None]]).T, square.max()
        with np.errstate(over="ignore"):
            rough = right.astype(np.float32)
        for start in range(0, len(near), TILE):
            own = near[start : start + TILE]
            rounding = 1e-12 * (self.square[own] + most)
            limit = self.theta[own] ** 2 * (1 + SLACK) - self.square[own] + rounding
            if self.square[own].max() + most < LARGEST:
                # most blocks have nothing nearer, which single precision shows: each of its terms is at most the squares
                off = SINGLE * (len(right) + 4) * (self.square[own] + 2 * most)
                some = np.flatnonzero((self.rough[own] @ rough).min(axis=1) <= limit + off)
                own, rounding, limit = own[some], rounding[some], limit[some]
                if not len(own):
                    continue
            fast = self.left[own] @ right
            hit = fast <= limit[:, None]
            # where the bound says little yet, the k nearest of the block and their ties after rounding
            many = np.flatnonzero(np.count_nonzero(hit, axis=1) > 4 * self.k)
            if len(many):
                edge = np.partition(fast[many], self.k - 1, axis=1)[:, self.k - 1]
                edge += 2 * (rounding[many] + self.scale * self.slack)
                hit[many] &= fast[many] <= edge[:, None]
            i, j = np.nonzero(hit)
            if len(i):
                off = matrix[j] - self.v[own[i]]
                exact = np.round((off * off).sum(axis=1) / self.scale, self.digits)
                self.found.append((own[i], exact, reps.take(pa.array(j))))
                self.new += len(i)
        if self.new > max(2 * len(self.v), 8192):
            self.cut()

    def cut(self) -> None:
        """Keep the ``k`` nearest of each question and lower its bound."""
        table = pa.table({
            "i": np.concatenate([i for i, *_ in self.found]), "d": np.concatenate([d for _, d, _ in self.found]),
            "rep": pa.chunked_array([r for *_, r in self.found]),
        })
        keys = [("i", "ascending"), ("d", "ascending"), ("rep", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        i = table.column("i").to_numpy()
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        table = table.filter(pa.array(rank < self.k))
        i, d, rank = i[rank < self.k], table.column("d").to_numpy(), rank[rank < self.k]
        last = rank == self.k - 1
        self.theta[i[last]] = np.minimum(self.theta[i[last]], np.sqrt(self.scale * (d[last] + self.slack)))
        self.found, self.new = [(i, d, table.column("rep").combine_chunks())], 0

    def result(self, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = ["q", "rep", "distance", "pairs"]
        if self.found:
            self.cut()
            i, d, rep = self.found[0]
            yield pa.RecordBatch.from_arrays([self.q.take(pa.array(i)), rep, pa.array(d), pa.nulls(len(i), pa.int64())], names=names)
        counted = [pa.nulls(1, pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.float64()), pa.array([self.pairs], pa.int64())]
        yield pa.RecordBatch.from_arrays(counted, names=names)


def _met(pivots: np.ndarray, k: int, digits: int, half: bool):
    """A group's questions, in its first row only, and the blocks of a stripe to hits and one count of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Asked] = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("reps").type.value_type
            for n, group in enumerate(batch.column("group").to_pylist()):
                row = batch.slice(n, 1)
                if row.column("q").null_count == 0:
                    asked[group] = _Asked(row, pivots, k, digits, half)
                matrix = np.frombuffer(row.column("data")[0].as_buffer(), "<f8").reshape(-1, pivots.shape[1])
                low, high = (row.column(c)[0].values.to_numpy() for c in ("low", "high"))
                asked[group].meet(row.column("block")[0].as_py(), matrix, row.column("reps")[0].values, low, high)
        for each in asked.values():
            yield from each.result(kind)

    return run


def _second_look(asked: DataFrame, homes: DataFrame, theta: DataFrame, index: VectorIndex, path: str, k: int, digits: int) -> DataFrame:
    """q, rep, distance of the nearest entries outside the home blocks, and rows with the pairs compared."""
    spark = asked.sparkSession
    pivots, parts = index.pivots, int(spark.conf.get("spark.sql.shuffle.partitions"))
    # at most ``MOST`` rows
    cells = _dealt_cells({r["cell"]: r["count"] for r in homes.groupBy("cell").count().collect()})
    out = f"q bigint, rep {index.key_type}, distance double, pairs bigint"
    if not cells:
        return spark.createDataFrame([], out)
    groups = max(first + n for _, first, n in cells)
    dealt = F.broadcast(spark.createDataFrame(cells, "cell int, first int, n_groups int"))
    own = F.col("first") + F.pmod(F.xxhash64("q"), F.col("n_groups")).cast("int")
    grouped = asked.join(homes, "q").join(theta, "q").join(dealt, "cell").select("q", "v", "theta", "block", own.alias("group"))
    grouped = _stored(grouped, path, "grouped")
    schema = "group int, q array<bigint>, theta array<double>, home array<string>, v binary, g_low array<double>, g_high array<double>, widest double"
    packed = _stored(grouped.repartitionById(groups, "group").mapInArrow(_packed(pivots), schema), path, "packed")
    blocks = index.blocks(spark)
    gaps = F.zip_with(
        F.arrays_zip("low", "high"), F.arrays_zip("g_low", "g_high"), lambda b, g: F.greatest(b["low"] - g["g_high"], g["g_low"] - b["high"])
    )
    in_reach = F.array_max(gaps) <= F.col("widest") * (1 + SLACK) + SLACK
    # products that read their sides again and again and shuffle nothing; the ranges are one row a group
    ranges = packed.select("group", "g_low", "g_high", "widest").coalesce(1).hint("shuffle_replicate_nl")
    near = _stored(blocks.select("block", "low", "high").join(ranges, in_reach).select("group", "block"), path, "near")
    stripes = max(1, min(-(-parts // groups), -(-near.count() // (groups * FEWEST_BLOCKS))))
    # the first block of a stripe brings the questions along and is sent in any case
    opens = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    striped = blocks.select("block", "low", "high", "reps", "data").coalesce(stripes).withColumn("opens", opens)
    met = striped.join(packed.repartitionById(groups, "group").hint("shuffle_replicate_nl"), F.col("opens") | in_reach)
    brought = [F.when(F.col("opens"), F.col(c)).alias(c) for c in ("q", "theta", "home", "v")]
    rows = met.select("group", "block", "low", "high", "reps", "data", *brought)
    return rows.mapInArrow(_met(pivots, k, digits, index.metric == "cosine"), out)


def search(questions: DataFrame, question: str, vector: str, index: VectorIndex, k: int = fv.SEARCH_RESULTS, max_distance: float | None = None, digits: int = 9) -> Search:
    """The ``k`` nearest indexed keys of every question, with distances as ``nearest`` gives them, rounded to ``digits``.

    ``max_distance`` (in the metric's own measure: squared for l2) cuts the result and the search.
    """
    spark = questions.sparkSession
    path = scratch_path(spark, "vector-search")
    kind = questions.schema[question].dataType.simpleString()
    asked_schema = f"question {kind}, key {index.key_type}, distance double"
    work_schema = "questions bigint, corpus bigint, all_pairs bigint, pairs_computed bigint, pivot_pairs bigint"
    given = _prepared(questions.select(question, vector), question, vector, index.metric, 1, index.dims)
    given = given.withColumnRenamed(question, "question").withColumn("q", F.xxhash64("v"))
    given = _stored(given, path, "given")
    asked = _stored(given.groupBy("q").agg(F.min("v").alias("v")), path, "asked")
    # two different vectors of one hash would be one question: then the search is refused rather than wrong
    if given.groupBy("q").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a != b").limit(1).count():
        raise ValueError("two different question vectors have the same 64-bit hash")
    pivots = index.pivots
    cells = len(pivots)
    # at most ``MOST`` rows
    ranges = index.blocks(spark).select("cell").distinct().collect()
    if not ranges:
        empty = spark.createDataFrame([], asked_schema)
        return Search(empty, spark.createDataFrame([(given.count(), 0, 0, 0, 0)], work_schema))
    filled = np.array(sorted(r["cell"] for r in ranges))
    known = index.blocks(spark).select("cell", "block", "n", F.get("low", "cell").alias("low"), F.get("high", "cell").alias("high"))
    # first look: the block of the nearest cell in whose range the question is, a full one rather than a small one
    home = asked.mapInArrow(_near_cell(pivots, filled), "q bigint, cell int, r double").join(known, "cell")
    bound = F.greatest(F.col("low") - F.col("r"), F.col("r") - F.col("high"))
    best = F.struct((F.col("n") < k).alias("small"), bound.alias("bound"), "block", "n", "cell")
    homes = home.groupBy("q").agg(F.min(best).alias("best")).select("q", "best.block", "best.n", "best.cell")
    homes = _stored(homes, path, "homes")
    first = _stored(_looked_up(homes.join(asked, "q").select("q", "v", "block"), index, k, digits), path, "first")
    # the k-th distance found bounds the search, if there are k; the cut bounds it anyway
    halved = 2.0 if index.metric == "cosine" else 1.0
    cut = float("inf") if max_distance is None else max_distance
    kth = first.groupBy("q").agg(F.count(F.lit(1)).alias("found"), F.max("distance").alias("worst"))
    reached = F.when(F.col("found") >= k, F.least("worst", F.lit(cut))).otherwise(F.lit(cut))
    slack = 10.0**-digits
    theta = kth.select("q", F.sqrt(halved * (reached + slack)).alias("theta"))
    with _small_batches(spark):
        second = _stored(_second_look(asked, homes.select("q", "block", "cell"), theta, index, path, k, digits), path, "second")
    met = second.where(F.col("q").isNotNull()).drop("pairs")
    found = first_per_group(first.unionByName(met), ["q"], [F.col("distance"), F.col("rep")], k)
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    found = _stored(found, path, "found")
    # of a vector's keys only the first k can be among the k nearest
    named = first_per_group(index.members(spark).join(found.select("rep").distinct(), "rep", "left_semi"), ["rep"], [F.col("key")], k)
    rows = first_per_group(found.join(named, "rep").select("q", "key", "distance"), ["q"], [F.col("distance"), F.col("key")], k)
    hits = given.select("question", "q").join(rows, "q").select("question", "key", "distance")
    pairs = homes.select("n").unionByName(second.select(F.col("pairs").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs_computed"))
    work = pairs.select(
        F.lit(given.count()).cast("bigint").alias("questions"),
        F.lit(index.members(spark).count()).cast("bigint").alias("corpus"),
        "pairs_computed",
        F.lit(asked.count() * cells).cast("bigint").alias("pivot_pairs"),
    )
    work = work.select("questions", "corpus", (F.col("questions") * F.col("corpus")).alias("all_pairs"), "pairs_computed", "pivot_pairs")
    return Search(hits, work)
