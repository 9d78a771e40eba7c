"""Embedding whitening: leading principal components by a block Jacobi-Davidson method, applied to every vector.

Each entry c becomes the integer x = floor(64 c) + 1000000. The fit list holds each distinct x vector once; it
is written to the shared folder as packed blocks of vectors. The covariance is never formed: a product of it with
a few directions is one pass over the blocks, each task multiplying its centred vectors and Spark summing the
results by dimension, so dimension x directions numbers reach the driver, whatever the number of vectors.

The driver holds a small orthonormal basis. Rayleigh-Ritz on it gives approximations; leading ones whose residual
has reached double precision are locked, and for the others MINRES solves the projected correction equations, all
in lockstep, so that one pass serves every unlocked component. The corrections widen the basis until all wanted
components are locked. A basis that has grown too wide is thinned to its best directions.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; entries beyond 2**53 / 64
in size count as that. The dimension is the length most distinct vectors have (ties: the smaller); rows of another
length are dropped. Repeated rows and ids are results of their own, and count once in the fit. There are as many
components as the dimension and the rank allow: one whose eigenvalue is below ``RANK`` of the largest has no
direction and gives no rows, so a table of one distinct vector gives none, like an empty one. A ``deviation``
beyond the range of a long is null. Components of equal eigenvalues may be turned among themselves. Columns other
than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscope.llm.common import discard
from dealscope.session import scratch_path

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: entries, after scaling, are cut off here
LARGEST = 2.0**53
#: bytes of one block of packed vectors
BLOCK_BYTES = 1 << 20
#: rows of vectors turned into numbers at a time
CHUNK = 4096
#: a residual is at double precision below this many roundings of the largest eigenvalue, for each dimension
ROUNDINGS = 8
RANK = 1e-12
#: start directions beside the wanted ones, inner steps of a correction, basis width in wanted counts, outer rounds
SPARE, INNER_STEPS, WIDTH, ROUNDS = 8, 8, 4, 200
Product = Callable[[np.ndarray], np.ndarray]


class Components(NamedTuple):
    """What the fit gives: n, exact sums by dimension, trace, eigenvalues, directions (columns), residuals, identity error."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    directions: np.ndarray
    residuals: np.ndarray
    identity_error: float


def orthonormal(columns: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``columns`` add to ``others`` (which are orthonormal)."""
    made = np.zeros((len(columns), 0))
    for c in columns.T:
        size = np.linalg.norm(c)
        if not size > 0:
            continue
        c = c / size
        for _ in range(3):
            for basis in (*others, made):
                c = c - basis @ (basis.T @ c)
        rest = np.linalg.norm(c)
        if rest > 1e-12:
            made = np.column_stack([made, c / rest])
            # once more, now that the rest is of size 1
            last = made[:, -1]
            for basis in (*others, made[:, :-1]):
                last = last - basis @ (basis.T @ last)
            made[:, -1] = last / np.linalg.norm(last)
    return made


def corrections(product: Product, shifts: np.ndarray, residuals: np.ndarray, fixed: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """MINRES for each column: (A - shift) t = -residual among the directions orthogonal to ``fixed``."""
    project = lambda y: y - fixed @ (fixed.T @ y)
    safe = lambda x: np.where(x > 0, x, 1.0)
    b = -project(residuals)
    first = np.linalg.norm(b, axis=0)
    v, v_old = b / safe(first), np.zeros_like(b)
    w, w_old, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    beta, eta = np.zeros_like(first), first.copy()
    c, c_old = np.ones_like(first), np.ones_like(first)
    s, s_old = np.zeros_like(first), np.zeros_like(first)
    live = first > 0
    for _ in range(steps):
        p = project(product(v)) - shifts * v
        alpha = (v * p).sum(axis=0)
        p = project(p - alpha * v - beta * v_old)
        beta_new = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_old * s * beta
        rho = np.hypot(delta, beta_new)
        live = live & (rho > 0)
        c_new, s_new = delta / safe(rho), beta_new / safe(rho)
        w_new = (v - s_old * beta * w_old - (s * alpha + c_old * c * beta) * w) / safe(rho)
        x = x + np.where(live, c_new * eta, 0.0) * w_new
        eta = np.where(live, -s_new * eta, 0.0)
        live = live & (np.abs(eta) > tolerance * first) & (beta_new > 1e-14 * np.abs(alpha))
        if not live.any():
            break
        v, v_old, w, w_old = p / safe(beta_new), v, w_new, w
        beta, c, c_old, s, s_old = beta_new, c_new, c, s_new, s
    return project(x)


def jacobi_davidson(product: Product, dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive operator, falling, with eigenvectors and residual norms."""
    basis = orthonormal(np.random.default_rng(13).standard_normal((dims, min(dims, wanted + SPARE))))
    image = product(basis)
    locked, values, norms = np.zeros((dims, 0)), [], []
    best, idle, tolerance = np.inf, 0, 0.1
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        left = min(wanted - len(values), basis.shape[1])
        rest = image[:, :left] - basis[:, :left] * theta[:left]
        rest -= locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        scale = max([*values, theta[0], 0.0])
        exact = sizes <= ROUNDINGS * dims * np.finfo(float).eps * scale
        # nothing left to add: what is there is as good as rounding allows
        worst = sizes.max()
        best, idle = (worst, 0) if worst < best / 2 else (best, idle + 1)
        if basis.shape[1] + len(values) == dims and idle >= 2 or idle >= 12:
            if worst > 1e-9 * scale:
                raise ArithmeticError(f"residual {worst:g} of {scale:g} does not fall")
            exact[:] = True
        done = int(np.argmin(exact)) if not exact.all() else left
        if done:
            locked = np.column_stack([locked, basis[:, :done]])
            values, norms = [*values, *theta[:done]], [*norms, *sizes[:done]]
            basis, image, rest, theta = basis[:, done:], image[:, done:], rest[:, done:], theta[done:]
            best, idle = np.inf, 0
        if len(values) == wanted:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order], np.array(norms)[order]
        left -= done
        active = basis[:, :left]
        new = corrections(product, theta[:left], rest, np.column_stack([locked, active]), INNER_STEPS, tolerance)
        tolerance = max(tolerance / 10, 1e-6)
        if basis.shape[1] + left > min(dims, WIDTH * wanted):
            keep = min(basis.shape[1], 2 * wanted)
            basis, image = basis[:, :keep], image[:, :keep]
        new = orthonormal(new, locked, basis)
        if new.shape[1] == 0 and basis.shape[1] + len(values) < dims:
            fresh = np.random.default_rng(len(values) + 1).standard_normal((dims, 1))
            new = orthonormal(fresh, locked, basis)
        if new.shape[1]:
            basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
    raise ArithmeticError(f"{len(values)} of {wanted} components after {ROUNDS} rounds")


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the vectors of one length, and their x - SHIFT as a matrix; one pair for each length."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    finite = np.isfinite(values)
    good = (np.bincount(rows[~finite], minlength=len(lengths)) == 0) & pc.is_valid(column).to_numpy(zero_copy_only=False)
    x = np.clip(np.floor(SCALE * np.where(finite, values, 0.0)), -LARGEST, LARGEST).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[good]):
        own = np.flatnonzero(good & (lengths == size))
        yield own, x[starts[own][:, None] + np.arange(size)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as its entry width and entries, the narrowest width that holds them."""
    for batch in batches:
        out = []
        for _, x in integers(batch.column("vector")):
            most = np.abs(x).max(axis=1, initial=0)
            for row, m in zip(x, most, strict=True):
                width = next(w for w in (1, 2, 4, 8) if m < 1 << 8 * w - 1)
                out.append(bytes([width]) + row.astype(f"<i{width}").tobytes())
        yield pa.RecordBatch.from_pydict({"packed": pa.array(out, pa.binary())})


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed vectors of one length and width joined to blocks."""
    held: dict[tuple[int, int], list[bytes]] = {}

    def block(key: tuple[int, int]) -> pa.RecordBatch:
        found = held.pop(key)
        types = pa.int32(), pa.int32(), pa.int64(), pa.binary()
        made = [pa.array([v], t) for v, t in zip((*key, len(found), b"".join(found)), types, strict=True)]
        return pa.RecordBatch.from_arrays(made, names=["dims", "width", "n", "data"])

    for batch in batches:
        for packed in batch.column("packed").to_pylist():
            key = (len(packed) - 1) // packed[0], packed[0]
            held.setdefault(key, []).append(packed[1:])
            if len(held[key]) * len(packed) >= BLOCK_BYTES:
                yield block(key)
    for key in list(held):
        yield block(key)


def _matrix(width: int, data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, dims)


def _summed(blocks: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``of(x - SHIFT)``, a matrix; summed by row in each task and then by Spark."""
    probe = of(np.zeros((1, dims)))
    columns = [f"c{k}" for k in range(probe.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for width, data in zip(batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = _matrix(width, data, dims)
                for at in range(0, len(x), CHUNK):
                    part = of(x[at : at + CHUNK].astype(np.float64))
                    total = part if total is None else total + part
        if total is not None:
            made = [pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(c) for c in total.T)]
            yield pa.RecordBatch.from_arrays(made, names=["i", *columns])

    parts = blocks.select("width", "data").mapInArrow(run, ", ".join(["i int", *(f"{c} double" for c in columns)]))
    out = np.zeros(probe.shape)
    for row in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).collect():  # one row per matrix row
        out[row["i"]] = row[1:]
    return out


def _exact_sums(blocks: DataFrame, dims: int) -> list[int]:
    """The sum of x over the fit list for each dimension, in integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims, object)
        for batch in batches:
            for width, data in zip(batch.column("width").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = _matrix(width, data, dims)
                total = total + (x.astype(object) if width == 8 else x.astype(np.int64)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "s": pa.array([str(t) for t in total])})

    parts = blocks.select("width", "data").mapInArrow(run, "i int, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    return [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Components | None:
    """The leading components of the distinct vectors; None where there are none."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "whitening")
    raw = vectors.select(F.col(column).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    distinct = raw.mapInArrow(_packed, "packed binary").distinct()
    distinct.mapInArrow(_blocked, "dims int, width int, n bigint, data binary").write.parquet(path)
    blocks = spark.read.parquet(path)
    most = blocks.where("dims > 0").groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not most:
        discard(spark, path)
        return None
    dims, n = most[0]["dims"], most[0]["n"]
    blocks = blocks.where(F.col("dims") == dims)
    sums = _exact_sums(blocks, dims)
    mean = np.array([s / n for s in sums])
    product = lambda t: _summed(blocks, dims, lambda x: (c := x - mean).T @ (c @ t)) / n
    trace = float(_summed(blocks, dims, lambda x: np.square(x - mean).sum(axis=0)[:, None]).sum() / n)
    found = None
    if trace > 0:
        values, directions, residuals = jacobi_davidson(product, dims, min(components, dims))
        real = values > RANK * values[0]
        values, directions, residuals = values[real], directions[:, real], residuals[real]
        onto = directions / np.sqrt(values)
        spread = _summed(blocks, dims, lambda x: (z := (x - mean) @ onto).T @ z) / n
        error = float(np.abs(spread - np.eye(len(values))).max())
        whole = [s + SHIFT * n for s in sums]
        found = Components(n, whole, trace, values, directions, residuals, error)
    discard(spark, path)
    return found


def deviations(x: np.ndarray, n: int, shifted: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S (with S of x - SHIFT) as doubles, and the exact sums of their squares (None beyond a long)."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, shifted))
    kind = np.int64 if bound * bound * max(1, x.shape[1]) < 2**62 else object
    exact = x.astype(kind) * n - np.array(shifted, kind)
    squares = [int(s) for s in (exact * exact).sum(axis=1)]
    return exact.astype(np.float64), [s if s < 2**63 else None for s in squares]


def whitened(vectors: DataFrame, found: Components | None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = (
        f"{id_column} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shifted = [s - SHIFT * found.n for s in found.sums]
    onto = found.directions / np.sqrt(found.values)
    explained, dims, k = found.values / found.trace, len(onto), len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(begin, CHUNK)
                for own, x in integers(batch.column("vector")):
                    if x.shape[1] != dims:
                        continue
                    centred, squares = deviations(x, found.n, shifted)
                    z = centred / found.n @ onto
                    m = len(own)
                    yield pa.RecordBatch.from_pydict(
                        {
                            id_column: batch.column("id").take(pa.array(np.repeat(own, k))),
                            "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                            "n": pa.array(np.full(m * k, found.n, np.int64)),
                            "deviation": pa.array(squares, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                            "whitened": pa.array(z.ravel()),
                            "explained": pa.array(np.tile(explained, m)),
                            "identity_error": pa.array(np.full(m * k, found.identity_error)),
                        }
                    )

    rows = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Every vector on the leading components of all of them; see ``whitened``."""
    return whitened(vectors, fit(vectors, components=components))
