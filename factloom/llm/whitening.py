"""Leading principal directions of vectors on a grid, and the vectors whitened along them.

A vector's entries become whole numbers, floor(scale * c). The covariance is over each distinct grid vector once; its leading
eigenvectors come from Chebyshev-filtered subspace iteration: a random block of directions is filtered by a polynomial
of the covariance, a three-term recurrence whose every step is one distributed pass over the centred vectors (each
task adds up Xᵀ(XQ) of its own), which damps what lies below the block's smallest Ritz value and lifts what lies above. QR and
Rayleigh-Ritz follow, until the residuals of the wanted pairs are certified. A block that converges slowly is doubled; at the
full dimension Rayleigh-Ritz is exact, so the iteration ends for any spectrum. The d x block matrices are all that leaves the tasks.

Vectors that are null or hold null or non-finite entries take no part. All others must have one length, else ValueError.
Repeated vectors count once for the fit and each row gets its result; a null key is a key like others. Grid values saturate at the range of a
long, and a deviation beyond that range is null. Directions whose eigenvalue is below ``FLAT`` of the largest have no
whitened value and no row: with one distinct vector there is no row at all. An empty table gives none. Other columns aren't read.
"""

from __future__ import annotations

import dataclasses
import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.tables import kept

#: Directions that are iterated, degree of the polynomial, residual of a certified pair and eigenvalue that counts as 0, both against the largest eigenvalue.
BLOCK, DEGREE, RESIDUAL, FLAT = 32, 16, 1e-13, 1e-10
#: Grid vectors of a stored row; results of tasks that the driver adds up by itself.
ROWS, FAN = 4096, 64


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return df.filter(F.col(vector).isNotNull() & finite)


def _matrix(column: pa.Array, scale: float) -> np.ndarray:
    held = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(all="ignore"):
        x = np.floor(held * scale)
    top = x >= 2.0 ** 63  # saturate; below, the cast does it
    out = np.where(top, 0, np.maximum(x, -(2.0 ** 63))).astype(np.int64)
    out[top] = np.iinfo(np.int64).max
    return out.reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def distinct_grid(df: DataFrame, vector: str, scale: float) -> DataFrame:
    """(rows, data): the distinct grid vectors, ROWS at a time."""

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                yield pa.RecordBatch.from_arrays([_bytes(_matrix(batch.column(0).slice(i, 1 << 14), scale))], names=["x"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.column(0).slice(i, ROWS)
                data = b"".join(some.to_pylist())
                x = np.frombuffer(data, np.int64)
                narrow = len(x) > 0 and max(abs(int(x.min())), abs(int(x.max()))) < 1 << 31
                yield pa.RecordBatch.from_pydict({"rows": pa.array([len(some)], pa.int32()), "narrow": [narrow], "data": pa.array([x.astype(np.int32).tobytes() if narrow else data], pa.binary())})

    x = df.select(F.col(vector).cast("array<double>")).mapInArrow(grid, "x binary").distinct()
    return x.mapInArrow(blocks, "rows int, narrow boolean, data binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, narrow, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            yield np.frombuffer(data.as_buffer(), np.int32 if narrow else np.int64).reshape(rows, -1)


def added_up(blocks: DataFrame, of: Callable, tasks: int | None = None):
    """(sum over all blocks of ``of(block)``, a tuple; how many tasks there were). The driver gets FAN values at most."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches):
            made = of(x)
            total = made if total is None else tuple(a + b for a, b in zip(total, made))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"tasks": pa.array([1]), "value": pa.array([pickle.dumps(total)], pa.binary())})

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tasks = None, 0
        for batch in batches:
            for n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made, tasks = pickle.loads(value), tasks + n
                total = made if total is None else tuple(a + b for a, b in zip(total, made))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"tasks": pa.array([tasks]), "value": pa.array([pickle.dumps(total)], pa.binary())})

    made = blocks.mapInArrow(part, "tasks long, value binary")
    if tasks is None or tasks > FAN:
        made = made.repartition(FAN if tasks else 8).mapInArrow(whole, "tasks long, value binary")
    found = made.collect()
    values = [pickle.loads(r.value) for r in found]
    return (tuple(sum(v[1:], v[0]) for v in zip(*values)) if values else None), sum(r.tasks for r in found)


def _exact(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of squares), whole numbers without a bound."""
    most = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    x = x.astype(np.int64 if most * most * len(x) < 1 << 62 else object)
    return len(x), x.sum(axis=0).astype(object), (x * x).sum(axis=0).astype(object)


@dataclasses.dataclass(frozen=True)
class Whitening:
    """What ``fitted`` has found. ``basis``: d x components; ``residuals``: of the pairs, against the largest eigenvalue."""

    scale: float
    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis / np.sqrt(self.values)


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors; residual norms) of the ``wanted`` leading pairs of a symmetric matrix without
    negative eigenvalues that is known by its product with a block of vectors."""
    rnd, block = np.random.default_rng(20), min(dim, max(block, wanted))
    q = np.linalg.qr(rnd.standard_normal((dim, block)))[0]
    last = math.inf
    while True:
        w = product(q)
        values, turn = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        residuals = np.linalg.norm(w - q * values, axis=0)[:wanted]
        top, now = max(values[0], 0.0), float(residuals.max())
        if now <= RESIDUAL * top or block == dim:
            return values[:wanted], q[:, :wanted], residuals
        if now > last / 8:  # too slow for this block
            block = min(dim, 2 * block)
        last = now
        # the filter maps [0, edge] to [-1, 1] and is scaled to 1 at the top
        half = max(values[-1], 1e-9 * top) / 2
        first = sigma = half / (top - half)
        before, y = q, (w - half * q) * (sigma / half)
        for _ in range(degree - 1):
            sigma, old = 1 / (2 / first - sigma), sigma
            before, y = y, (product(y) - half * y) * (2 * sigma / half) - before * (old * sigma)
        q = np.linalg.qr(np.concatenate([y, rnd.standard_normal((dim, block - y.shape[1]))], axis=1))[0]


def fitted(df: DataFrame, vector: str, components: int, scale: float = 256.0, block: int = BLOCK, degree: int = DEGREE) -> Whitening | None:
    """The whitening of ``df``, which must be a stored table; None where it has no vector that takes part or no direction."""
    held = usable(df, vector)
    sizes = [r[0] for r in held.select(F.size(vector)).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} entries")
    if not sizes or sizes[0] == 0:
        return None
    blocks = kept(distinct_grid(held, vector, scale), "whitening-vectors")
    (n, sums, squares), tasks = added_up(blocks, _exact)
    sums = [int(s) for s in sums]
    # exact until the one division
    trace = sum(n * int(q) - s * s for q, s in zip(squares, sums)) / (n * n)
    if trace == 0:
        return None
    mean, passes = np.array([s / n for s in sums]), 0

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def of(x: np.ndarray) -> tuple[np.ndarray]:
            x = x - mean
            return (x.T @ (x @ q),)

        return added_up(blocks, of, tasks)[0][0] / n

    values, basis, residuals = leading(product, len(sums), components, block, degree)
    keep = values > FLAT * values[0]
    made = Whitening(scale, n, sums, basis[:, keep], values[keep], trace, residuals[keep] / values[0], passes, math.nan)

    def covered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = made.whiten(x)
        return w.sum(axis=0), w.T @ w

    first, second = added_up(blocks, covered, tasks)[0]
    error = np.abs(second / n - np.outer(first / n, first / n) - np.eye(len(first))).max()
    return dataclasses.replace(made, identity_error=float(error))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - sum)², exact; None beyond a long."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    kind = np.int64 if most * most * len(sums) < 1 << 62 else object
    far = n * x.astype(kind) - np.array(sums, kind)
    return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1).tolist()]


def whitened(df: DataFrame, key: str, vector: str, made: Whitening | None) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, residual) of each row that takes part and each component."""
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
              *(T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error", "residual"))]
    if made is None:
        return df.sparkSession.createDataFrame([], T.StructType(fields))
    k = len(made.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                x = _matrix(batch.column(1), made.scale)
                rows, each = np.repeat(np.arange(len(x)), k), lambda v: pa.array(np.tile(v, len(x)))  # noqa: B023
                far = pa.array(deviations(x, made.n, made.sums), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(rows), made.n)), far.take(pa.array(rows)),
                    pa.array(made.whiten(x).ravel()), each(made.values / made.trace), pa.array(np.full(len(rows), made.identity_error)), each(made.residuals)], names=[f.name for f in fields])

    return usable(df, vector).select(key, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(run, T.StructType(fields))
