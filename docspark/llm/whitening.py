"""Whitening of embeddings by their leading principal components.

Vectors become integers, so sums and deviations are exact. The covariance is never formed: each pass over the vectors
multiplies it with a block of a few columns, centred first, and Chebyshev's recurrence over such passes damps
all of the spectrum but its top. After each filter the block is orthonormalised and projected (QR, Rayleigh-Ritz) until the
residuals of the wanted components certify them. Tasks send sums of blocks of columns, whose size hangs on the dimension alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors of a stored block.
BLOCK_ROWS = 2048
#: What one filter may gain: more would lose the weaker columns of the block to rounding.
GAIN = 1e8
#: Residuals, as shares of the largest eigenvalue: certified once they no longer fall, and at rounding at once.
CERTIFIED, EXACT = 1e-12, 1e-14

OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Of the integer vectors: number, sums by dimension, and the largest absolute entry of n * x - S."""

    n: int
    sums: list[int]
    widest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part of the mean is taken off as an integer, so nothing cancels in floating point."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)^2, exactly; an error if one doesn't fit a long."""
        if len(self.sums) * self.widest**2 < 2**63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1)
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        if max(exact) >= 2**63:
            raise OverflowError("a deviation doesn't fit a long")
        return np.array(exact, np.int64)


def integer_blocks(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``ids, x, rows, dims``: blocks of floor(scale * entry) + shift, written once and read by every pass.

    Rows whose vector is null or empty or has a null, NaN or infinite entry are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(F.coalesce(finite, F.lit(False)))

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                vectors = part.column("v")
                sizes = np.diff(vectors.offsets.to_numpy())
                if (sizes != sizes[0]).any():
                    raise ValueError("vectors differ in length")
                x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False)) + shift
                if (np.abs(x) >= 2.0**52).any():
                    raise OverflowError("an entry is too large for exact integers")
                ids = part.column("id").fill_null(0).to_numpy().tobytes(), part.column("id").is_null().to_numpy(zero_copy_only=False).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (ids[0], ids[1], x.astype("<i8").tobytes(), len(sizes), int(sizes[0]))], ["ids", "no_id", "x", "rows", "dims"])

    return cut(kept.mapInArrow(pack, "ids binary, no_id binary, x binary, rows long, dims long"))


def _matrices(batches):
    for batch in batches:
        for x, dims in zip(batch.column("x"), batch.column("dims").to_pylist(), strict=True):
            yield np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dims)


def moments(blocks: DataFrame) -> Moments | None:
    """One pass; None if there are no vectors. The driver gets a row for each dimension."""

    def add(batches):
        total = None
        for x in _matrices(batches):
            now = np.array([x.sum(axis=0), x.min(axis=0), x.max(axis=0), np.full(x.shape[1], len(x))])
            if total is None:
                total = now
            elif total.shape != now.shape:
                raise ValueError("vectors differ in length")
            else:
                total[0] += now[0]
                total[3] += now[3]
                total[1], total[2] = np.minimum(total[1], now[1]), np.maximum(total[2], now[2])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *(pa.array(t) for t in total)], ["dim", "s", "low", "high", "n"])

    found = blocks.select("x", "dims").mapInArrow(add, "dim long, s long, low long, high long, n long")
    found = found.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    dims = sorted(found.collect(), key=lambda r: r["dim"])
    if not dims:
        return None
    if len({r["n"] for r in dims}) > 1:
        raise ValueError("vectors differ in length")
    n, sums = dims[0]["n"], [int(r["s"]) for r in dims]
    return Moments(n, sums, max(max(n * r["high"] - s, s - n * r["low"]) for r, s in zip(dims, sums, strict=True)))


def summed(blocks: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all vectors of ``of(x)`` (an array of ``shape`` for a block's matrix).

    A task sends one array; those of about the root of the number of tasks meet in a second step, so the driver adds few.
    """

    def add(batches):
        total = None
        for x in _matrices(batches):
            total = of(x) if total is None else total + of(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, "<f8").tobytes()])], ["sums"])

    def merge(batches):
        total = None
        for batch in batches:
            for b in batch.column("sums"):
                now = np.frombuffer(b.as_buffer(), "<f8")
                total = now.copy() if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    parts = blocks.select("x", "dims").mapInArrow(add, "sums binary")
    tasks = blocks.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(merge, "sums binary")
    total = np.zeros(math.prod(shape))
    for r in parts.collect():
        total += np.frombuffer(bytes(r["sums"]), "<f8")
    return total.reshape(shape)


def leading(blocks: DataFrame, m: Moments, k: int, most_rounds: int = 60, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``k`` eigenvalues of the covariance and their unit vectors (columns), by Chebyshev-filtered subspace iteration.

    The block holds 3 k further columns, 16 at least. Its smallest Ritz value ends the interval that a filter damps; the interval
    begins at 0, since no eigenvalue is below. The last column is drawn anew each time, so no direction stays unseen. Raises
    if the residuals aren't certified after ``most_rounds`` filters.
    """
    d = len(m.sums)
    k = min(k, d)
    width = min(d, k + max(16, 3 * k))
    random = np.random.default_rng(seed)

    def times(q: np.ndarray) -> np.ndarray:
        def of(x):
            c = m.centred(x)
            return c.T @ (c @ q)

        return summed(blocks, of, q.shape) / m.n

    q = np.linalg.qr(random.standard_normal((d, width)))[0]
    last = math.inf
    for _ in range(most_rounds):
        aq = times(q)
        values, turn = np.linalg.eigh((q.T @ aq + aq.T @ q) / 2)
        order = np.argsort(values)[::-1]
        values, u, au = values[order], q @ turn[:, order], aq @ turn[:, order]
        top = max(values[0], 0.0)
        residuals = np.linalg.norm(au[:, :k] - u[:, :k] * values[:k], axis=0)
        worst = residuals.max()
        if worst <= EXACT * top or worst <= CERTIFIED * top and worst > last / 2:
            return values[:k], u[:, :k]
        last = worst
        if width < d:
            done = int(np.argmax(residuals > EXACT * top))  # leading columns that are exact leave the filter
            high = max(values[-1], top * 1e-12)
            u[:, -1] = random.standard_normal(d)
            u = np.concatenate([u[:, :done], filtered(times, u[:, done:], u[:, :done], high, values[done] / high, values[k - 1] / high)], axis=1)
        q = np.linalg.qr(u)[0]
    raise ArithmeticError(f"components not certified: residual {last:.3g} of {top:.3g}")


def filtered(times, columns: np.ndarray, done: np.ndarray, high: float, first: float, wanted: float) -> np.ndarray:
    """Chebyshev's polynomial of the covariance times ``columns``, damping eigenvalues from 0 to ``high``, without the directions ``done``.

    ``first`` and ``wanted`` are the largest and the last wanted eigenvalue over ``high``. The degree gives the last
    one ``GAIN``, and the largest no more than that above it, lest rounding in its direction bury the others.
    """
    grows = [math.acosh(max(2 * x - 1, 1 + 1e-9)) for x in (first, wanted)]
    degree = min(math.log(2 * GAIN) / grows[1], math.log(GAIN) / max(grows[0] - grows[1], 1e-9), 40)
    half = high / 2

    def step(y: np.ndarray) -> np.ndarray:
        out = (times(y) - half * y) / half
        return out - done @ (done.T @ out)

    before = columns - done @ (done.T @ columns)
    now = step(before)
    for _ in range(max(2, math.ceil(degree)) - 1):
        before, now = now, 2 * step(now) - before
        size = np.linalg.norm(now, axis=0)
        before, now = before / size, now / size  # a column's scale doesn't matter to its recurrence
    return now


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

    Vectors that are null, empty or not finite have no rows; repeated ids and equal vectors have rows each, null ids stay null; other
    columns are not read. Components without variance (rounding apart) can't be scaled and are left out, so equal vectors, one
    vector or an empty table give no rows. Vectors of different lengths raise an error. ``explained`` is the component's share of all
    variance, ``identity_error`` the largest absolute entry of the whitened values' covariance minus the identity.
    """
    spark = rows.sparkSession
    blocks = integer_blocks(rows, id_col, vector_col)
    m = moments(blocks)
    if m is None or m.widest == 0:
        return spark.createDataFrame([], OUTPUT)
    trace = float(summed(blocks, lambda x: np.array([(m.centred(x) ** 2).sum()]), (1,))[0]) / m.n
    values, vectors = leading(blocks, m, components)
    k = int((values > 1e-12 * values[0]).sum())
    scaled, share, n = vectors[:, :k] / np.sqrt(values[:k]), values[:k] / trace, m.n

    def with_ones(x):
        y = m.centred(x) @ scaled
        return np.concatenate([y.T @ y, y.sum(axis=0)[None]])

    sums = summed(blocks, with_ones, (k + 1, k)) / n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            for r, x in enumerate(_matrices([batch])):
                ids = np.frombuffer(batch.column("ids")[r].as_buffer(), "<i8")
                missing = np.frombuffer(batch.column("no_id")[r].as_buffer(), bool)
                size = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids, k), mask=np.repeat(missing, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n)),
                        pa.array(np.repeat(m.deviations(x), k)), pa.array((m.centred(x) @ scaled).ravel()), pa.array(np.tile(share, size)), pa.array(np.full(size * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return blocks.select("ids", "no_id", "x", "dims").mapInArrow(project, OUTPUT)
