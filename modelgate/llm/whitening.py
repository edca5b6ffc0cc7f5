"""Embedding whitening by spectrum slicing.

A vector's entry c becomes the long x = floor(64 c) + 1 000 000. Sums and
centred products of the x are gathered by partial sums: each task adds up its
own rows, the few partial rows are summed by dimension, and only the d sums and
the d x d covariance (d: the vectors' dimension, not the number of vectors)
reach the driver. There the leading components are found by slicing the
spectrum: the inertia of the LDL^T factors of the shifted covariance counts the
eigenvalues above a shift, bisection by these counts isolates each leading
eigenvalue, Rayleigh quotient iteration takes it to double precision, and
counts on both sides of the result certify its number. A last pass projects
every vector; a pass before it measures the covariance of the projections.

Exactness: x, n and the sums are integers (sums of halves of 32 bits cannot
pass 64 bits); products are taken of differences to the rounded mean and summed in
doubles, which is exact as long as a sum stays below 2^53, and else rounded in
the last place; the remaining part of the mean is corrected exactly.

Edge cases: vectors that are null, empty or hold null, NaN or infinite entries
are left out, and so are entries whose x is no long; of vectors of several
lengths, those of the commonest length (the longer of tied ones) are kept and
the others left out. A component without variance has null ``whitened``
values (all of them when one vector, or only copies of one, remain). Repeated
rows count as often as they occur; null ids pass through; an empty table
gives an empty result. Eigenvalues that agree to 12 digits span a space in
which the components are one orthonormal choice. A ``deviation`` beyond a long
is null.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelgate.llm.common import cut, drop, fresh, map_in_arrow, quoted

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no x that is a long.
LIMIT = 2.0**57
#: An eigenvalue below this share of the largest counts as none.
NO_VARIANCE = 1e-13


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: the rows that hold only finite entries, their
    lengths, and the x of their entries one after another."""
    column = column.cast(pa.list_(pa.float64()))
    n = len(column)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null entries: NaN
    row = np.repeat(np.arange(n), sizes)
    bad = ~(np.abs(flat) < LIMIT)
    good = sizes > 0
    good[row[bad]] = False
    rows = np.flatnonzero(good)
    x = np.floor(SCALE * flat[good[row]]).astype(np.int64) + SHIFT
    return rows, sizes[rows], x


def _matrix(batch: pa.RecordBatch, column: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    rows, sizes, x = vectors(batch.column(column))
    fits = sizes == dims
    return rows[fits], x[np.repeat(fits, sizes)].reshape(-1, dims)


def _sums(df: DataFrame, column: str) -> tuple[int, int, list[int]]:
    """Dimension, number of vectors and exact sums by dimension."""
    schema = "size int, dim int, n long, high long, low long"

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            _, sizes, x = vectors(batch.column(column))
            for size in np.unique(sizes):
                part = x[np.repeat(sizes == size, sizes)].reshape(-1, size)
                high, low = (part >> 32).sum(axis=0), (part & 0xFFFFFFFF).sum(axis=0)
                seen = total.setdefault(int(size), [0, 0, 0])
                total[int(size)] = [seen[0] + len(part), seen[1] + high, seen[2] + low]
        for size, (n, high, low) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, size), pa.int32()), pa.array(np.arange(size), pa.int32()),
                 pa.array(np.full(size, n)), pa.array(high), pa.array(low)],
                names=["size", "dim", "n", "high", "low"],
            )

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    summed = map_in_arrow(df, run, schema).groupBy("size", "dim").agg(F.sum("n").alias("n"), whole("high"), whole("low"))
    summed = cut(summed, "sums")
    best = summed.where("dim = 0").orderBy(F.desc("n"), F.desc("size")).select("size").head()
    # as many rows as the commonest length has dimensions
    found = summed.where(F.col("size") == best["size"]).orderBy("dim").collect() if best else []
    drop(summed)
    if not found:
        return 0, 0, []
    return best["size"], found[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in found]


def _products(df: DataFrame, dims: int, block) -> np.ndarray:
    """Sum over all batches of ``block(batch)``, a dims x dims matrix: partial
    sums by task, then by row of the matrix."""

    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            total += block(batch)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["dim", "v"]
        )

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                total[dim] = total[dim] + v if dim in total else v
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["dim", "v"]
            )

    schema = "dim int, v array<double>"
    rows = map_in_arrow(map_in_arrow(df, run, schema).repartition("dim"), add, schema).collect()
    out = np.zeros((dims, dims))
    for r in rows:
        out[r["dim"]] = r["v"]
    return out


def covariance(df: DataFrame, column: str) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, exact sums by dimension, and the covariance of the
    x with divisor n."""
    dims, n, sums = _sums(df, column)
    if not n:
        return 0, [], np.zeros((0, 0))
    middle = [(2 * s + n) // (2 * n) for s in sums]  # rounded means
    centre = np.array(middle, dtype=np.int64)

    def block(batch):
        _, x = _matrix(batch, column, dims)
        d = (x - centre).astype(np.float64)
        return d.T @ d

    products = _products(df, dims, block)
    rest = [s - n * m for s, m in zip(sums, middle)]
    out = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = float((Fraction(products[i, j]) - Fraction(rest[i] * rest[j], n)) / n)
    return n, sums, out


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``: the positive
    ones among the 1 x 1 and 2 x 2 blocks of the LDL^T factors of
    ``matrix - shift I`` (Sylvester's law of inertia), with Bunch and Kaufman's
    choice of pivots."""
    a = matrix - shift * np.eye(len(matrix))
    alpha = (1 + 17**0.5) / 8
    positive, size = 0, len(a)
    tiny = np.finfo(float).tiny
    while size:
        column = np.abs(a[1:size, 0])
        largest = column.max() if size > 1 else 0.0
        pivot, wide = 0, False
        if abs(a[0, 0]) < alpha * largest:
            r = 1 + int(column.argmax())
            others = np.abs(a[:size, r])
            others[r] = 0
            reach = others.max()
            if abs(a[0, 0]) * reach < alpha * largest * largest:
                pivot, wide = r, abs(a[r, r]) < alpha * reach
        if not wide:
            if pivot:
                a[[0, pivot]] = a[[pivot, 0]]
                a[:, [0, pivot]] = a[:, [pivot, 0]]
            d = a[0, 0]
            if abs(d) < tiny:  # the whole column is zero: an eigenvalue at the shift
                a = a[1:, 1:]
                size -= 1
                continue
            positive += d > 0
            v = a[1:, 0]
            a = a[1:, 1:] - np.outer(v, v / d)
            size -= 1
        else:
            if pivot != 1:
                a[[1, pivot]] = a[[pivot, 1]]
                a[:, [1, pivot]] = a[:, [pivot, 1]]
            d = a[:2, :2]
            # such a block has a negative determinant: one eigenvalue on each side
            positive += 1 if d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0] < 0 else 2 * (d[0, 0] > 0)
            v = a[2:, :2]
            a = a[2:, 2:] - v @ np.linalg.solve(d, v.T)
            size -= 2
    return positive


class Spectrum:
    """Leading eigenpairs of a symmetric matrix by slicing its spectrum."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix = matrix
        radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
        # Gershgorin's bounds, and a margin for rounding
        self.scale = float(max(np.abs(np.diag(matrix) + radius).max(), np.abs(np.diag(matrix) - radius).max()))
        margin = self.scale * 1e-9 + np.finfo(float).tiny
        low, high = float((np.diag(matrix) - radius).min()) - margin, float((np.diag(matrix) + radius).max()) + margin
        self.counts = {low: len(matrix), high: 0}

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.matrix, shift)
        return self.counts[shift]

    def slice(self, k: int) -> tuple[float, float]:
        """The narrowest interval counted so far that holds the k-th eigenvalue (from 1, falling)."""
        low = max(s for s, c in self.counts.items() if c >= k)
        high = min(s for s, c in self.counts.items() if c < k and s > low)
        return low, high

    def leading(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``number`` largest eigenvalues, falling, and their unit vectors as columns."""
        n = len(self.matrix)
        values, found = [], np.zeros((n, 0))
        rng = np.random.default_rng(7)
        for k in range(1, number + 1):
            value, vector = self._pair(k, found, rng)
            values.append(value)
            found = np.column_stack([found, vector])
        return np.array(values), found

    def _pair(self, k: int, found: np.ndarray, rng) -> tuple[float, np.ndarray]:
        while True:
            low, high = self.slice(k)
            alone = self.counts[low] == k and self.counts[high] == k - 1
            narrow = high - low <= 1e-12 * self.scale
            if alone or narrow:
                value, vector = self._rayleigh((low + high) / 2, found, rng)
                step = 1e-12 * self.scale
                certified = narrow or (low <= value <= high)
                if certified and self.count(value - step) >= k and self.count(value + step) <= k - 1:
                    return value, vector
                if narrow:  # tied eigenvalues: the counts cannot tell them apart
                    return value, vector
            self.count((low + high) / 2)

    def _rayleigh(self, shift: float, found: np.ndarray, rng) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of a slice, two steps at
        the fixed shift first; found vectors are projected out."""
        v = self._unit(rng.standard_normal(len(self.matrix)), found)
        value = shift
        for step in range(12):
            v = self._unit(self._solve(shift if step < 2 else value, v), found)
            before, value = value, float(v @ self.matrix @ v)
            if step > 2 and abs(value - before) <= 1e-15 * self.scale:
                break
        return value, v

    def _solve(self, shift: float, v: np.ndarray) -> np.ndarray:
        shifted = self.matrix - shift * np.eye(len(v))
        bump = np.finfo(float).eps * self.scale
        while True:
            try:
                out = np.linalg.solve(shifted, v)
                if np.isfinite(out).all():
                    return out
            except np.linalg.LinAlgError:
                pass
            shifted += bump * np.eye(len(v))
            bump *= 2

    @staticmethod
    def _unit(v: np.ndarray, found: np.ndarray) -> np.ndarray:
        v = v / np.abs(v).max()
        for _ in range(2):
            v = v - found @ (found.T @ v)
            v = v / np.linalg.norm(v)
        return v


def components(matrix: np.ndarray, number: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and unit vectors (columns) of a covariance; the entry of
    the largest size in a vector is positive. Values without variance are 0."""
    number = min(number, len(matrix))
    if not np.abs(matrix).max(initial=0) > 0:
        return np.zeros(number), np.eye(len(matrix))[:, :number]
    values, found = Spectrum(matrix).leading(number)
    values[values <= NO_VARIANCE * values.max()] = 0
    found *= np.where(found[np.abs(found).argmax(axis=0), np.arange(number)] < 0, -1.0, 1.0)
    return values, found


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray | list]:
    """x - S/n as doubles, and the sum of (n x - S)^2 of every row, exact
    (None beyond a long)."""
    reach = int(np.abs(x).max(initial=0))
    if n * reach + max(map(abs, sums)) < 2**62:
        d = n * x - np.array(sums, dtype=np.int64)
        if int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2**63:
            return d / n, (d * d).sum(axis=1)
    exact = [[n * int(v) - s for v, s in zip(row, sums)] for row in x]
    squares = [sum(v * v for v in row) for row in exact]
    d = np.array([[v / n for v in row] for row in exact], dtype=np.float64).reshape(x.shape)
    return d, [s if s < 2**63 else None for s in squares]


def whiten(df: DataFrame, column: str = "embedding", number: int = COMPONENTS, keep: list[str] | None = None) -> DataFrame:
    """One row per kept vector and component (from 1): the columns of ``df``
    without the vector (or those in ``keep``), ``component``, ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``. Three passes
    that add up, one that writes; no vector is shuffled."""
    keep = [c for c in df.columns if c != column] if keep is None else keep
    only = df.select(quoted(column).alias("v"))
    n, sums, matrix = covariance(only, "v")
    names = []
    for base in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        taken = df.select(*[quoted(c) for c in keep]).toDF(*keep) if keep else df.select()
        names.append(fresh(taken, base))
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    body = fresh(df, "vector__")
    source = df.select(*[quoted(c) for c in keep], quoted(column).alias(body))
    schema = T.StructType(
        [f for f in source.schema.fields if f.name != body] + [T.StructField(c, t) for c, t in zip(names, kinds)]
    )
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    dims = len(sums)
    values, basis = components(matrix, number)
    number = len(values)
    live = values > 0
    scaled = basis / np.sqrt(np.where(live, values, 1.0))
    trace = float(np.trace(matrix))
    explained = values / trace if trace > 0 else np.full(number, np.nan)

    def project(batch, name):
        rows, x = _matrix(batch, name, dims)
        d, deviation = _centred(x, n, sums)
        return rows, d @ scaled, deviation

    def block(batch):
        w = project(batch, "v")[1]
        out = np.zeros((dims, dims))
        out[:number, :number] = w.T @ w
        return out

    # the whitened values have mean zero but for rounding, so this is their covariance
    measured = (_products(only, dims, block) / n)[:number, :number]
    error = float(np.abs(measured - np.eye(number))[np.ix_(live, live)].max(initial=0.0))

    def run(batches):
        for batch in batches:
            rows, w, deviation = project(batch, body)
            if not len(rows):
                continue
            count = len(rows)
            take = pa.array(np.repeat(rows, number))
            kept = [batch.column(i).take(take) for i, c in enumerate(batch.schema.names) if c != body]
            yield pa.RecordBatch.from_arrays(
                kept
                + [
                    pa.array(np.tile(np.arange(1, number + 1), count), pa.int32()),
                    pa.array(np.full(count * number, n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(count), number))),
                    pa.array(w.ravel(), mask=np.tile(~live, count)),
                    pa.array(np.tile(explained, count), mask=np.tile(np.isnan(explained), count)),
                    pa.array(np.full(count * number, error)),
                ],
                names=[c for c in batch.schema.names if c != body] + names,
            )

    return map_in_arrow(source, run, schema)
