"""Embedding whitening: leading eigenpairs of the covariance by spectrum slicing and Rayleigh quotient iteration.

Vectors are put on a grid of whole numbers, so sums, products of centred entries and deviations are exact and do not
depend on the order in which partitions are added. Of the covariance, a dimensions x dimensions matrix, the driver finds
the leading eigenpairs: the signs of an LDL^T factorisation of V - s I count the eigenvalues below s, bisection on these
counts isolates each one, Rayleigh quotient iteration from inside its slice converges, and counts on both sides of the
result certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common

#: Sums of products of whole numbers are exact in double precision below this.
EXACT = 1 << 53
LONG = (1 << 63) - 1
#: Partial sums meet in so many tasks before they go to the driver.
MEETING = 16
#: Vectors worked on at once.
CHUNK = 4_096
FITTED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
KINDS = {b"s": np.dtype("<i2"), b"i": np.dtype("<i4"), b"l": np.dtype("<i8")}


@dataclass(frozen=True)
class Settings:
    """``components``: most components; ``grid``: steps of the grid between 0 and 1."""

    components: int = 4
    grid: int = 256


def on_grid(column: pa.Array, width: int, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``width`` finite entries, and these rows on the grid. Entries that no long can hold make a row unusable."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    full = column.filter(pa.array(lengths == width))
    entries = full.flatten()
    values = np.asarray(entries.fill_null(float("nan")), np.float64).reshape(len(full), width)
    steps = np.floor(values * grid)
    good = (np.abs(steps) < 2.0 ** 62).all(axis=1)
    usable = lengths == width
    usable[usable] = good
    return usable, steps[good].astype(np.int64)


def coded(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the smallest kind of number that holds it; equal rows have equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -1 - x.min(axis=1, initial=0))
    kinds = np.where(most < 1 << 15, b"s", np.where(most < 1 << 31, b"i", b"l"))
    return [kind + row.astype(KINDS[kind]).tobytes() for kind, row in zip(kinds.tolist(), x, strict=True)]


def decoded(blobs: list[bytes], width: int) -> np.ndarray:
    return np.array([np.frombuffer(b, KINDS[b[:1]], width, 1) for b in blobs], np.int64).reshape(len(blobs), width)


def grid_rows(batches: Iterator[pa.RecordBatch], width: int, s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(coded(on_grid(batch.column(0), width, s.grid)[1]), pa.binary())], names=["x"])


def whole(numbers: np.ndarray) -> bytes:
    """Whole numbers of any size as text."""
    return ",".join(map(str, numbers.ravel().tolist())).encode()


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the sum of rows of whole numbers."""
    total = None
    for batch in batches:
        for blob in batch.column("sums").to_pylist():
            numbers = np.array([int(v) for v in blob.split(b",")], object)
            total = numbers if total is None else total + numbers
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([whole(total)])], names=["sums"])


def total_of(partial: DataFrame) -> list[int]:
    """The sum of one row of whole numbers per partition, by way of a few tasks."""
    met = partial.select("sums").repartition(MEETING, F.col("sums")).mapInArrow(added, "sums binary")
    found = [np.array([int(v) for v in r.sums.split(b",")], object) for r in met.collect()]
    return sum(found[1:], found[0]).tolist() if found else []


def chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for a in range(0, len(batch), CHUNK):
            yield decoded(batch.column(0).slice(a, CHUNK).to_pylist(), width)


def column_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Number of vectors and sum of each dimension."""
    total = np.zeros(1 + width, object)
    for x in chunks(batches, width):
        low = np.abs(x).max(initial=0) < LONG // CHUNK
        total += np.append(len(x), (x if low else x.astype(object)).sum(axis=0).astype(object))
    if total[0]:
        yield pa.RecordBatch.from_arrays([pa.array([whole(total)])], names=["sums"])


def product_sums(batches: Iterator[pa.RecordBatch], centre: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Sums of the entries and of the products of entries, less ``centre``."""
    first, second, seen = np.zeros(width, object), np.zeros((width, width), object), False
    for x in chunks(batches, width):
        y, seen = x - centre, True
        most = int(np.abs(y).max(initial=0))
        if most * most * len(y) < EXACT:
            y = y.astype(np.float64)
            first += y.sum(axis=0).astype(np.int64).astype(object)
            second += (y.T @ y).astype(np.int64).astype(object)
        else:
            y = y.astype(object)
            first, second = first + y.sum(axis=0), second + y.T.dot(y)
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([whole(np.concatenate([first, second.ravel()]))])], names=["sums"])


def below(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` less than ``shift``: negative pivots of P (V - shift I) P^T = L D L^T, with pivots
    of one or two rows, the larger choice at each step, so that no small pivot is divided by."""
    a = v - shift * np.eye(len(v))
    count = 0
    while len(a):
        n = len(a)
        diagonal = np.abs(a.diagonal())
        off = np.abs(a - np.diag(a.diagonal()))
        i = int(np.argmax(diagonal))
        r, c = divmod(int(np.argmax(off)), n)
        if off[r, c] == 0:
            return count + int((a.diagonal() < 0).sum())
        if diagonal[i] >= 0.6404 * off[r, c]:
            pivot, rows = a[i, i], [i]
            count += int(pivot < 0)
        else:
            # A two-row pivot dominated by its off-diagonal entry has one eigenvalue of each sign.
            rows = [r, c]
            count += 1
        rest = np.delete(np.arange(n), rows)
        cross = a[np.ix_(rest, rows)]
        a = a[np.ix_(rest, rest)] - cross @ np.linalg.solve(a[np.ix_(rows, rows)], cross.T)
        a = (a + a.T) / 2
    return count


def rayleigh(v: np.ndarray, low: float, high: float, found: list[np.ndarray], tolerance: float) -> tuple[float, np.ndarray]:
    """An eigenpair by Rayleigh quotient iteration that starts in the middle of a slice, apart from the vectors ``found``."""
    n = len(v)
    rng = np.random.default_rng(n + len(found))
    shift, q = (low + high) / 2, rng.standard_normal(n)

    def apart(q: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for f in found:
                q = q - (f @ q) * f
        return q / np.linalg.norm(q)

    def steps(shift: float, q: np.ndarray) -> Iterator[tuple[float, np.ndarray, float]]:
        """Eigenpairs with their residuals, each from a solve with the last quotient as shift."""
        for step in range(40):
            for nudge in (0, tolerance, -tolerance):
                try:
                    q = apart(np.linalg.solve(v - (shift + nudge) * np.eye(n), q))
                    break
                except np.linalg.LinAlgError:
                    continue
            value = float(q @ v @ q)
            yield value, q, float(np.linalg.norm(v @ q - value * q))
            # The first steps are inverse iteration inside the slice, until the quotient lies in it.
            if step > 1 and low <= value <= high:
                shift = value

    best = (0.0, q, np.inf)
    for pair in steps(shift, apart(q)):
        # Once converged, steps go on as long as they still halve the residual.
        if best[2] <= tolerance and pair[2] > best[2] / 2:
            break
        best = pair
    return best[:2]


def leading(v: np.ndarray, components: int) -> list[tuple[float, np.ndarray]]:
    """The largest eigenvalues and their vectors (largest entry positive), by falling eigenvalue, as certified by counts."""
    n = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) if n else 0.0
    if not norm:
        return []
    v, tolerance = v / norm, 8 * n * np.finfo(float).eps
    pairs: list[tuple[float, np.ndarray]] = []
    for number in range(1, min(components, n) + 1):
        # Exactly ``number`` eigenvalues are at least e, so n - number lie below it.
        low, high, at_low, at_high = -1.0 - tolerance, 1.0 + tolerance, 0, n
        while True:
            isolated = (at_low, at_high) == (n - number, n - number + 1)
            if isolated or high - low <= tolerance:
                value, vector = rayleigh(v, low, high, [q for _, q in pairs], tolerance)
                certain = below(v, value - 4 * tolerance) <= n - number < below(v, value + 4 * tolerance)
                if certain or high - low <= tolerance:
                    break
            middle = (low + high) / 2
            count = below(v, middle)
            if count <= n - number:
                low, at_low = middle, count
            else:
                high, at_high = middle, count
        pairs.append((value * norm, vector * np.sign(vector[np.argmax(np.abs(vector))])))
    return pairs


@dataclass(frozen=True)
class Fit:
    """What whitens a vector: count and sums of the distinct vectors, axes (component x dimension), eigenvalues, trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows along the axes, of variance 1; nan where the variance is 0."""
        centre = [s // self.n for s in self.sums]
        rest = np.array([float(Fraction(s - c * self.n, self.n)) for s, c in zip(self.sums, centre, strict=True)])
        least = 64 * len(rest) * np.finfo(float).eps * self.trace
        scale = np.array([1 / np.sqrt(e) if e > least else np.nan for e in self.values])
        return ((x - np.array(centre, np.int64)) - rest) @ self.axes.T * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null beyond the longs."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if most * most * x.shape[1] <= LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()
        return [e if e <= LONG else None for e in exact]


def whitened_moments(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened entries and of their products."""
    k = len(fit.values)
    first, second = np.zeros(k), np.zeros((k, k))
    for x in chunks(batches, len(fit.sums)):
        w = fit.whitened(x)
        first, second = first + w.sum(axis=0), second + w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second.ravel()]).tolist()])], names=["moments"])


def fitted(distinct: DataFrame, width: int, s: Settings) -> Fit | None:
    """Moments of the distinct vectors and the leading eigenpairs of their covariance; none without a vector."""
    sums = total_of(distinct.mapInArrow(lambda b: column_sums(b, width), "sums binary"))
    if not sums:
        return None
    n, sums = sums[0], sums[1:]
    # Products are taken of entries less the mean, rounded; what the rounding left is taken off exactly.
    centre = np.array([(2 * v + n) // (2 * n) for v in sums], np.int64)
    moments = total_of(distinct.mapInArrow(lambda b: product_sums(b, centre, width), "sums binary"))
    first, second = moments[:width], moments[width:]
    v = np.array([[float(Fraction(n * second[i * width + j] - first[i] * first[j], n * n)) for j in range(width)] for i in range(width)])
    pairs = leading(v.reshape(width, width), s.components)
    k = min(s.components, width)
    axes = np.array([q for _, q in pairs]) if pairs else np.eye(width)[:k]
    return Fit(n, tuple(sums), axes, np.array([e for e, _ in pairs] or [0.0] * k), float(np.trace(v)))


def whitened_rows(batches: Iterator[pa.RecordBatch], held, s: Settings) -> Iterator[pa.RecordBatch]:
    fit, error = held.value
    k = len(fit.values)
    explained = fit.values / fit.trace if fit.trace else np.full(k, np.nan)
    for batch in batches:
        for a in range(0, len(batch), CHUNK):
            part = batch.slice(a, CHUNK)
            usable, x = on_grid(part.column(1), len(fit.sums), s.grid)
            rows = len(x)
            ids = part.column(0).filter(pa.array(usable)).take(pa.array(np.repeat(np.arange(rows), k)))
            deviations = np.repeat(np.array(fit.deviations(x), object), k)
            nullable = lambda values: pa.array(values, pa.float64(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fit.n)), pa.array(deviations.tolist(), pa.int64()),
                 nullable(fit.whitened(x).ravel()), nullable(np.tile(explained, rows)), nullable(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whitened_embeddings(embeddings: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per usable row of ``embeddings`` (vec_id, embedding) and component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    The model is fitted on each distinct vector once, so copies of a vector weigh no more than the vector; every row is
    whitened. Vectors that are null or empty, or hold a null, infinite or undefined entry, or one of 2^62 steps of the
    grid or more, are left out, as are those whose length is not the most frequent one (of equally frequent ones the
    longest). Null vec_ids and repeated rows are whitened like any others; other columns are ignored. A component
    without variance (fewer distinct vectors than components, constant entries) has a null ``whitened`` and counts
    nothing in identity_error, which is null if no component has any; explained is null if there is no variance at all.
    Axes of equal eigenvalues are any basis of their space. deviation is null beyond the longs. Without a usable row
    the result is empty.
    """
    s, spark = settings, embeddings.sparkSession
    common.on_workers(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    lengths = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("width")).count()
    common_length = lengths.orderBy(F.desc("count"), F.desc("width")).first()
    if common_length is None:
        return spark.createDataFrame([], FITTED)
    width = common_length.width
    distinct = common.stored(rows.select("embedding").mapInArrow(lambda b: grid_rows(b, width, s), "x binary").distinct(), "grid-vectors")
    fit = fitted(distinct, width, s)
    if fit is None:
        return spark.createDataFrame([], FITTED)
    moments = distinct.mapInArrow(lambda b: whitened_moments(b, fit), "moments array<double>")
    k = len(fit.values)
    sums = moments.select(F.posexplode("moments")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
    second = np.array([r.s for r in sums][k:]).reshape(k, k) / fit.n - np.outer(*[np.array([r.s for r in sums][:k]) / fit.n] * 2)
    off = np.abs(second - np.eye(k))
    error = None if np.isnan(off).all() else float(np.nanmax(off))
    held = spark.sparkContext.broadcast((fit, error))
    return rows.mapInArrow(lambda b: whitened_rows(b, held, s), FITTED)
