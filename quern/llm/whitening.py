"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each task turns its vectors into a sketch: how many, their exact sums, and the rows ``sigma * v`` of all singular values
and right singular vectors of the vectors about their own mean. Two sketches merge by stacking their rows and the one row
sqrt(n m / (n + m)) (mean - other mean), which accounts for the change of means, and decomposing the stack anew; no
singular value is cut, so merging loses nothing but rounding. Sketches of d rows at most are merged ``FAN_IN`` at a time,
in rounds, until one is left, which holds the covariance: its e = sigma^2 / n are the variances along its vectors.

Vectors enter as integers x = floor(scale * c) + offset, so that sums and deviations are exact.

Null and empty vectors, and those that hold a null, NaN or infinite entry, are dropped. Repeated vectors count as often as
they occur. Vectors of different lengths, and entries of which x would pass 2^53, raise ValueError. Null ids stay. An
empty table gives no rows. Components of equal variance may be any basis of their plane, as the data do not fix one.
Components without variance (not above rounding: fewer vectors than dimensions, or dependent ones) keep their rows:
``whitened`` is null, ``explained`` 0.0, or null if nothing varies, and ``identity_error`` covers the others, null if
there are none. Further columns are not read, so no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import written

#: Vectors decomposed at once, for each dimension; a task holds this many rows of d doubles.
BLOCK = 16
#: Sketches that one task merges, one after the other.
FAN_IN = 8
#: What a sketch is as a row: rows are the d-wide rows of ``sigma * v``, end to end.
SKETCH = "n long, sums array<decimal(38,0)>, rows array<double>"


@dataclass
class Sketch:
    """``n`` vectors: sums of each dimension (Python integers) and the rows that hold their scatter about the mean."""

    n: int
    sums: list[int]
    rows: np.ndarray

    def merged(self, other: Sketch) -> Sketch:
        """Both sets' sketch. The means' difference is taken of integers, so large offsets don't cost digits."""
        n = self.n + other.n
        apart = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums, strict=True)]) / (float(self.n) * float(other.n))
        correction = apart * np.sqrt(self.n / n * other.n)
        return Sketch(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], scatter(np.vstack([self.rows, other.rows, correction])))


def scatter(rows: np.ndarray) -> np.ndarray:
    """All singular values times their right vectors: at most d rows with the same Gram matrix."""
    _, sigma, v = np.linalg.svd(rows, full_matrices=False)
    return sigma[:, None] * v


def sketch(x: np.ndarray) -> Sketch:
    """The sketch of integer vectors."""
    first = x[0]
    near = x - first  # small integers, whose sums are exact
    shift = near.sum(0)
    return Sketch(len(x), [int(a) * len(x) + int(b) for a, b in zip(first, shift, strict=True)], scatter(near - shift / len(x)))


def integers(values: np.ndarray, scale: float, offset: int) -> np.ndarray:
    scaled = np.floor(values * scale)
    if len(scaled) and np.abs(scaled).max() + abs(offset) > 2.0**53:
        raise ValueError("an entry's integer passes 2^53")
    return scaled.astype(np.int64) + offset


def vectors(column: pa.Array) -> np.ndarray:
    """A matrix of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    widths = np.diff(np.asarray(column.offsets))
    if len(widths) and (widths != widths[0]).any():
        raise ValueError(f"vectors of {widths.min()} and {widths.max()} entries have no common covariance")
    return flat.reshape(len(column), -1)


def _batch(found: Sketch | None) -> Iterator[pa.RecordBatch]:
    if found is not None:
        sums = pa.array([found.sums], pa.list_(pa.decimal128(38, 0)))
        rows = pa.ListArray.from_arrays(pa.array([0, found.rows.size], pa.int32()), pa.array(found.rows.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([found.n]), sums, rows], names=["n", "sums", "rows"])


def _fold(found: Sketch | None, other: Sketch) -> Sketch:
    if found is None:
        return other
    if len(found.sums) != len(other.sums):
        raise ValueError(f"vectors of {len(found.sums)} and {len(other.sums)} entries have no common covariance")
    return found.merged(other)


def usable(vector: Column) -> Column:
    """Vectors that hold entries, all of them finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def fitted(rows: DataFrame, scale: float = 1024.0, offset: int = 100_000) -> Sketch | None:
    """The sketch of all of ``vector``; None without rows. Only this one sketch, d x d at most, comes to the driver."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            x = integers(vectors(batch.column(0)), scale, offset)
            step = max(1, BLOCK * x.shape[1]) if len(x) else 1
            for low in range(0, len(x), step):
                found = _fold(found, sketch(x[low : low + step]))
        yield from _batch(found)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for n, sums, held in zip(*(batch.column(name) for name in ("n", "sums", "rows")), strict=True):
                sums = [int(s) for s in sums.as_py()]
                found = _fold(found, Sketch(n.as_py(), sums, np.asarray(held.values).reshape(-1, len(sums))))
        yield from _batch(found)

    level = written(rows.select("vector").mapInArrow(sketched, SKETCH), "sketches")
    left = level.count()
    while left > 1:
        tasks = -(-left // FAN_IN)
        level = written(level.repartition(tasks).mapInArrow(together, SKETCH), "sketches")
        left = level.count()
    for r in level.collect():
        sums = [int(s) for s in r.sums]
        return Sketch(r.n, sums, np.array(r.rows).reshape(-1, len(sums)))
    return None


def components(found: Sketch, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors by falling eigenvalue, their eigenvalues (0.0 where not above rounding), and explained shares.

    Each vector's largest entry is positive.
    """
    d = len(found.sums)
    _, sigma, v = np.linalg.svd(np.vstack([found.rows, np.zeros((max(0, d - len(found.rows)), d))]), full_matrices=True)
    v = v * np.sign(v[np.arange(d), np.abs(v).argmax(1)])[:, None]
    sigma = np.where(sigma > sigma[0] * d * np.finfo(float).eps * 8, sigma, 0.0)
    e = sigma**2 / found.n
    return v[:most], e[:most], e[:most] / e.sum() if e.sum() > 0 else np.full(min(most, d), np.nan)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums of (n x - S)^2 over dimensions, exact at every size."""
    low, high = x.min(), x.max()
    most = max(max(abs(n * int(low) - s), abs(n * int(high) - s)) for s in sums)
    if most * most * len(sums) < 2**63:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(sums, object)
    return [int(r) for r in (d * d).sum(1)]


def whitened(table: DataFrame, most: int = 8, scale: float = 1024.0, offset: int = 100_000, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation (decimal), whitened, explained, identity_error."""
    spark = table.sparkSession
    rows = table.where(usable(F.col(vector))).select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    id_kind = rows.schema["vec_id"].dataType.simpleString()
    found = fitted(rows, scale, offset)
    kinds = f"vec_id {id_kind}, deviation decimal(38,0), w array<double>"
    if found is None:
        none = f"vec_id {id_kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], none)
    v, e, explained = components(found, most)
    n, sums = found.n, found.sums
    there = [k for k in range(len(e)) if e[k] > 0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [s // n for s in sums]
        rest = np.array([(s - b * n) / n for s, b in zip(sums, base, strict=True)])
        onto = v[there].T / np.sqrt(e[there])
        for batch in batches:
            x = integers(vectors(batch.column(1)), scale, offset)
            if not len(x):
                continue
            w = np.full((len(x), len(e)), np.nan)
            w[:, there] = ((x - np.array(base, np.int64)) - rest) @ onto
            values = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, len(e)), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x, n, sums), pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "w"])

    made = written(rows.mapInArrow(project, kinds), "whitened")
    pairs = list(combinations_with_replacement(there, 2))
    measured = made.select(*(F.abs(F.covar_pop(F.col("w")[a], F.col("w")[b]) - float(a == b)).alias(f"{a},{b}") for a, b in pairs)).first() if pairs else []
    error = F.lit(float(max(measured)) if pairs else None).cast("double")
    parts = F.array(*(F.lit(float(x) if x == x else None).cast("double") for x in explained))
    listed = made.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return listed.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", parts[F.col("k")].alias("explained"), error.alias("identity_error"))
