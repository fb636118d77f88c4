"""Principal components by randomised subspace iteration.

Points stay where they are.  A pass multiplies them by a narrow matrix V (dim x width), which every task holds, and folds
the products: their QR factors, width x width, are stacked and factored again in a task and then along a tree over tasks
(TSQR), and the sums of point times product are merged in dense blocks.  With Q R the factored products, sums times the
inverse of R are the points' matrix times Q, whose orthonormal columns are the next V.  So the driver holds dim x width
numbers and never a dim x dim table, and no task holds more than that beside a batch.

Defined results: null vectors are left out; vectors that differ in length from *dim* raise; without points or spread
all variances are 0.  The axes' signs make the coordinate of greatest magnitude positive, the first among equals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import dense

#: Columns of V beyond the components asked for, passes at most, and the relative change of a variance that ends them.
OVERSAMPLE, PASSES, TOLERANCE = 48, 60, 1e-10


@dataclass
class Components:
    mean: np.ndarray
    axes: np.ndarray  # a row for each component
    variances: np.ndarray
    total: float  # the sum of the variances of all coordinates
    n: int

    @property
    def shares(self) -> np.ndarray:
        return np.clip(self.variances, 0, None) / max(self.total, 1e-30)


def _matrices(batches: Iterator[pa.RecordBatch], dim: int, mean: np.ndarray) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            flat, ends = dense.vectors(batch.column(0))
            if (np.diff(ends) != dim).any():
                raise ValueError(f"a vector is not {dim} long")
            yield flat.reshape(-1, dim) - mean


def _factor(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """R of the rows that *r* stands for and *rows*."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def stacked(factors: DataFrame, width: int) -> np.ndarray:
    """R of all rows of the tasks' factors (r), by a tree: those of a part meet first, then the parts'."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for k in range(batch.num_rows):
                r = _factor(r, dense.vectors(batch.column("r").slice(k, 1))[0].reshape(-1, width))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    parts = factors.repartition(F.spark_partition_id() % dense.FAN).mapInArrow(fold, "r array<double>")
    r = None
    for row in parts.collect():  # at most FAN factors of width x width
        r = _factor(r, np.array(row["r"], float).reshape(-1, width))
    r = np.zeros((0, width)) if r is None else r
    return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r


def _pass(points: DataFrame, dim: int, mean: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(R of the products, sums of point times product, sum of squared lengths) of one pass."""
    width = v.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, w, squares = None, np.zeros((dim, width)), 0.0
        for x in _matrices(batches, dim, mean):
            y = x @ v
            r, squares = _factor(r, y), squares + float((x * x).sum())
            w += x.T @ y
        if r is not None:
            cut = [w.ravel()[a : a + dense.BLOCK].tolist() for a in range(0, w.size, dense.BLOCK)]
            kinds, values = ["w"] * len(cut) + ["r", "s"], [*cut, r.ravel().tolist(), [squares]]
            offsets = [k * dense.BLOCK for k in range(len(cut))] + [0, 0]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(offsets), pa.array([1] * len(kinds)), pa.array(values, pa.list_(pa.float64()))], names=["kind", "offset", "n", "x"])

    # What tasks send is used twice; it is kept, not found again by a second pass over the points.
    sent = points.mapInArrow(multiply, "kind string, offset long, n long, x array<double>").persist()
    try:
        merged = dense.merged(sent.where("kind <> 'r'").select("kind", "offset", "n", "x"), ("kind",), ["x"]).collect()
        r = stacked(sent.where("kind = 'r'").select(F.col("x").alias("r")), width)
    finally:
        sent.unpersist()
    w, squares = np.zeros(dim * width), 0.0
    for row in merged:
        if row["kind"] == "s":
            squares = row["x"][0]
        else:
            w[row["offset"] : row["offset"] + len(row["x"])] = row["x"]
    return r, w.reshape(dim, width), squares


def principal(points: DataFrame, v: str, dim: int, top: int = 16, seed: int = 0, passes: int = PASSES) -> Components:
    """The *top* components of the covariance of all points, of the greatest variance first."""
    column = points.select(F.col(v).cast("array<double>").alias("x")).where("x is not null")
    sums = dense.sums(column, "x").collect()
    n = sums[0]["n"] if sums else 0
    if sums and sum(len(row["sum"]) for row in sums) != dim:
        raise ValueError(f"a vector is not {dim} long")
    mean = np.zeros(dim)
    for row in sums:
        mean[row["offset"] : row["offset"] + len(row["sum"])] = np.array(row["sum"], float) / n
    top = min(top, dim)
    width = min(dim, top + OVERSAMPLE)
    if n < 2:
        return Components(mean, np.eye(dim)[:top], np.zeros(top), 0.0, n)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    before = None
    for _ in range(passes):
        r, w, squares = _pass(column, dim, mean, basis)
        # Directions without spread have no place in R; the pseudo-inverse leaves them out.
        z = w @ np.linalg.pinv(r, rcond=1e-13)
        u, s, _ = np.linalg.svd(z, full_matrices=False)
        values = s[:top] ** 2 / (n - 1)
        basis = u
        if before is not None and np.abs(values - before).max() <= TOLERANCE * max(values.max(initial=0.0), 1e-300):
            break
        before = values
    axes = basis[:, :top].T
    axes = axes * np.where(axes[np.arange(top), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return Components(mean, axes, values, squares / (n - 1), n)


def project(points: DataFrame, v: str, found: Components, top: int = 2, prefix: str = "pc") -> DataFrame:
    """*points*, all columns, with the coordinates of each centred point on the first *top* axes; null for a null vector."""
    names, axes, mean = points.columns, found.axes[:top], found.mean

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(v))
            known = column.is_valid().to_numpy(zero_copy_only=False)
            flat, ends = dense.vectors(column.drop_null().cast(pa.list_(pa.float64())))
            if (np.diff(ends) != len(mean)).any():
                raise ValueError(f"a vector is not {len(mean)} long")
            y = np.zeros((batch.num_rows, len(axes)))
            y[known] = (flat.reshape(-1, len(mean)) - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(y[:, k], mask=~known) for k in range(len(axes))]], names=[*names, *(f"{prefix}{k + 1}" for k in range(len(axes)))])

    schema = points.withColumns({f"{prefix}{k + 1}": F.lit(None).cast("double") for k in range(len(axes))}).schema
    return points.mapInArrow(rows, schema)
