"""Principal components of wide, sparse vectors by repeated projection.

The rows are never made dense and no square matrix of the width is formed. A thin matrix, width by a little more than the
components asked for, is multiplied by the centred rows and their transpose: tasks add up rows times their projections,
Spark adds up the tasks' sums. What comes out is multiplied again (randomised range finder with block Krylov iteration); the
driver solves only problems of the size of the thin matrices' columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of the thin matrix up to which it may be formed: 200 MB on the driver and in each worker.
MOST_CELLS = 25_000_000


def as_cells(df: DataFrame, column: str) -> DataFrame:
    """``index`` and ``value`` arrays of each row's vector, zeros left out."""
    dense = df.select(vector_to_array(column).alias("x"))
    cells = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("index"), v.alias("value"))), lambda c: c["value"] != 0)
    return dense.select(cells.alias("cells")).select(F.col("cells.index").alias("index"), F.col("cells.value").alias("value"))


#: Cells of rows multiplied in one numpy pass; it takes so many times the thin matrix's columns.
PASS_CELLS = 1 << 16


def _passes(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``PASS_CELLS`` cells: how many cells each row has, and the cells' columns and values."""
    index, value = batch.column(0), batch.column(1)
    ends = index.offsets.to_numpy()
    cols, vals = index.values.to_numpy(zero_copy_only=False), value.values.to_numpy(zero_copy_only=False)
    shift = int(value.offsets[0].as_py()) - int(ends[0])
    low = 0
    while low < len(ends) - 1:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + PASS_CELLS, "right")) - 1)
        own = slice(ends[low], ends[high])
        yield np.diff(ends[low : high + 1]), cols[own], vals[own.start + shift : own.stop + shift]
        low = high


def _added_up(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; a run of no rows is 0."""
    out = np.zeros((len(lengths), rows.shape[1]))
    used = lengths > 0
    if used.any():
        out[used] = np.add.reduceat(rows, (np.cumsum(lengths) - lengths)[used])
    return out


def _times_rows(cells: DataFrame, basis: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Centred rows' transpose times centred rows times ``basis``; a task sends one row per column it has seen."""
    width, thin = basis.shape
    held = cells.sparkSession.sparkContext.broadcast((basis, mean @ basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, offset = held.value
        total, seen, centre = np.zeros((width, thin)), np.zeros(width, bool), np.zeros(thin)
        for batch in batches:
            for lengths, cols, vals in _passes(batch):
                projected = _added_up(vals[:, None] * basis[cols], lengths) - offset
                centre += projected.sum(axis=0)
                order = np.argsort(cols, kind="stable")
                columns, counts = np.unique(cols, return_counts=True)
                row = np.repeat(np.arange(len(lengths)), lengths)[order]
                total[columns] += _added_up(vals[order, None] * projected[row], counts)
                seen[columns] = True
        used = np.flatnonzero(seen)
        # row -1 holds the sum of the projections, which the mean is multiplied by
        values = np.concatenate((total[used], centre[None, :]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1)), pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), thin).cast(pa.list_(pa.float64()))], ["at", "part"]
        )

    parts = cells.mapInArrow(run, "at bigint, part array<double>")
    summed = parts.groupBy("at").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("total")).collect()  # width rows at most
    held.unpersist()
    out, centre = np.zeros((width, thin)), np.zeros(thin)
    for r in summed:
        if r["at"] < 0:
            centre = np.array(r["total"])
        else:
            out[r["at"]] = r["total"]
    return out - np.outer(mean, centre)


def leading_components(train: DataFrame, column: str, components: int, extra: int = 10, most_rounds: int = 60, tolerance: float = 1e-7, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (width by at most ``components``, by falling variance) and each one's share of the variance.

    ``train`` is read once per round, so hand in a written table. Rounds end when every component is reproduced by the
    covariance up to ``tolerance`` of the largest variance. Blocks of earlier rounds are kept, as together they
    converge much faster than the last one alone; if they have more than ``MOST_CELLS`` cells, the best directions so
    far begin anew. A thin matrix of more cells than that is refused.
    """
    summary = train.select(Summarizer.metrics("mean", "count", "variance").summary(F.col(column)).alias("s")).first()["s"]
    mean, count, variance = summary["mean"].toArray(), summary["count"], float(summary["variance"].toArray().sum())
    width = len(mean)
    k = min(components, count, width)
    thin = min(k + extra, width)
    if width * thin > MOST_CELLS:
        raise ValueError(f"{width} columns times {thin} components are too many cells")
    cells = as_cells(train, column)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, thin)))[0]
    basis, moved = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(most_rounds):
        step = _times_rows(cells, block, mean)
        basis, moved = np.hstack((basis, block)), np.hstack((moved, step))
        values, turn = np.linalg.eigh((basis.T @ moved + moved.T @ basis) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = max(values[0], 0.0)
        missed = np.linalg.norm(moved @ turn[:, :k] - basis @ turn[:, :k] * values[:k], axis=0).max(initial=0.0)
        if missed <= tolerance * top or basis.shape[1] >= width:
            break
        for _ in range(2):  # once more for what rounding leaves
            step = step - basis @ (basis.T @ step)
        left, sizes, _ = np.linalg.svd(step, full_matrices=False)
        block = left[:, sizes > 1e-10 * max(top, 1e-300)][:, : width - basis.shape[1]]
        if not block.shape[1]:
            break
        if 2 * width * (basis.shape[1] + thin) > MOST_CELLS:
            basis, moved = basis @ turn[:, :thin], moved @ turn[:, :thin]
    best = basis @ turn[:, :k]
    shares = np.maximum(values[:k], 0.0) / max(count - 1, 1)
    return mean, best, shares / variance if variance > 0 else shares
